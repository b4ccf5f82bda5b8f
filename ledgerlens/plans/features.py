"""The per-table feature profiles, the universe, and the wide feature table.

Each feature table is ONE ``groupBy(ID, period).agg(...)`` whose aggregate
list comes from a preset (data, not code): typing happens in the same
projection that feeds the partial aggregate, one-hot indicators are built
inside ``max(...)``, and the zero fill is a projection after the final
aggregate. The aggregated tables come out hash-partitioned on (ID, period),
so the star join over them needs no further exchange for them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.nulls import clean_doubles, fill_with_means, fill_zero, known_means
from ..operators.profile import presence, spec_columns
from ..operators.resample import hash_split, rebalance_counted, rebalance_stored
from ..session import plain_constraints
from ..sources.materialize import stage

KEYS = ("ID", "period")
MONTHS = tuple(range(1, 13))


@dataclass(frozen=True)
class TablePreset:
    """How one activity table becomes one row per (ID, period)."""
    floats: Sequence[str]                 # text/number → float32
    codes: Sequence[str] = ()             # ``prefix_N`` → N as float
    spec: Sequence[tuple[str, str, str]] = ()   # (output, statistic, column)
    presence: Sequence[tuple[str, Sequence, str]] = ()  # (column, levels, prefix)
    zero_fill: bool = True
    ints: Sequence[str] = ("month",)


def _by_stat(prefix: str, cols: Sequence[str], stats: Sequence[tuple[str, str]]) -> list:
    """``{prefix}{col}_{suffix}`` grouped by statistic, columns inside."""
    return [(f"{prefix}{c}_{suffix}", s, c) for suffix, s in stats for c in cols]


# Output names, statistic order and one-hot levels of the
# feature tables (balance type level 6 has no indicator).
BALANCE_TYPE_LEVELS = (1, 2, 3, 4, 5, 7)
BALANCE_PRODUCT_LEVELS = (1, 2, 3, 4, 5, 6, 7)
BALANCE_ENTITY_LEVELS = (1, 2, 3, 4, 5)
BUREAU_RISK_LEVELS = tuple(range(1, 10))
TYPE_JOB_LEVELS = tuple(range(1, 8))
CUSTOMER_FLAGS = ("product_1", "product_2", "product_3", "product_4", "ofert_1", "ofert_2", "ofert_3")
CUSTOMER_FLOATS = ("age", "income", "payroll")
SPECIALIZED_LEVEL = 5  # the only time_from_specialized indicator the pipeline keeps


def _balance_spec():
    spec = [(f"mean_{c}_balances", "mean", c) for c in ("month", "type", "product", "entity")]
    for c in ("balance_amount", "days_default"):
        spec += [(f"{s}_{c}_balances", stat, c)
                 for s, stat in (("mean", "mean"), ("min", "min"), ("max", "max"),
                                 ("std", "std"), ("sum", "sum"))]
    return spec


BALANCES = TablePreset(
    floats=("balance_amount", "days_default"),
    codes=("type", "product", "entity"),
    spec=_balance_spec(),
    presence=(("type", BALANCE_TYPE_LEVELS, "type"), ("product", BALANCE_PRODUCT_LEVELS, "product"),
              ("entity", BALANCE_ENTITY_LEVELS, "entity"), ("month", MONTHS, "bal_month")),
)

LIABILITIES = TablePreset(
    floats=("product_1", "product_2"),
    spec=[("count_month_liabilities", "count", "month")]
    + _by_stat("lbl_", ("product_1", "product_2"),
               (("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"), ("sum", "sum"))),
    presence=(("month", MONTHS, "liab_month"),),
)

MOVEMENT_COLS = ("type_1", "type_2", "type_3", "type_4")
MOVEMENTS = TablePreset(
    floats=MOVEMENT_COLS,
    spec=[("count_month_movements", "count", "month")]
    + _by_stat("mvm_", MOVEMENT_COLS,
               (("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"),
                ("kurtosis", "kurtosis"), ("sum", "sum"))),
    presence=(("month", MONTHS, "move_month"),),
)

DIGITAL_COLS = tuple(f"dig_{i}" for i in range(1, 12))
DIGITAL = TablePreset(
    floats=DIGITAL_COLS,
    spec=_by_stat("", DIGITAL_COLS,
                  (("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"),
                   ("kurt", "kurtosis"), ("sum", "sum"))),
    presence=(("month", MONTHS, "digi_month"),),
    zero_fill=False,
)



def typed(df: DataFrame, preset: TablePreset) -> DataFrame:
    """Only the columns the preset reads, typed in one projection."""
    used = set(preset.floats) | set(preset.codes) | set(preset.ints)
    used |= {c for _, _, c in preset.spec} | {c for c, _, _ in preset.presence}
    exprs = [F.col(k) for k in KEYS]
    for c in [c for c in df.columns if c in used]:
        if c in preset.codes:
            exprs.append(C.code_number(c).alias(c))
        elif c in preset.ints:
            exprs.append(C.to_int(c).alias(c))
        elif c in preset.floats:
            exprs.append(C.to_float(c).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def output_columns(preset: TablePreset) -> list[str]:
    names = [n for n, _, _ in preset.spec]
    for _, levels, prefix in preset.presence:
        names += [f"{prefix}{k}" for k in levels]
    return names


def table_features(df: DataFrame, preset: TablePreset, keys: Sequence[str] = KEYS) -> DataFrame:
    aggs = spec_columns(preset.spec)
    for c, levels, prefix in preset.presence:
        aggs += presence(c, levels, prefix)
    out = typed(df, preset).groupBy(*keys).agg(*aggs)
    return fill_zero(out) if preset.zero_fill else out


def balance_features(balances: DataFrame) -> DataFrame:
    return table_features(balances, BALANCES)


def liability_features(liabilities: DataFrame) -> DataFrame:
    return table_features(liabilities, LIABILITIES)


def movement_features(movements: DataFrame) -> DataFrame:
    return table_features(movements, MOVEMENTS)


def digital_features(digital: DataFrame) -> DataFrame:
    """Nulls are kept here (no zero fill); they are imputed later."""
    return table_features(digital, DIGITAL)


def customer_columns() -> list[str]:
    cols = ["ID", *CUSTOMER_FLAGS, *CUSTOMER_FLOATS]
    cols += [f"bureau_risk{k}" for k in BUREAU_RISK_LEVELS]
    cols += [f"type_job{k}" for k in TYPE_JOB_LEVELS]
    return cols + ["time_from_specialized1"]


def customer_features(customers: DataFrame, all_levels: bool = False) -> DataFrame:
    """One row per customer: 0/1 flags, float numerics, risk and job
    indicators, and the single kept ``time_from_specialized`` indicator;
    ``all_levels`` adds the indicators of its levels 0 to 5."""
    risk = C.to_int(C.code_suffix("bureau_risk"))
    job = C.to_int(C.code_suffix("type_job"))
    tfs = C.to_int("time_from_specialized")
    return customers.select(
        "ID",
        *[C.yes_no(c).alias(c) for c in CUSTOMER_FLAGS],
        *[C.to_float(c).alias(c) for c in CUSTOMER_FLOATS],
        *C.one_hot_columns(risk, BUREAU_RISK_LEVELS, "bureau_risk"),
        *C.one_hot_columns(job, TYPE_JOB_LEVELS, "type_job"),
        F.when(tfs == SPECIALIZED_LEVEL, 1).otherwise(0).alias("time_from_specialized1"),
        *(C.one_hot_columns(tfs, range(6), "time_from_specialized_") if all_levels else []),
    )


def universe_union(train: DataFrame, test: DataFrame, label: str = "attrition") -> DataFrame:
    """Train rows tagged ``train``, test rows tagged ``test`` with a typed null
    label, appended by column name."""
    tr = train.select("ID", "period", C.to_int(label).alias(label), F.lit("train").alias("partition"))
    te = test.select("ID", "period", F.lit(None).cast("int").alias(label), F.lit("test").alias("partition"))
    return tr.unionByName(te)


def feature_star_join(universe: DataFrame, feature_tables: Sequence[DataFrame],
                      customers: DataFrame | None, keys: Sequence[str] = KEYS,
                      how_customers: str = "left") -> DataFrame:
    """Universe left-joined to every (ID, period) feature table, then to the
    customer table on ID.

    The customer join runs first, on the narrow universe, so the wide result
    is never re-shuffled by ID; the feature tables are already partitioned on
    (ID, period) by their aggregation and join without another exchange.
    No broadcast hint: AQE broadcasts a side only when its measured size is
    under the threshold."""
    base = universe
    if customers is not None:
        base = base.join(customers, on=keys[0], how=how_customers)
    for ft in feature_tables:
        base = base.join(ft, on=list(keys), how="left")
    ordered = list(universe.columns)
    for ft in feature_tables:
        ordered += [c for c in ft.columns if c not in keys]
    if customers is not None:
        ordered += [c for c in customers.columns if c != keys[0]]
    return base.select(*ordered)


@dataclass
class ModelMatrix:
    train: DataFrame        # imputed training rows with label, binary target and split
    validation: DataFrame   # imputed scoring rows (no label)
    features: list[str] = field(default_factory=list)


NOT_FEATURES = ("ID", "period", "partition", "key")


def feature_matrix(wide: DataFrame, label: str = "attrition", split_col: str = "split",
                   seed: int = 2020, eval_fraction: float = 0.2, fit_on: str = "each_split",
                   train_only: bool = False, staged: bool = True) -> ModelMatrix:
    """Feature list (sorted), double casts, mean imputation per split,
    complete training rows, integer and binary targets, and a repeatable
    80/20 split. ``wide`` should be a stored table: each split is read by a
    pushed-down filter once for its means (one row) and once for its rows,
    and filled by a single projection.

    A column with no value at all in a split has no mean: it stays null there
    and is left out of ``features`` (the model inputs) and of the complete-row
    test, which would otherwise drop every row.

    Each split is filled with its own means; with ``fit_on="train"`` scoring rows get
    the training split's. With ``train_only`` the training split's means leave
    out the held-out rows. Without ``staged`` the splits are projections over ``wide``, for a
    caller that reads each part once or stores what it makes of it."""
    if fit_on not in ("each_split", "train"):
        raise ValueError(f"fit_on: {fit_on!r}")
    cols = C.columns_except(wide, NOT_FEATURES)
    features = C.sorted_difference(cols, [label])

    def part(name: str, *more: str) -> DataFrame:
        return clean_doubles(wide.where(F.col("partition") == name).select("ID", "period", *more, *features), features)

    train, validation = part("train", label), part("test")
    fitted = train
    if train_only:
        fitted = hash_split(train, ("ID", "period"), 1.0 - eval_fraction, seed=seed, col=split_col).where(
            F.col(split_col) == "train")
    means = known_means(fitted, features)
    train, in_train = (train.fillna(means) if means else train), [f for f in features if f in means]
    validation, in_test = fill_with_means(validation, features, fitted if fit_on == "train" else None)
    usable = [f for f in in_train if f in set(in_test)] if in_test else in_train
    # a filled column is incomplete only where its mean is no number; the others need not be asked row by row
    gaps = [f for f in usable if math.isnan(means[f])]
    train = (train.dropna(how="any", subset=[*gaps, label])
             .withColumn(label, F.col(label).cast("bigint"))
             .withColumn("binary_target", C.binary_target(label)))
    train = hash_split(train, ("ID", "period"), 1.0 - eval_fraction, seed=seed, col=split_col)
    train = train.select("ID", "period", *features, label, "binary_target", split_col)
    validation = validation.select("ID", "period", *features)
    if staged:
        with plain_constraints(wide.sparkSession):
            train, validation = stage(train, "matrix-train"), stage(validation, "matrix-validation")
    return ModelMatrix(train, validation, usable)


def training_rows(matrix: ModelMatrix, n: int, weights: Sequence[float] | None = None, label: str = "attrition",
                  split_col: str = "split", seed: int = 2020) -> tuple[DataFrame, DataFrame]:
    """(rebalanced training part, held-out part). Only the training part is
    rebalanced, so no copy of a held-out row can reach a fit."""
    train = matrix.train.where(F.col(split_col) == "train").drop(split_col)
    held_out = matrix.train.where(F.col(split_col) == "test").drop(split_col)
    return rebalance_stored(train, label, ("ID", "period"), n, weights, seed=seed, allow_absent=True), held_out


def counted_training_rows(matrix: ModelMatrix, n: int, weights: Sequence[float] | None = None, label: str = "attrition",
                          split_col: str = "split", seed: int = 2020) -> tuple[DataFrame, DataFrame]:
    """As ``training_rows``, but each distinct training row once, with the
    number of its copies in ``times``."""
    train = matrix.train.where(F.col(split_col) == "train").drop(split_col)
    held_out = matrix.train.where(F.col(split_col) == "test").drop(split_col)
    return rebalance_counted(train, label, ("ID", "period"), n, weights, seed=seed, allow_absent=True), held_out
