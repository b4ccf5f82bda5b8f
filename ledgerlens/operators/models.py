"""Random forest (``pyspark.ml``), two-stage boosted trees (``boosting``), and a
linear stacker. Fitting and scoring are distributed; the driver holds only
models. Inputs must be imputed (``VectorAssembler`` rejects nulls)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import score_to_class, two_stage_decision
from ..sources.csv import write_csv
from .boosting import Blocks, Booster, BoostSettings, Target, fit_blocks, stored_blocks, thresholds
from .metrics import macro_f1
from .resample import class_counts, hash_split


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def _has_checkpoint_dir(df: DataFrame) -> bool:
    return bool(df.sparkSession.sparkContext.getCheckpointDir())


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str, seed: int = 2020,
                      **params):
    """``RandomForestClassifier`` on assembled features; the label is never a feature."""
    feats = [f for f in features if f != label]
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed, **params)
    if _has_checkpoint_dir(train):
        rf.setCheckpointInterval(10)
    return rf.fit(train if "features" in train.columns else assemble(train, feats)), feats


def predict_random_forest(model, feats: Sequence[str], df: DataFrame, out: str = "target") -> DataFrame:
    scored = model.transform(df if "features" in df.columns else assemble(df, feats))
    return scored.withColumn(out, F.col("prediction").cast("int"))


@dataclass(frozen=True)
class TwoStagePreset:
    """Settings of the two stages: a binary boosting, and a joint multiclass one
    on the positives (on all rows without ``shift_stage2``). Each stops
    ``patience`` rounds after its best round on the held-out rows (``None``: it runs
    all its rounds), measured by wrong rows or, with ``stop_on="loss"``, by log loss."""
    step_size: float = 0.05
    max_depth: int = 7
    max_leaves: int | None = None
    l2: float = 0.0
    subsample: float = 0.8
    level_columns: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    max_iter_binary: int = 2800
    max_iter_multi: int = 1400
    patience_binary: int | None = 22
    patience_multi: int | None = 5
    shift_stage2: bool = True   # stage 2 trained on label - 1 among positives
    stop_on: str = "wrong"
    seed: int = 2020

    def settings(self, classes: int, rounds: int, patience: int | None) -> BoostSettings:
        return BoostSettings(classes=classes, rounds=rounds, patience=patience, step_size=self.step_size,
                             max_depth=self.max_depth, max_leaves=self.max_leaves, l2=self.l2, subsample=self.subsample,
                             level_columns=self.level_columns, min_hessian=self.min_hessian, min_rows=self.min_rows,
                             stop_on=self.stop_on, seed=self.seed)


# The deep, the light and the column-subsampled presets.
DEEP = TwoStagePreset(step_size=0.05, max_depth=7, subsample=0.8, l2=5.0, max_iter_binary=2800, max_iter_multi=1400,
                      patience_binary=22, patience_multi=5)
LIGHT = TwoStagePreset(step_size=0.1, max_depth=5, max_leaves=5, subsample=1.0, min_hessian=1e-3, min_rows=20,
                       max_iter_binary=100, max_iter_multi=100, patience_binary=None, patience_multi=None,
                       shift_stage2=False)
COLUMN_SUBSAMPLED = TwoStagePreset(step_size=0.05, max_depth=5, subsample=0.8, level_columns=0.8, l2=0.8,
                                   max_iter_binary=1000, max_iter_multi=1000, patience_binary=5, patience_multi=5)


@dataclass
class TwoStageModel:
    binary: Booster
    multi: Booster | None       # None: stage 2 saw one class
    classes: list[int]          # stage-2 classes by output
    features: list
    preset: TwoStagePreset

    def rounds(self) -> dict[str, int]:
        """Rounds of each boosting."""
        return {"binary": len(self.binary.rounds_), "multi": len(self.multi.rounds_) if self.multi else 0}

    def score(self, x: DataFrame) -> DataFrame:
        """Add ``binary_pred`` and ``multi_pred``."""
        known = F.array(*[F.lit(int(c)) for c in self.classes or [0]])
        place = self.multi.predict() if self.multi else F.lit(0)
        return x.withColumns({"binary_pred": self.binary.predict(), "multi_pred": F.get(known, place)})

    def transform(self, df: DataFrame, out: str = "target") -> DataFrame:
        """Score both stages and combine: 0 where stage 1 says 0, else the
        stage-2 class (+1 when stage 2 was trained on shifted labels)."""
        shift = 1 if self.preset.shift_stage2 else 0
        return self.score(df).withColumn(out, two_stage_decision("binary_pred", "multi_pred", shift))


def fit_two_stage(train: DataFrame, held_out: DataFrame, features: Sequence[str], label: str = "attrition",
                  binary: str = "binary_target", preset: TwoStagePreset = DEEP, times: str | None = None,
                  cuts: list[list[float]] | None = None, blocks: Blocks | None = None) -> TwoStageModel:
    """Stage 1: binary boosting on every training row. Stage 2: joint multiclass
    boosting of the classes that occur, on the positive training rows (on all
    rows without the shift). ``held_out`` rows decide when each boosting stops and
    reach no fit; those of a class that no training row has are not asked. ``times`` names
    the multiplicity of a training row; ``cuts`` gives thresholds that are known already, ``blocks``
    the stored blocks of both with the labels ``binary`` and ``label``."""
    feats = list(features)
    cuts = thresholds(train, feats) if cuts is None else cuts
    own = stored_blocks(train, held_out, feats, cuts, (binary, label), times) if blocks is None else None
    blocks = own if blocks is None else blocks
    rows, shift = (train.where(F.col(binary) != 0), 1) if preset.shift_stage2 else (train, 0)
    known = tuple(sorted(int(c) for c, _ in class_counts(rows, label)))
    classes = [c - shift for c in known]
    one = preset.settings(2, preset.max_iter_binary, preset.patience_binary)
    several = preset.settings(len(classes), preset.max_iter_multi, preset.patience_multi)
    with ThreadPoolExecutor(2) as pool:     # the stages do not depend on each other
        first = pool.submit(fit_blocks, blocks, feats, cuts, one, Target(0, (0, 1)))
        second = None
        if len(classes) > 1:
            second = pool.submit(fit_blocks, blocks, feats, cuts, several, Target(1, known, positive=0 if shift else None))
        model = TwoStageModel(first.result(), second.result() if second else None, classes, feats, preset)
    if own is not None:
        own.drop()
    return model


def fit_presets(train: DataFrame, held_out: DataFrame, features: Sequence[str], presets: Mapping[str, TwoStagePreset],
                label: str = "attrition", times: str | None = None) -> dict[str, TwoStageModel]:
    """A two-stage model for each preset, side by side: a boosting is a long row of short
    jobs, which leave a cluster idle one by one. They share the thresholds and the blocks, so rows are binned once."""
    cuts = thresholds(train, features)
    blocks = stored_blocks(train, held_out, features, cuts, ("binary_target", label), times)
    with ThreadPoolExecutor(max(1, len(presets))) as pool:
        fits = {name: pool.submit(fit_two_stage, train, held_out, features, label, preset=preset, times=times, cuts=cuts, blocks=blocks)
                for name, preset in presets.items()}
        models = {name: fit.result() for name, fit in fits.items()}
    blocks.drop()
    return models


def evaluate_two_stage(model: TwoStageModel, held_out: DataFrame, label: str = "attrition",
                       binary: str = "binary_target") -> DataFrame:
    """Macro F1 of each stage on held-out rows: stage 1 on all, stage 2 on the
    positive ones, and of the combined decision."""
    shift = 1 if model.preset.shift_stage2 else 0
    scored = model.score(held_out).withColumn("target", two_stage_decision("binary_pred", "multi_pred", shift))
    positive = scored.where(F.col(binary) != 0).withColumn("stage2", F.col(label) - shift)
    parts = [("binary", macro_f1(scored, binary, "binary_pred")), ("multi", macro_f1(positive, "stage2", "multi_pred")),
             ("decision", macro_f1(scored, label, "target"))]
    out = None
    for name, part in parts:
        row = part.select(F.lit(name).alias("stage"), "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out


def submit(scored: DataFrame, path: str, target: str = "target") -> None:
    """Write ``ID, period, target`` of scored rows as comma-separated text."""
    write_csv(scored.select("ID", "period", F.col(target).cast("int").alias("target")), path, sep=",")


@dataclass(frozen=True)
class LinearStack:
    intercept: float
    coefficients: tuple[float, ...]
    inputs: tuple[str, ...]

    def predict(self) -> Column:
        """Null where an input is null."""
        out = F.lit(self.intercept)
        for c, name in zip(self.coefficients, self.inputs):
            out = out + F.lit(c) * F.col(name)
        return out


#: Directions of the inputs whose variance is below this share of the largest are taken as dependent.
DEPENDENT = 1e-13


def fit_linear_stack(df: DataFrame, inputs: Sequence[str], label: str) -> LinearStack:
    """Least squares of ``label`` on ``inputs`` with an intercept, from their means and
    covariances: one aggregate with a partial step, k x k numbers on the driver. Where inputs
    depend on each other (two families that agree everywhere, a constant one), of all
    best solutions the one with the smallest coefficients is returned. Rows with a
    null input or label take no part; with no row left there is nothing to fit."""
    names = [*inputs, label]
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    k = len(inputs)
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    row = x.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k + 1)],
                *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    if row["m0"] is None:
        raise ValueError("no complete row to fit a stacker on")
    s = np.zeros((k, k + 1))
    for i, j in pairs:
        s[i, j] = row[f"c{i}_{j}"]
        if j < k:
            s[j, i] = s[i, j]
    coefficients = np.linalg.pinv(s[:, :k], rcond=DEPENDENT, hermitian=True) @ s[:, k]
    means = np.array([row[f"m{i}"] for i in range(k + 1)])
    return LinearStack(float(means[k] - means[:k] @ coefficients), tuple(map(float, coefficients)), tuple(inputs))


def linear_stack_coefficients(model: LinearStack, inputs: Sequence[str], spark) -> DataFrame:
    """Intercept and one coefficient per input as a one-row DataFrame."""
    names = ["intercept"] + [f"coef_{c}" for c in inputs]
    return spark.createDataFrame([(model.intercept, *model.coefficients)], names)


def linear_stack_score(model: LinearStack, df: DataFrame, inputs: Sequence[str], out: str = "target") -> DataFrame:
    """Predict, round half to even, keep ``ID, period, target``."""
    scored = df.withColumn("prediction", model.predict())
    return scored.select("ID", "period", score_to_class("prediction").alias(out))


def family_predictions(families: Mapping[str, TwoStageModel], rows: DataFrame, label: str | None = None) -> DataFrame:
    """``ID, period, pred_<family>...`` of every fitted family, in one projection over
    ``rows``, with the truth as ``real`` if ``label`` names it."""
    scored = rows
    for name, model in families.items():
        scored = model.transform(scored, f"pred_{name}").drop("binary_pred", "multi_pred")
    truth = [F.col(label).cast("int").alias("real")] if label else []
    return scored.select("ID", "period", *[f"pred_{name}" for name in families], *truth)


def stack_families(train: DataFrame, held_out: DataFrame, scoring: DataFrame, features: Sequence[str],
                   presets: Mapping[str, TwoStagePreset], label: str = "attrition", times: str | None = None,
                   seed: int = 2020) -> tuple[dict[str, TwoStageModel], DataFrame, DataFrame]:
    """Two or more fitted families, and their predictions out of sample: (models, labelled
    predictions to fit a stacker on, predictions of the scoring rows). A hash of the keys
    halves the held-out rows: one half decides when the boostings stop, the stacker
    gets the other, which no fit and no stop has seen."""
    halves = hash_split(held_out, ("ID", "period"), 0.5, seed=f"stack{seed}", col="__half")
    stops, unseen = [halves.where(F.col("__half") == side).drop("__half") for side in ("train", "test")]
    models = fit_presets(train, stops, features, presets, label, times)
    return models, family_predictions(models, unseen, label), family_predictions(models, scoring)
