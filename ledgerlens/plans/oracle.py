"""SQL text (DuckDB dialect) equivalent to the Spark queries, used as the
independent correctness check. The stand-in input views are CTEs; derived
SQL for the preset-driven feature tables is generated from the same presets
the Spark side uses, so both engines evaluate one specification."""

from __future__ import annotations

from collections.abc import Sequence

from .features import (BALANCES, BUREAU_RISK_LEVELS, CUSTOMER_FLAGS, CUSTOMER_FLOATS, DIGITAL,
                       LIABILITIES, MOVEMENTS, SPECIALIZED_LEVEL, TYPE_JOB_LEVELS, TablePreset,
                       output_columns)

BUCKET = "((('0x' || substr(md5(concat(ID,'_',period)),1,8))::bigint) % 100)"

VIEW_SQL = {
    "base_orders": """select cast(o_custkey as string) as ID, concat('period_', cast(year(o_orderdate)-1994 as string)) as period,
       cast(month(o_orderdate) as int) as month, o_orderkey, o_totalprice, o_orderstatus from orders""",
    "universe_all": f"""select ID, period, cast(least(count(*)-1, 5) as int) as attrition, {BUCKET} as b
       from base_orders group by ID, period""",
    "universe_train": "select ID, period, attrition from universe_all where b < 80",
    "universe_test": "select ID, period from universe_all where b >= 80",
    "liabilities": """select ID, period, month, o_totalprice as product_1,
       case when o_orderstatus='F' then o_totalprice*0.1 end as product_2 from base_orders""",
    "movements": """select ID, period, month, l_quantity as type_1, l_extendedprice as type_2, l_discount as type_3,
       l_tax as type_4 from base_orders join lineitem on l_orderkey = o_orderkey""",
    "balances": """select ID, period, month, concat('type_', cast(l_linenumber as string)) as type,
       case when l_partkey%50=0 then 'unknown' else concat('product_', cast(l_partkey%7+1 as string)) end as product,
       concat('entity_', cast(l_suppkey%5+1 as string)) as entity,
       l_extendedprice*(1-l_discount) as balance_amount,
       cast(case when l_returnflag='R' then l_partkey%120 else 0 end as int) as days_default
       from base_orders join lineitem on l_orderkey = o_orderkey""",
    "digital": """select cast(user_id as string) as ID, concat('period_', cast(dayofmonth(ts)%7+1 as string)) as period,
       cast(event_id%12+1 as int) as month,
       case when event_id%2=0 then null else value end as dig_1, value*2 as dig_2,
       case when event_type='purchase' then value end as dig_3, case when event_type='click' then value end as dig_4,
       case when event_type='view' then value end as dig_5, case when event_type='signup' then value end as dig_6,
       case when event_type='error' then value end as dig_7, cast(event_id%10 as double) as dig_8,
       cast(event_id%3 as double) as dig_9, cast(1 as double) as dig_10, value-100 as dig_11 from events""",
    "customers": """select cast(c_custkey as string) as ID,
       case when c_custkey%11=0 then 'none' else concat('type_job_', cast(c_nationkey%7+1 as string)) end as type_job,
       concat('risk_', cast(c_custkey%9+1 as string)) as bureau_risk,
       case when c_custkey%2=0 then 'Yes' else 'No' end as product_1,
       case when c_custkey%3=0 then 'yes' else 'Yes' end as product_2,
       case when c_custkey%4=0 then null else 'Yes' end as product_3,
       case when c_custkey%5=0 then 'Yes' else 'No' end as product_4,
       case when c_custkey%6=0 then 'Yes' else 'No' end as ofert_1,
       case when c_custkey%7=0 then 'Yes' else 'No' end as ofert_2,
       case when c_custkey%8=0 then 'Yes' else 'No' end as ofert_3,
       cast(18+c_custkey%60 as string) as age, c_acctbal as income,
       case when c_custkey%4=0 then null else c_acctbal*0.1 end as payroll,
       case when c_custkey%13=0 then '' else concat(cast(c_custkey%6 as string), '.0') end as time_from_specialized
       from customer""",
    "scored": """select ID, period, attrition as label, b, cast(b%8 as double)*0.5 as raw_score, cast(b as double)/100 as bin_score,
       cast(case when b%10<7 then attrition else (attrition+1)%6 end as int) as pred_a,
       cast(case when b%7<5 then attrition else (attrition+2)%6 end as int) as pred_b from universe_all""",
}

VIEW_DEPS = {
    "universe_all": ["base_orders"], "universe_train": ["universe_all"], "universe_test": ["universe_all"],
    "liabilities": ["base_orders"], "movements": ["base_orders"], "balances": ["base_orders"],
    "scored": ["universe_all"],
}


def _closure(names: Sequence[str]) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in VIEW_DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views: Sequence[str], body: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    """``WITH`` the stand-in views (and their dependencies), then ``extra``
    named CTEs, then ``body``."""
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in _closure(views)]
    ctes += [f"{n} AS ({sql})" for n, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- scalar SQL mirrors of functions.columns --------------------------------

SUFFIX = r"'_(\d+)'"


def to_float(x: str) -> str:
    return f"TRY_CAST({x} AS FLOAT)"


def to_int(x: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS INTEGER)"


def suffix(x: str) -> str:
    return f"regexp_extract({x}, {SUFFIX}, 1)"


def code_number(x: str) -> str:
    return f"CAST({to_int(suffix(x))} AS FLOAT)"


def yes_no(x: str) -> str:
    return f"(CASE WHEN {x} = 'Yes' THEN 1 ELSE 0 END)"


def md5_int(text: str, digits: int = 15) -> str:
    return f"(('0x' || substr(md5({text}), 1, {digits}))::BIGINT)"


def seeded_hash(seed: str, *cols: str) -> str:
    return md5_int(f"'{seed}:' || " + " || '_' || ".join(cols))


# Check rounding grid: 4 decimals with the cut moved off exact decimal ties
# (statistics such as a kurtosis of -0.65625 are exact ties and would flip
# between engines on the last bit). Same arithmetic as ``catalog.for_check``.
ROUND_SCALE = 10000.0
ROUND_CUT = 0.4876543211


def rnd(x: str) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * {ROUND_SCALE} + {ROUND_CUT}) / {ROUND_SCALE})"


STAT_SQL = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "kurtosis": "kurtosis_pop",
            "sum": "sum", "count": "count", "distinct": "count(DISTINCT {})"}
FLOATING_STATS = {"mean", "std", "min", "max", "kurtosis", "sum"}


def stat_sql(s: str, c: str) -> str:
    f = STAT_SQL[s]
    return f.format(c) if "{}" in f else f"{f}({c})"


# --- preset-driven feature tables ------------------------------------------

def typed_sql(view: str, preset: TablePreset, keys=("ID", "period")) -> str:
    used = list(dict.fromkeys([*preset.ints, *preset.codes, *preset.floats,
                               *[c for _, _, c in preset.spec], *[c for c, _, _ in preset.presence]]))
    exprs = list(keys)
    for c in used:
        if c in preset.codes:
            exprs.append(f"{code_number(c)} AS {c}")
        elif c in preset.ints:
            exprs.append(f"{to_int(c)} AS {c}")
        elif c in preset.floats:
            exprs.append(f"{to_float(c)} AS {c}")
        else:
            exprs.append(c)
    return f"SELECT {', '.join(exprs)} FROM {view}"


def floating_outputs(preset: TablePreset) -> set[str]:
    return {n for n, s, _ in preset.spec if s in FLOATING_STATS}


def table_features_sql(view: str, preset: TablePreset, keys=("ID", "period")) -> str:
    aggs = [f"{stat_sql(s, c)} AS {n}" for n, s, c in preset.spec]
    for c, levels, prefix in preset.presence:
        aggs += [f"max(CASE WHEN {c} = {k} THEN 1 ELSE 0 END) AS {prefix}{k}" for k in levels]
    k = ", ".join(keys)
    agg = f"SELECT {k}, {', '.join(aggs)} FROM ({typed_sql(view, preset, keys)}) t GROUP BY {k}"
    if not preset.zero_fill:
        return agg
    outs = [f"coalesce({n}, 0) AS {n}" for n in output_columns(preset)]
    return f"SELECT {k}, {', '.join(outs)} FROM ({agg}) a"


def customer_features_sql(view: str = "customers") -> str:
    risk = to_int(suffix("bureau_risk"))
    job = to_int(suffix("type_job"))
    tfs = to_int("time_from_specialized")
    cols = ["ID"] + [f"{yes_no(c)} AS {c}" for c in CUSTOMER_FLAGS]
    cols += [f"{to_float(c)} AS {c}" for c in CUSTOMER_FLOATS]
    cols += [f"(CASE WHEN {risk} = {k} THEN 1 ELSE 0 END) AS bureau_risk{k}" for k in BUREAU_RISK_LEVELS]
    cols += [f"(CASE WHEN {job} = {k} THEN 1 ELSE 0 END) AS type_job{k}" for k in TYPE_JOB_LEVELS]
    cols.append(f"(CASE WHEN {tfs} = {SPECIALIZED_LEVEL} THEN 1 ELSE 0 END) AS time_from_specialized1")
    return f"SELECT {', '.join(cols)} FROM {view}"


UNIVERSE_UNION = ("SELECT ID, period, CAST(attrition AS INTEGER) AS attrition, 'train' AS partition "
                  "FROM universe_train UNION ALL "
                  "SELECT ID, period, CAST(NULL AS INTEGER) AS attrition, 'test' AS partition FROM universe_test")

FEATURE_TABLES = (("mv", "movements", MOVEMENTS), ("lb", "liabilities", LIABILITIES),
                  ("bl", "balances", BALANCES), ("dg", "digital", DIGITAL))


def customer_feature_columns() -> list[str]:
    from .features import customer_columns
    return [c for c in customer_columns() if c != "ID"]


def wide_ctes() -> list[tuple[str, str]]:
    ctes = [(alias, table_features_sql(view, preset)) for alias, view, preset in FEATURE_TABLES]
    ctes.append(("cu", customer_features_sql()))
    ctes.append(("uni", UNIVERSE_UNION))
    ctes.append(("wide", wide_select()))
    return ctes


def wide_select() -> str:
    cols = ["u.ID", "u.period", "u.attrition", "u.partition"]
    joins = ["LEFT JOIN cu ON u.ID = cu.ID"]
    for alias, _, preset in FEATURE_TABLES:
        cols += [f"{alias}.{c}" for c in output_columns(preset)]
        joins.append(f"LEFT JOIN {alias} ON u.ID = {alias}.ID AND u.period = {alias}.period")
    cols += [f"cu.{c}" for c in customer_feature_columns()]
    return f"SELECT {', '.join(cols)} FROM uni u " + " ".join(joins)


WIDE_VIEWS = ("universe_train", "universe_test", "movements", "liabilities", "balances", "digital", "customers")


def wide_floating() -> set[str]:
    out = set(CUSTOMER_FLOATS)
    for _, _, preset in FEATURE_TABLES:
        out |= floating_outputs(preset)
    return out


def select_rounded(cols: Sequence[str], floating: set[str], src: str) -> str:
    parts = [f"{rnd(c)} AS {c}" if c in floating else c for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"
