"""Run Spark queries and their DuckDB SQL side by side and compare row
count, column names and an order-insensitive hash of the values.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def digest(columns, rows) -> tuple[int, list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), sorted(columns), h


def spark_digest(df):
    rows = [tuple(r) for r in df.collect()]
    return digest(df.columns, rows)


def duck_digest(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return digest(cols, cur.fetchall())


def compare(spark, con, key, sf_dir, queries, oracle):
    t0 = time.time()
    s = spark_digest(queries[key](spark, sf_dir))
    t1 = time.time()
    if key not in oracle:
        return {"key": key, "rows": s[0], "check": "rows-only", "spark_s": round(t1 - t0, 2)}
    d = duck_digest(con, oracle[key])
    res = {"key": key, "rows": s[0], "oracle_rows": d[0], "cols_match": s[1] == d[1],
           "hash_match": s[2] == d[2], "spark_s": round(t1 - t0, 2)}
    if s[1] != d[1]:
        res["spark_cols_only"] = sorted(set(s[1]) - set(d[1]))
        res["oracle_cols_only"] = sorted(set(d[1]) - set(s[1]))
    return res


def main(argv):
    from ledgerlens.session import build_session
    import __spark_entry__ as entry
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for key in keys or list(queries):
        try:
            res = compare(spark, con, key, sf_dir, queries, oracle)
        except Exception as exc:  # report and go on
            res = {"key": key, "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        ok = res.get("check") == "rows-only" or (res.get("hash_match") and res.get("cols_match")
                                                 and res.get("rows") == res.get("oracle_rows"))
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(res), flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
