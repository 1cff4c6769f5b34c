"""Compare registered queries with their SQL twins: `python tests/compare.py [sf_dir] [name-prefix ...]`."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    return v


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def mismatch(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    for word in FORBIDDEN:
        if word in plan_of(df):
            return f"plan holds {word}"
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = normal(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    kinds = {"bigint": {"NUMBER", "BIGINT"}, "double": {"NUMBER", "DOUBLE"}, "string": {"STRING", "VARCHAR"}}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind not in kinds or types[f.name] not in kinds[kind]:
            return f"type of {f.name}: {kind} against {types[f.name]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"got {g}\n    want {w}"
    return None


def main() -> int:
    from meterline.plans.registry import ORACLE, QUERIES
    from meterline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = mismatch(spark, con, name, query, ORACLE[name], sf_dir)
            else:
                problem = None
                print(f"      rows only: {len(query(spark, sf_dir).collect())}")
        except Exception as err:
            problem = f"{type(err).__name__}: {str(err)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
