"""Lineage: paths and chains of steps against a plain loop over the edges."""

from __future__ import annotations

import random

import pytest
from compare import plan_of
from pyspark.sql import functions as F

from meterline.functions.joins import next_mark
from meterline.operators import warehouse as wh

EDGE = "stage string, edge_number long, source_id string, target_id string, transformation_logic string"


def plain_trace(start, stages):
    path, chain = [start], []
    for stage in stages:
        for name, _, source, target, logic in sorted(stage, key=lambda e: e[1]):
            if path[-1] == source or path[-1].startswith(source.replace("*", "", 1)):
                path.append(target)
                chain.append(f"{name}: {logic}")
    return path, chain


def traced(spark, starts, stages, **options):
    frames = [spark.createDataFrame(stage, EDGE) for stage in stages]
    frame = spark.createDataFrame([(s,) for s in starts], "record string")
    return {r.record: (r.path, r.chain) for r in wh.lineage_trace(frame, frames, **options).collect()}


def test_trace_follows_equal_prefix_and_wildcard_sources(spark):
    stages = [
        [("S", 0, "A-1", "B-1", "first"), ("S", 1, "A-1", "B-2", "never"), ("S", 2, "B-*", "B-9", "again"), ("S", 3, "A-*", "C-1", "other")],
        [("E", 0, "B-9", "D-*", "up"), ("E", 1, "D-*x", "F-1", "star inside"), ("E", 2, "D-", "F-2", "prefix")],
        [("M", 5, "*", "Z", "all")],
    ]
    starts = ["A-1", "A-10", "A-2", "B-77", "nothing", "D-x1", ""]
    got = traced(spark, starts, stages)
    assert got == {s: plain_trace(s, stages) for s in starts}
    assert got["A-1"][0] == ["A-1", "B-1", "B-9", "D-*", "F-2", "Z"]


def test_trace_equals_a_loop_on_random_edges(spark):
    rng = random.Random(11)

    def name():
        return "".join(rng.choice("ab*") for _ in range(rng.randint(1, 4)))

    for _ in range(3):
        stages = [[("S", n, name(), name(), f"{k}.{n}") for n in range(rng.randint(1, 6))] for k in range(3)]
        starts = sorted({name() for _ in range(25)})
        assert traced(spark, starts, stages) == {s: plain_trace(s, stages) for s in starts}


def test_long_chains_raise(spark):
    stage = [("S", n, f"N{n:03d}", f"N{n + 1:03d}", "hop") for n in range(12)]
    assert traced(spark, ["N000"], [stage])["N000"][0][-1] == "N012"
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        traced(spark, ["N000"], [stage], max_hops=5)


def test_next_mark_of_a_hot_key(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"), "id", (F.col("id") % 7 == 0).alias("hit"))
    got = {(r.key, r.id): r.next.id if r.next else None for r in next_mark(rows, "key", ["id"], F.col("hit"), "next").collect()}
    by_key = {}
    for key, i in got:
        by_key.setdefault(key, []).append(i)
    for key, ids in by_key.items():
        for i in ids:
            assert got[key, i] == min((j for j in ids if j > i and j % 7 == 0), default=None)


def test_next_mark_sums_no_shrinking_frame(spark):
    rows = spark.createDataFrame([("hot", n, f"r{n}", n % 3 == 0) for n in (4, 1, 3, 2, 7, 6)] + [("hot", None, "none", False)], "key string, at long, id string, hit boolean")
    found = next_mark(rows, "key", ["at", "id"], F.col("hit"), "next")
    # Spark sums up a frame that ends with its partition anew for every row, so a key's rows cost their square.
    assert "unboundedfollowing" not in plan_of(found).lower()
    got = {r.id: r.next.id if r.next else None for r in found.collect()}
    assert got == {"none": "r3", "r1": "r3", "r2": "r3", "r3": "r6", "r4": "r6", "r6": None, "r7": None}
