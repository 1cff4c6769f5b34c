"""Skew-proof joins and running totals against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meterline.functions import joins


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    # One key holds a third of the rows, one key is missing from the dimension, some are null.
    keys = ["hot"] * 400 + [f"k{rng.randrange(60)}" for _ in range(360)] + ["lost"] * 300 + [None] * 140
    rng.shuffle(keys)
    return [(i, k, rng.randrange(100)) for i, k in enumerate(keys)]


@pytest.mark.parametrize("max_rows", [1000, 0])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_both_paths(spark, skewed, monkeypatch, how, max_rows):
    monkeypatch.setattr(joins, "MAX_HOT_KEYS", 5)
    rows = spark.createDataFrame(skewed, "i long, k string, v long")
    dim_rows = [("hot", "H")] + [(f"k{n}", f"name{n}") for n in range(50)] + [("unused", "U")]
    dim = spark.createDataFrame(dim_rows, "k string, name string")
    names = dict(dim_rows)
    got = joins.lookup_join(rows, dim, ["k"], how, ["i"], max_rows=max_rows)
    if how in ("left", "inner"):
        want = Counter((i, k, v, names.get(k)) for i, k, v in skewed if how == "left" or k in names)
        assert Counter((r.i, r.k, r.v, r.name) for r in got.collect()) == want
    else:
        want = Counter((i, k, v) for i, k, v in skewed if (k in names) == (how == "left_semi"))
        assert Counter((r.i, r.k, r.v) for r in got.collect()) == want


def test_hot_rows_are_spread_over_the_shuffle(spark, skewed, monkeypatch):
    monkeypatch.setattr(joins, "MAX_HOT_KEYS", 5)
    rows = spark.createDataFrame(skewed, "i long, k string, v long")
    lookup = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("top"))
    joined = joins.spread_left_join(rows, lookup, ["k"], "w", ["i"])
    top = defaultdict(int)
    for _, k, v in skewed:
        if k is not None:
            top[k] = max(top[k], v)
    assert {(r.i, r.top) for r in joined.collect()} == {(i, top.get(k)) for i, k, _ in skewed}
    # Neither the hot key nor rows without a key may land on one reducer of the salted join.
    salts = spark.range(400).select((F.pmod(F.xxhash64("id"), F.lit(joins.SPREAD)) + 1).alias("s")).distinct().count()
    assert salts > 350
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_mark_repeats(spark, skewed, monkeypatch, broadcast_rows):
    monkeypatch.setattr(joins, "MAX_HOT_KEYS", 5)
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_rows=0: broadcast_rows > 0)
    rows = spark.createDataFrame([(i, k if i % 17 else "", v) for i, k, v in skewed], "i long, k string, v long")
    seen, want = set(), {}
    for i, k, _ in skewed:
        k = k if i % 17 else ""
        want[i] = bool(k) and k in seen
        seen.add(k)
    got = {r.i: r.again for r in joins.mark_repeats(rows, ["k"], "i", "again").collect()}
    assert got == want


def test_running_total_and_numbers(spark, skewed):
    rows = spark.createDataFrame(skewed, "i long, k string, v long")
    total, number, want = defaultdict(int), defaultdict(int), {}
    for i, k, v in sorted(skewed, key=lambda r: (-r[2], r[0])):
        total[k] += v
        number[k] += 1
        want[i] = (total[k], number[k])
    order = [F.col("v").desc(), F.col("i").asc()]
    summed = joins.running_total(rows, ["k"], order, F.col("v"), "upto")
    counted = joins.number_rows(rows, ["k"], order, "n")
    got = {r.i: (r.upto, r.n) for r in summed.join(counted.select("i", "n"), "i").collect()}
    assert got == want


def test_number_rows_over_everything(spark, skewed):
    rows = spark.createDataFrame(skewed, "i long, k string, v long")
    got = joins.number_rows(rows, [], [F.col("i").desc()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(skewed) + 1))
    assert [r.i for r in got] == list(range(len(skewed) - 1, -1, -1))
