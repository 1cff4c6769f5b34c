"""Type-2 history in any order of snapshots, rules on any column, anomalies of very large readings."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from meterline.config import FeedRules
from meterline.operators import rowchecks as rc
from meterline.operators import sites
from meterline.operators import warehouse as wh

SNAPSHOT = "site string, country string, kind string"


def plain_history(snapshots):
    """Versions per key from all deliveries, by day."""
    out = set()
    for key in {k for rows in snapshots.values() for k, *_ in rows}:
        seen = [(day, dict((r[0], r[1:]) for r in rows)[key]) for day, rows in sorted(snapshots.items()) if key in [r[0] for r in rows]]
        starts = [(day, v) for n, (day, v) in enumerate(seen) if n == 0 or seen[n - 1][1] != v]
        for n, (day, v) in enumerate(starts):
            end = str(dt.date.fromisoformat(starts[n + 1][0]) - dt.timedelta(1)) if n + 1 < len(starts) else None
            out.add((key, *v, day, end, end is None))
    return out


def applied(spark, order, snapshots):
    history = None
    for day in order:
        frame = spark.createDataFrame(snapshots[day], SNAPSHOT)
        fields = ["country", "kind"]
        history = wh.scd2_start(frame, "site", fields, day) if history is None else wh.scd2_apply(history, frame, "site", fields, day)
        history = spark.createDataFrame(history.collect(), history.schema)
    rows = history.collect()
    assert len(rows) == len({(r.site, r.valid_from) for r in rows})
    assert all(r.valid_to is None or r.valid_to >= r.valid_from for r in rows)
    return {(r.site, r.country, r.kind, str(r.valid_from), str(r.valid_to) if r.valid_to else None, r.is_current) for r in rows}


def test_history_is_the_same_in_any_order(spark):
    snapshots = {
        "2026-01-01": [("A", "FR", None), ("B", "DE", "x")],
        "2026-01-03": [("A", "FR", None), ("C", "IT", "z")],
        "2026-01-05": [("A", "ES", None), ("B", "DE", "x")],
        "2026-01-09": [("A", "FR", None), ("B", None, "x"), ("C", "IT", "z")],
    }
    wanted = plain_history(snapshots)
    rng = random.Random(1)
    orders = rng.sample(list(itertools.permutations(snapshots)), 4)
    for order in [tuple(snapshots), *orders]:
        # Every second snapshot comes twice.
        assert applied(spark, [d for n, d in enumerate(order) for _ in range(1 + n % 2)], snapshots) == wanted


def test_second_snapshot_of_a_day_replaces_the_first(spark):
    history = wh.scd2_start(spark.createDataFrame([("A", "FR", "x"), ("B", "DE", "x")], SNAPSHOT), "site", ["country", "kind"], "2026-02-01")
    again = wh.scd2_apply(history, spark.createDataFrame([("A", "ES", "x")], SNAPSHOT), "site", ["country", "kind"], "2026-02-01")
    assert sorted((r.site, r.country, str(r.valid_from), r.valid_to) for r in again.collect()) == [("A", "ES", "2026-02-01", None), ("B", "DE", "2026-02-01", None)]


def test_rules_on_any_column(spark):
    rules = FeedRules("meters", ["record_id", "reading_date", "volts"], ["record_id"], ["record_id", "meter"], {"volts": {"min": 0, "max": 400}, "energy_kwh": {"min": 0}})
    rows = [("1", "m", "230", "1"), ("2", " ", "230", "1"), ("3", "m", "-1", "1"), ("4", "m", "401", "-1"), ("5", "m", "high", "1"), ("6", "m", "", "1"), ("7", "m", "400.0", "1")]
    feed = spark.createDataFrame(rows, "record_id string, meter string, volts string, energy_kwh string").select(
        "*", F.lit("2026-01-01").alias("reading_date"), F.lit("meters").alias("dataset"), F.lit("f").alias("file_name"),
        F.lit("B-20260101-01").alias("batch_id"), F.col("record_id").cast("long").alias("row_index"),
    )
    checked = rc.validate_rows(feed, [rules])
    assert {r.record_id: r.rejection_reason for r in checked.collect()} == {
        "1": None, "2": "null:meter", "3": "range_violation:volts=-1", "4": "range_violation:energy_kwh=-1", "5": "invalid_value:volts", "6": None, "7": None,
    }
    stats = rc.load_stats(checked, ["dataset"], [rules]).first()
    assert (stats.total_rejected, stats.range_violations, stats.nulls_by_column) == (4, 3, {"meter": 1})


@pytest.mark.parametrize("reading", [9e14, 1e15])
def test_anomalies_of_very_large_readings(spark, reading):
    rows = [("S", "2026-01-01", reading)] * 400 + [("S", "2026-01-02", reading)] * 400 + [("S", "2026-01-03", 1.0)] + [("T", "2026-01-01", 1.0), ("T", "2026-01-02", 3.0), ("T", "2026-01-03", 900.0)]
    fact = spark.createDataFrame(rows, "site_id string, day string, energy_kwh double").withColumn("reading_date", F.to_date("day"))
    got = {(r.site_id, str(r.reading_date)): r for r in sites.anomalies(fact).collect()}
    assert got["S", "2026-01-03"].avg_kwh == reading
    assert (got["T", "2026-01-03"].avg_kwh, got["T", "2026-01-03"].stddev_kwh, got["T", "2026-01-03"].anomaly_type) == (2.0, 1.41, "HIGH")
