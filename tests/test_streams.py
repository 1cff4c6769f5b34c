"""Streams with state: repeats and late rows as outcomes, feeds that miss their deadline."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterline.config import default_config
from meterline.functions import joins
from meterline.operators import filechecks as fc
from meterline.operators import rowchecks as rc
from meterline.streaming import feeds, stateful

CONFIG = default_config()
RULES = CONFIG.feeds["energy_consumption"]
READING = "file_name string, record_id string, site_id string, reading_date string, energy_kwh string, emissions_co2e string, row_index long, ts timestamp"


def reading(i, record, day, site="S1", energy="1.5", name="a.csv", hour=0):
    return (name, record, site, f"2026-01-{day:02d}", energy, "0.5", i, dt.datetime(2026, 1, day, hour))


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def judge(spark, folder, delay="2 days"):
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = stateful.write_judged(stateful.judged(stream, RULES, "ts", delay=delay), str(folder / "out"), str(folder / "state"))
    query.awaitTermination()
    rows = spark.read.parquet(str(folder / "out")).select("row_index", "outcome", "rejection_reason").collect()
    return {r.row_index: (r.outcome, r.rejection_reason) for r in rows}, len(rows)


FIRST = [
    reading(3, "R1", 1), reading(1, "R1", 1), reading(2, "R2", 1, site=""), reading(4, "R2", 1), reading(5, "", 1), reading(6, "", 1),
    reading(7, "R3", 1, energy="-4"), reading(8, "R3", 1), reading(9, "R4", 1, energy="1d"), reading(10, "R1", 1, name="b.csv"),
]


def test_one_micro_batch_equals_a_batch(spark, tmp_path):
    put(spark, tmp_path / "in", FIRST, READING)
    got, n = judge(spark, tmp_path)
    staged = rc.validate_rows(spark.createDataFrame(FIRST, READING).withColumn("dataset", F.lit(RULES.name)), [RULES]).collect()
    wanted = {r.row_index: ("rejected" if r.rejection_reason else "accepted", r.rejection_reason) for r in staged}
    assert got == wanted and n == len(FIRST)
    assert sum(reason == rc.DUPLICATE for _, reason in got.values()) == 3


def test_repeats_and_late_rows_across_micro_batches(spark, tmp_path):
    put(spark, tmp_path / "in", FIRST, READING)
    judge(spark, tmp_path)
    # A restart: R1 of b.csv again, a new key, and time moves on to day 10.
    put(spark, tmp_path / "in", [reading(11, "R1", 2, name="b.csv"), reading(12, "R5", 10)], READING)
    judge(spark, tmp_path)
    # The watermark is day 8: day 5 is late even with a new key, R5 repeats, R1 of day 1 is forgotten.
    put(spark, tmp_path / "in", [reading(13, "R6", 5), reading(14, "R5", 10), reading(15, "R1", 9), reading(16, "R1", 9, energy="x")], READING)
    got, n = judge(spark, tmp_path)
    assert n == len(FIRST) + 6 == len(got)
    assert {i: got[i] for i in range(11, 17)} == {
        11: ("rejected", rc.DUPLICATE), 12: ("accepted", None), 13: ("late", None), 14: ("rejected", rc.DUPLICATE), 15: ("accepted", None),
        16: ("rejected", rc.DUPLICATE),
    }
    assert {o for o, _ in got.values()} == {"accepted", "rejected", "late"}


@pytest.mark.parametrize("small", [True, False])
def test_outcomes_come_from_joins_with_state_under_the_micro_batch(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr(stateful, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_rows=0: False)
    put(spark, tmp_path / "in", [*FIRST, reading(12, "R9", 1), reading(12, "R9", 1)], READING)
    stream = stateful.judged(spark.readStream.schema(READING).parquet(str(tmp_path / "in")), RULES, "ts")
    # A call of Python for each key took too long for millions of keys.
    assert "TransformWithState" not in stream._jdf.queryExecution().logical().toString()
    got, n = judge(spark, tmp_path)
    assert n == len(FIRST) + 2 and sum(reason == rc.DUPLICATE for _, reason in got.values()) >= 3
    rows = spark.read.parquet(str(tmp_path / "out")).filter("row_index = 12").select("outcome").collect()
    assert sorted(r.outcome for r in rows) == ["accepted", "rejected"]
    put(spark, tmp_path / "in", [reading(21, "R1", 3), reading(22, "R7", 3), reading(23, "R7", 3), reading(24, "R8", 9)], READING)
    wanted = {21: ("rejected", rc.DUPLICATE), 22: ("accepted", None), 23: ("rejected", rc.DUPLICATE), 24: ("accepted", None)}
    got, n = judge(spark, tmp_path)
    assert n == len(FIRST) + 6 and {i: got[i] for i in wanted} == wanted
    # Repeated after a stop before its commit, a micro-batch gives what it gave.
    for at in (tmp_path / "state" / "commits").glob("*1*"):
        at.unlink()
    again, n = judge(spark, tmp_path)
    assert n == len(FIRST) + 6 and {i: again[i] for i in wanted} == wanted
    # The watermark is day 7: the first rows of the first micro-batch are gone, R8 of the second still counts.
    put(spark, tmp_path / "in", [reading(31, "R1", 8), reading(32, "R8", 8), reading(33, "R8", 6)], READING)
    got, _ = judge(spark, tmp_path)
    assert {i: got[i] for i in (31, 32, 33)} == {31: ("accepted", None), 32: ("rejected", rc.DUPLICATE), 33: ("late", None)}
    assert sorted(p.name for p in (tmp_path / "state" / "judged" / "firsts").iterdir()) == ["epoch=1", "epoch=2"]


def count(spark, folder):
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")).withColumn("dataset", F.lit("energy"))
    feeds.count_quality(stream, RULES, "ts", str(folder / "out"), str(folder / "state"), ["row_index"]).awaitTermination()
    scores = {str(r.load_date): (r.total_records, r.valid_records, r.quality_score) for r in feeds.counted_quality(spark, str(folder / "out")).collect()}
    late = spark.read.schema("row_index long, epoch long").parquet(str(folder / "out" / "late")).collect()
    return scores, sorted(r.row_index for r in late)


def test_counted_and_late_readings_add_up(spark, tmp_path):
    put(spark, tmp_path / "in", [reading(1, "R1", 3), reading(2, "R2", 3, site=""), reading(3, "R3", 2)], READING)
    assert count(spark, tmp_path) == ({"2026-01-03": (2, 1, 50.0), "2026-01-02": (1, 1, 100.0)}, [])
    # The watermark is day 2: day 1 is late, day 2 itself is not.
    put(spark, tmp_path / "in", [reading(4, "R4", 1), reading(5, "R5", 2), reading(6, "R6", 9)], READING)
    wanted = {"2026-01-03": (2, 1, 50.0), "2026-01-02": (2, 2, 100.0), "2026-01-09": (1, 1, 100.0)}
    assert count(spark, tmp_path) == (wanted, [4])
    assert count(spark, tmp_path) == (wanted, [4])
    put(spark, tmp_path / "in", [reading(7, "R7", 3), reading(8, "R8", 8)], READING)
    scores, late = count(spark, tmp_path)
    assert late == [4, 7] and sum(total for total, _, _ in scores.values()) + len(late) == 8


DAY = "batch_id string, business_date string, as_of timestamp"
FILE = "file_name string, received_at timestamp"


def sense(spark, folder):
    days = spark.readStream.schema(DAY).parquet(str(folder / "days"))
    files = spark.readStream.schema(FILE).parquet(str(folder / "files"))
    log = spark.createDataFrame([], "dataset string, batch_id string, file_status string, expected_arrival_at timestamp, created_at timestamp")
    query = stateful.write_sensor_checks(stateful.feed_sensor(days, files, CONFIG), log, str(folder / "out"), str(folder / "state"))
    query.awaitTermination()
    rows = spark.read.parquet(str(folder / "out")).select("check_name", "dataset", "business_date", "status", "actual_value").collect()
    return sorted(tuple(r) for r in rows)


def test_sensor_reports_each_feed_once(spark, tmp_path):
    at = dt.datetime
    put(spark, tmp_path / "days", [("B-20260105-01", "2026-01-05", at(2026, 1, 5, 8))], DAY)
    put(spark, tmp_path / "files", [("energy_consumption_2026-01-05.csv", at(2026, 1, 5, 6, 40)), ("stray.csv", at(2026, 1, 5, 6))], FILE)
    arrived = ("sla_check", "energy_consumption", "2026-01-05", "PASS", "on time")
    assert sense(spark, tmp_path) == [arrived]
    # No deadline has passed by eight o'clock. The next day's row moves time on: two feeds of the first day are missing.
    put(spark, tmp_path / "days", [("B-20260106-01", "2026-01-06", at(2026, 1, 6, 0))], DAY)
    missing = [("file_arrival_check", d, "2026-01-05", "FAIL", "not received") for d in ("carbon_emissions", "site_master")]
    assert sense(spark, tmp_path) == [*missing, arrived]
    # Restarts say nothing again, a late file is late, and a file may come before its day is announced.
    assert sense(spark, tmp_path) == [*missing, arrived]
    put(spark, tmp_path / "files", [("carbon_emissions_2026-01-05.csv", at(2026, 1, 6, 1)), ("site_master_2026-01-07.csv", at(2026, 1, 6, 2))], FILE)
    late = ("sla_check", "carbon_emissions", "2026-01-05", "FAIL", "late arrival")
    assert sense(spark, tmp_path) == sorted([*missing, arrived, late])
    put(spark, tmp_path / "days", [("B-20260107-01", "2026-01-07", at(2026, 1, 7, 0))], DAY)
    got = sense(spark, tmp_path)
    second = [("file_arrival_check", d, "2026-01-06", "FAIL", "not received") for d in CONFIG.manifest]
    early = ("sla_check", "site_master", "2026-01-07", "PASS", "on time")
    assert got == sorted([*missing, arrived, late, early, *second])


def test_sensor_equals_the_batch_checks(spark, tmp_path):
    at = dt.datetime
    days = [(f"B-2026020{d}-01", f"2026-02-0{d}", at(2026, 2, d, 23)) for d in range(1, 6)]
    files = [(f"{name}_2026-02-0{d}.csv", at(2026, 2, d, (d * 5 + k * 7) % 23, 1)) for d in range(1, 6) for k, name in enumerate(CONFIG.manifest) if (d + k) % 3]
    put(spark, tmp_path / "days", days, DAY)
    put(spark, tmp_path / "files", files, FILE)
    got = sense(spark, tmp_path)
    matched = fc.match_files(fc.expected_feeds(spark.createDataFrame(days, DAY), CONFIG), spark.createDataFrame(files, FILE))
    log = spark.createDataFrame([], "dataset string, batch_id string, file_status string, expected_arrival_at timestamp, created_at timestamp")
    wanted = fc.sla_checks(matched).unionByName(fc.arrival_checks(matched, log)).select("check_name", "dataset", "business_date", "status", "actual_value")
    assert got == sorted(tuple(r) for r in wanted.collect())


@pytest.mark.parametrize("text, wanted", [("2 days", 172_800_000), ("1 hour", 3_600_000), ("30 seconds", 30_000)])
def test_millis(text, wanted):
    assert stateful.millis(text) == wanted


def test_a_recipe_builds_its_columns_once(spark):
    made = []

    def make(df):
        made.append(df)
        return df.withColumns({"b": F.col("a") * 2, "batch": F.lit("")}).filter("b > 2").groupBy("b").agg(F.count(F.lit(1)).alias("n"))

    recipe = feeds.Recipe(make)
    for rows, wanted in ([1, 2, 2], {4: 2}), ([3, 5, 5], {6: 1, 10: 2}), ([], {}):
        got = recipe(spark.createDataFrame([(a,) for a in rows], "a long")).collect()
        assert {r.b: r.n for r in got} == wanted
    assert len(made) == 1
    with pytest.raises(RuntimeError, match="last result"):
        feeds.Recipe(lambda df: [df.filter("a > 1"), df.filter("a > 2")][1])(spark.range(3).toDF("a"))
