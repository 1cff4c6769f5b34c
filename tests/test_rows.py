"""Row checks: one case per rule that is easy to get wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterline.config import default_config
from meterline.functions.numbers import half_up, half_up_int, number_text, pad_left, parse_number
from meterline.functions.times import batch_date, strict_date
from meterline.operators import rowchecks as rc

COLUMNS = "row_index long, record_id string, site_id string, reading_date string, energy_kwh string, emissions_co2e string"
CONFIG = default_config()


def feed(spark, rows, dataset="energy_consumption"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)
    return df.withColumn("file_name", F.lit("f.csv")).withColumn("dataset", F.lit(dataset)).withColumn("batch_id", F.lit("B-1"))


def reasons(spark, rows, dataset="energy_consumption"):
    out = rc.validate_rows(feed(spark, rows, dataset), CONFIG.feeds.values())
    return [r.rejection_reason for r in out.orderBy("row_index").collect()]


def test_first_failing_test_is_the_reason(spark):
    day = "2026-01-31"
    rows = [
        ("A", "S", day, "1", "1"),
        ("", "", "bad", "x", "x"),  # first mandatory column in configured order
        ("B", " ", day, "1", "1"),
        ("A", "S", "bad", "x", "1"),  # repeated before date and numbers
        ("C", "S", "2026-02-31", "x", "1"),
        ("D", "S", "2026-2-3", "1", "1"),
        ("E", "S", day, "1d", "-1"),
        ("F", "S", day, "-12.50", "-1"),
        ("G", "S", day, "1", "-7"),
        ("H", "S", day, "1", "NaN"),
        ("I", "S", day, "1", ""),  # emissions are not mandatory here
        ("J", "S", day, "", "1"),
    ]
    assert reasons(spark, rows) == [
        None, "null:record_id", "null:site_id", "duplicate_record_id", "invalid_date_format", "invalid_date_format",
        "invalid_value:energy_kwh", "range_violation:energy_kwh=-12.5", "range_violation:emissions_co2e=-7",
        "invalid_value:emissions_co2e", None, "null:energy_kwh",
    ]


def test_rejected_rows_count_as_seen(spark):
    rows = [("A", "S", "bad", "1", "1"), ("A", "S", "2026-01-01", "1", "1"), ("B", "", "2026-01-01", "1", "1"), ("B", "S", "2026-01-01", "1", "1")]
    assert reasons(spark, rows) == ["invalid_date_format", "duplicate_record_id", "null:site_id", "duplicate_record_id"]


def test_repeats_are_per_file(spark):
    df = feed(spark, [("A", "S", "2026-01-01", "1", "1"), ("A", "S", "2026-01-01", "1", "1")])
    other = df.withColumn("file_name", F.concat(F.lit("f"), F.col("row_index").cast("string")))
    assert rc.validate_rows(other, CONFIG.feeds.values()).filter("rejection_reason is not null").count() == 0


def test_carbon_needs_emissions_and_ignores_energy(spark):
    rows = [("A", "S", "2026-01-01", "-5", "1"), ("B", "S", "2026-01-01", "1", "")]
    assert reasons(spark, rows, "carbon_emissions") == [None, "null:emissions_co2e"]


def test_site_master_uses_its_own_key_and_date(spark):
    rows = [("S1", "Plant", "DE", "2026-01-01"), ("S1", "Plant", "DE", "2026-01-01"), ("S2", "", "DE", "2026-01-01"), ("", "X", "DE", "x"), ("S3", "X", "DE", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index long, site_id string, site_name string, country string, effective_from_date string")
    df = df.withColumn("file_name", F.lit("s.csv")).withColumn("dataset", F.lit("site_master")).withColumn("batch_id", F.lit("B"))
    out = rc.validate_rows(df, CONFIG.feeds.values())
    got = out.orderBy("row_index").collect()
    assert [r.rejection_reason for r in got] == [None, "duplicate_record_id", "null:site_name", "null:site_id", "invalid_date_format"]
    staged = rc.stage_sites(out).orderBy("row_index").collect()
    assert [r.site_id for r in staged] == ["S1", "S1", "S2", "UNKNOWN", "S3"]
    assert str(staged[4].effective_from_date) == "2023-01-01"
    assert str(staged[2].effective_from_date) == "2023-01-01"  # the date test was not reached


def test_staging_keeps_numbers_only_as_far_as_tests_got(spark):
    rows = [("A", "S", "2026-01-01", "5", "2"), ("B", "", "2026-01-01", "5", "2"), ("C", "S", "2026-01-01", "-5", "2"), ("", "S", "2026-01-01", "5", "-2")]
    out = rc.validate_rows(feed(spark, rows), CONFIG.feeds.values())
    staged = rc.stage_readings(out, CONFIG.feeds.values()).orderBy("row_index").collect()
    assert [(r.record_id, r.energy_kwh, r.emissions_co2e) for r in staged] == [
        ("A", 5.0, 2.0), ("B", None, None), ("C", -5.0, None), ("UNKNOWN-5", None, None),
    ]
    evidence = {r.record_id: r for r in rc.rejected_rows(out).collect()}
    assert evidence["(row 5)"].energy_kwh == 5.0 and evidence["(row 5)"].emissions_co2e == -2.0
    assert evidence["B"].site_id is None


def test_load_stats_add_up(spark):
    rows = [("A", "S", "2026-01-01", "5", "2"), ("B", "", "2026-01-01", "5", "2"), ("C", "S", "x", "-5", "2"), ("A", "S", "2026-01-01", "q", "-2"), ("D", "S", "2026-01-01", "q", "2")]
    out = rc.validate_rows(feed(spark, rows), CONFIG.feeds.values())
    s = rc.load_stats(out, ["dataset"], CONFIG.feeds.values()).first()
    assert (s.total_read, s.total_valid, s.total_rejected) == (5, 1, 4)
    assert (s.duplicates, s.invalid_dates, s.range_violations, s.nulls_by_column) == (1, 1, 1, {"site_id": 1})


def test_issue_rules_tell_missing_from_null(spark):
    df = spark.createDataFrame([(None,), (0.0,), (-1.0,), (2.0,)], "emissions_co2e double")
    got = rc.collect_issues(df, "carbon_emissions").collect()
    assert [[(i.issue_type, i.suggested_value) for i in r.issues] for r in got] == [
        [("OUT_OF_RANGE", None)], [("OUT_OF_RANGE", None)], [("OUT_OF_RANGE", "0")], [],
    ]
    absent = rc.collect_issues(df.select(F.lit(1).alias("x")), "carbon_emissions").first()
    assert absent.issues[0].issue_type == "NULL_VALUE"
    energy = spark.createDataFrame([("", None), ("S", -1.0), ("S", 0.0)], "site_id string, energy_kwh double")
    kinds = [[i.issue_type for i in r.issues] for r in rc.collect_issues(energy, "energy_consumption").collect()]
    assert kinds == [["NULL_VALUE", "NULL_VALUE"], ["OUT_OF_RANGE"], []]
    sites = spark.createDataFrame([("S", "", "DE"), ("S", "N", "DE")], "site_id string, site_name string, country string")
    assert [r.accepted for r in rc.collect_issues(sites, "site_master").collect()] == [False, True]


@pytest.mark.parametrize(
    "text, number",
    [("1", 1.0), ("-2.50", -2.5), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("+4", 4.0), ("1d", None), ("1f", None), ("NaN", None), ("inf", None), ("0x1F", None), ("", None), ("1,5", None)],
)
def test_plain_numbers(spark, text, number):
    assert spark.range(1).select(parse_number(F.lit(text)).alias("n")).first().n == number


@pytest.mark.parametrize("value, text", [(-12.5, "-12.5"), (-12.0, "-12"), (0.25, "0.25"), (-123456789.0, "-123456789"), (100.0, "100"), (-0.001, "-0.001")])
def test_number_text(spark, value, text):
    assert spark.range(1).select(number_text(F.lit(value)).alias("t")).first().t == text


def test_rounding_goes_towards_plus_infinity(spark):
    r = spark.range(1).select(half_up(F.lit(-2.5), 0).alias("a"), half_up_int(F.lit(2.5)).alias("b"), half_up(F.lit(1.125), 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (-2.0, 3, 1.13)


def test_dates_and_ids(spark):
    texts = ["2026-01-31", "2026-02-31", "2026-2-3", "20260131", "2026-01-31 10:00:00", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d is not None for r in df.select(strict_date("t").alias("d")).collect()] == [True, False, False, False, False, False]
    r = spark.range(1).select(
        batch_date(F.lit("B-20260131-02")).alias("a"), batch_date(F.lit("nope")).alias("b"), pad_left(F.lit(7), 6).alias("c"),
        pad_left(F.lit(12345678), 6).alias("d"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == ("2026-01-31", "unknown", "000007", "12345678")


def test_measures_keep_small_digits_and_refuse_huge_numbers(spark):
    from meterline.functions.numbers import exact_sum

    small = spark.range(1000).withColumn("v", F.lit(0.004))
    assert float(small.agg(exact_sum("v")).first()[0]) == 4.0
    texts = spark.createDataFrame([("-1e25",), ("1e17",), ("12.5",)], "t string")
    assert [row[0] for row in texts.select(parse_number("t")).collect()] == [None, None, 12.5]
    assert spark.createDataFrame([(-1e25,)], "v double").select(number_text("v")).first()[0].startswith("-")


def test_batches_are_ordered_by_number(spark):
    from meterline.operators.warehouse import dim_upsert, SITE_FIELDS

    fields = ", ".join(f"{f} string" for f in SITE_FIELDS)
    staged = spark.createDataFrame(
        [(b, "S1", 0, "VALID", *[b] * len(SITE_FIELDS)) for b in ("B-20260101-99", "B-20260101-100")],
        f"batch_id string, site_id string, row_index long, validation_status string, {fields}",
    )
    current = spark.createDataFrame([], f"site_key long, site_id string, {fields}, loaded_batch string, active_flag boolean")
    assert dim_upsert(current, staged).first().loaded_batch == "B-20260101-100"
