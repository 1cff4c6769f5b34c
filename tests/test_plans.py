"""Plans that must hold at any size: no row-level single partition, trimmed top-N, pushed filters."""

from __future__ import annotations

import pytest
from compare import plan_of
from pyspark.sql import functions as F

from meterline.operators import runbook as rb
from meterline.operators import sites as st
from meterline.plans import roles
from meterline.plans.registry import QUERIES
from meterline.sources import sinks

ROW_LEVEL = [
    "accepted_readings_by_day", "c2_duplicate_pk", "c5_first_reason", "c6_staging_project", "c7_load_stats", "d5_referential_integrity",
    "e2_fact_load", "e4_fact_merge", "e5_enrich", "e6_mart_daily_energy", "f1_rowcount_recon", "f5_layer_recon", "g2_time_series", "g3_anomalies",
    "g4_site_totals", "g5_site_sparkline", "g7_latest_readings", "g7_site_detail", "h10_daily_ops_report", "h12_rolling_pass_rate",
    "h13_check_history", "h21_batch_lineage", "h22_batch_compare", "i9_likely_causes", "j9_fact_duplicates",
]


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_rows_never_meet_in_one_partition(spark, sf, name):
    assert "SinglePartition" not in plan_of(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["g7_latest_readings", "h13_check_history", "b10_recent_deliveries", "i9_likely_causes"])
def test_top_n_per_key_is_trimmed_before_the_shuffle(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    trimmed = "WindowGroupLimit" in plan
    # likely causes reads its trimmed table back, so its window ran before this plan
    assert trimmed or name == "i9_likely_causes"


def test_filters_reach_the_written_fact(spark, sf, tmp_path):
    path = str(tmp_path / "fact")
    fact = roles.fact(spark, sf).withColumn("batch_id", F.concat(F.lit("B-"), F.date_format("reading_date", "yyyy")))
    sinks.write_batches(fact, path)
    stored = spark.read.schema(fact.schema).parquet(path)
    plan = plan_of(st.time_series(stored, "1996-01-01", "1996-06-30"))
    assert "GreaterThanOrEqual(reading_date,1996-01-01)" in plan
    assert "side" not in plan.split("ReadSchema")[1]
    one = plan_of(rb.files_of_batch(stored.withColumnRenamed("source_file_name", "file_name"), "B-1996"))
    assert "PartitionFilters: [isnotnull(batch_id" in one


def test_big_totals_sum_exactly(spark):
    # A third of the rows share one site; doubles would drift, decimals do not.
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("site_id"),
        F.lit(0.1).alias("energy_kwh"), F.lit(0.2).alias("emissions_co2e"), F.lit("2026-01-01").cast("date").alias("reading_date"),
    )
    dim = rows.select("site_id").distinct().withColumns({c: F.lit("x") for c in ("site_name", "country", "region", "site_type")}).withColumn("active_flag", F.lit(True))
    top = st.site_totals(rows, dim, 1).first()
    assert (top.site_id, top.total_energy_kwh, top.record_count) == ("hot", 10000.0, 100_000)


def test_anomalies_need_history_and_a_spread(spark):
    days = [("a", "2026-01-01", 10.0), ("a", "2026-01-02", 12.0), ("a", "2026-01-03", 30.0), ("b", "2026-01-03", 9.0), ("c", "2026-01-02", 5.0), ("c", "2026-01-03", 9.0)]
    fact = spark.createDataFrame(days, "site_id string, d string, energy_kwh double").withColumn("reading_date", F.to_date("d"))
    got = {r.site_id: (r.avg_kwh, r.stddev_kwh, r.anomaly_type, r.z_score) for r in st.anomalies(fact, day="2026-01-03").collect()}
    # b has no history and drops out; c has one sample, so no deviation and no score
    assert got == {"a": (11.0, 1.41, "HIGH", 13.48), "c": (5.0, None, "NORMAL", None)}
