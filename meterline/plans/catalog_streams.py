"""Streams over the feed files and the events table, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.plans import roles
from meterline.plans.catalog_files import HEADER, ORACLE as FILE_ORACLE, feed_dir, write_feed_files
from meterline.plans.catalog_ops import CONFIG, file_log
from meterline.plans.catalog_rows import ENERGY_RULE
from meterline.plans.catalog_sites import sql_round
from meterline.plans.oracle_roles import STAGED, with_roles
from meterline.plans.shape import flat
from meterline.schemas import STAGING_READINGS, TABLES
from meterline.session import new_path
from meterline.streaming import feeds, stateful


def m1_landing_stream(spark, sf):
    out = new_path(spark, "staged-stream")
    query = feeds.landing_stream(
        spark, write_feed_files(spark, sf), [ENERGY_RULE], F.lit(ENERGY_RULE.name), out, new_path(spark, "state"), HEADER.split(","),
        name=feed_dir(), glob="*.txt", files_per_batch=8,
    )
    query.awaitTermination()
    staged = spark.read.schema(STAGING_READINGS).parquet(out)
    return flat(
        staged.select("source_file_name", "row_index", "record_id", "site_id", "energy_kwh", "validation_status", "rejection_reason")
    )


def _readings(spark, sf):
    events = spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    return roles.feed_of(events)


def m2_stream_dedupe(spark, sf):
    out = new_path(spark, "deduplicated")
    kept = feeds.deduplicated(_readings(spark, sf), ENERGY_RULE, "ts", ["file_name", "record_id"], delay="2 days")
    feeds.write_updates(kept.select("file_name", "record_id"), out, new_path(spark, "state"), "append").awaitTermination()
    return spark.read.schema("file_name string, record_id string, epoch long").parquet(out).drop("epoch")


def m2_stream_rejects(spark, sf):
    out = new_path(spark, "rejected")
    rejected = feeds.rejected_readings(_readings(spark, sf), ENERGY_RULE).select("row_index", "file_name", "rejection_reason")
    feeds.write_updates(rejected, out, new_path(spark, "state"), "append").awaitTermination()
    return spark.read.schema("row_index long, file_name string, rejection_reason string, epoch long").parquet(out).drop("epoch")


def m3_rolling_quality_stream(spark, sf):
    out = new_path(spark, "quality")
    scores = feeds.rolling_quality(_readings(spark, sf), ENERGY_RULE, "ts")
    feeds.write_updates(scores, out, new_path(spark, "state"), "update").awaitTermination()
    written = spark.read.schema(
        "load_date date, dataset string, total_records long, valid_records long, quality_score double, epoch long"
    ).parquet(out)
    return flat(feeds.latest_updates(written, ["load_date", "dataset"]))


def m3_counted_quality_stream(spark, sf):
    out = new_path(spark, "counted")
    feeds.count_quality(_readings(spark, sf), ENERGY_RULE, "ts", out, new_path(spark, "state"), ["row_index", "file_name"]).awaitTermination()
    return flat(feeds.counted_quality(spark, out))


def m2_stream_outcomes(spark, sf):
    """Every reading as accepted, rejected (repeated keys included) or late."""
    out = new_path(spark, "outcomes")
    judged = stateful.judged(_readings(spark, sf), ENERGY_RULE, "ts").select("row_index", "file_name", "record_id", stateful.JUDGE)
    stateful.write_judged(judged, out, new_path(spark, "state")).awaitTermination()
    schema = "row_index long, file_name string, record_id string, outcome string, rejection_reason string, epoch long"
    return spark.read.schema(schema).parquet(out).drop("epoch")


def b1_feed_sensor_stream(spark, sf):
    """The arrival and SLA checks of the deliveries, each as soon as its file comes or its deadline passes."""
    folder, out = new_path(spark, "arrivals"), new_path(spark, "sensed")
    d = roles.deliveries(spark, sf)
    as_of = (F.to_timestamp("business_date") + F.expr("interval 60 days")).alias("as_of")
    d.select("batch_id", "business_date", as_of).distinct().write.parquet(f"{folder}/days")
    d.filter("in_landing").select("file_name", "received_at").write.parquet(f"{folder}/files")
    days = spark.readStream.schema("batch_id string, business_date string, as_of timestamp").parquet(f"{folder}/days")
    files = spark.readStream.schema("file_name string, received_at timestamp").parquet(f"{folder}/files")
    sensed = stateful.feed_sensor(days, files, CONFIG)
    stateful.write_sensor_checks(sensed, file_log(spark, sf).filter("in_log"), out, new_path(spark, "state")).awaitTermination()
    return spark.read.schema(", ".join(f"{c} string" for c in SENSED)).parquet(out).select(*SENSED)


QUERIES = {
    f.__name__: f
    for f in (m1_landing_stream, m2_stream_dedupe, m2_stream_rejects, m2_stream_outcomes, m3_rolling_quality_stream, m3_counted_quality_stream, b1_feed_sensor_stream)
}

SENSED = ["check_name", "batch_id", "dataset", "status", "expected_value", "actual_value", "threshold_value", "error_details"]
_SENSED = ", ".join(SENSED[1:])
_PLAIN = "null_reason IS NULL AND date_reason IS NULL AND energy_reason IS NULL"

ORACLE = {
    "m1_landing_stream": with_roles(STAGED.replace("PARTITION BY file_name, record_id", "PARTITION BY row_index // 1000, record_id"))
    + """SELECT 'readings_' || lpad(CAST(row_index // 1000 AS VARCHAR), 7, '0') AS source_file_name,
     row_number() OVER (PARTITION BY row_index // 1000 ORDER BY row_index) - 1 AS row_index, record_id, nullif(s, '') AS site_id,
     CASE WHEN energy_kwh <> '1d' AND coalesce(n, repeat_reason, date_reason) IS NULL THEN CAST(nullif(energy_kwh, '1d') AS DOUBLE) END AS energy_kwh,
     CASE WHEN coalesce(n, repeat_reason, date_reason, energy_reason) IS NULL THEN 'VALID' ELSE 'REJECTED' END AS validation_status,
     coalesce(n, repeat_reason, date_reason, energy_reason) AS rejection_reason
     FROM (SELECT *, CASE WHEN row_index % 106 = 0 AND row_index // 1000 % 4 = 0 THEN 'a,"q"' || chr(10) || chr(10) || ' b' WHEN row_index % 53 = 0 THEN 'a,"q" b'
      ELSE site_id END AS s,
      CASE WHEN row_index % 53 <> 0 THEN null_reason END AS n FROM staged)""",
    "m2_stream_dedupe": with_roles(STAGED) + f"SELECT DISTINCT file_name, record_id FROM staged WHERE {_PLAIN}",
    "m2_stream_rejects": with_roles(STAGED)
    + f"""SELECT row_index, file_name, coalesce(null_reason, date_reason, energy_reason) AS rejection_reason
     FROM staged WHERE NOT ({_PLAIN})""",
    "m2_stream_outcomes": with_roles(STAGED)
    + """SELECT row_index, file_name, record_id, CASE WHEN rejection_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, rejection_reason
     FROM staged""",
    "b1_feed_sensor_stream": f"""SELECT 'file_arrival_check' AS check_name, {_SENSED} FROM ({FILE_ORACLE['b1_feed_arrival']})
     UNION ALL SELECT 'sla_check', {_SENSED} FROM ({FILE_ORACLE['b2_sla_check']})""",
    **dict.fromkeys(("m3_rolling_quality_stream", "m3_counted_quality_stream"), with_roles(STAGED)
    + f"""SELECT business_date AS load_date, dataset, count(*) AS total_records, count(*) FILTER ({_PLAIN}) AS valid_records,
     {sql_round(f'100.0 * count(*) FILTER ({_PLAIN}) / count(*)')} AS quality_score FROM staged GROUP BY 1, 2"""),
}
