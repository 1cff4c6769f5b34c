"""Row checks over the events feed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators import rowchecks as rc
from meterline.plans import roles
from meterline.plans.oracle_roles import FEED, SITES, STAGED, with_roles
from meterline.plans.shape import flat
from meterline.session import cut_lineage

RULES = list(roles.readings_config().feeds.values())
ENERGY_RULE = RULES[0]


def judged(spark, sf) -> DataFrame:
    """Every feed row with its tests, not yet written."""
    return rc.validate_rows(roles.feed(spark, sf), RULES)


def validated(spark, sf) -> DataFrame:
    """The validated feed as a written table, for queries that filter on the outcome or read it twice.

    Reading it back keeps Spark from running the row tests again inside each
    filter.
    """
    return cut_lineage(judged(spark, sf))


def staged(spark, sf) -> DataFrame:
    return rc.stage_readings(validated(spark, sf), RULES)


def c1_mandatory_null(spark, sf):
    feed = roles.feed(spark, sf)
    reason = rc.null_reason(feed, ENERGY_RULE).alias("reason")
    return feed.select("dataset", reason).groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("n"))


def c2_duplicate_pk(spark, sf):
    from meterline.functions.joins import mark_repeats

    marked = mark_repeats(roles.feed(spark, sf), ["file_name", "record_id"], "row_index", "is_repeat")
    return marked.filter("is_repeat").select("file_name", "row_index", "record_id")


def c3_strict_iso_date(spark, sf):
    feed = roles.feed(spark, sf)
    bad = feed.withColumn("reason", rc.date_reason(feed, ENERGY_RULE)).filter("reason is not null")
    return bad.select("row_index", "reading_date", "reason")


def c4_numeric_cast_range(spark, sf):
    feed = roles.feed(spark, sf)
    reason = F.coalesce(
        rc.range_reason(feed, ENERGY_RULE, "energy_kwh"), rc.range_reason(feed, ENERGY_RULE, "emissions_co2e")
    )
    return feed.withColumn("reason", reason).filter("reason is not null").select("row_index", "energy_kwh", "reason")


def c5_first_reason(spark, sf):
    return judged(spark, sf).select("row_index", "validation_status", "rejection_reason")


METER_RULE = replace(
    ENERGY_RULE, mandatory_not_null=["site_id", "meter"], numeric_range={"energy_kwh": {"min": 0}, "meter": {"min": 3, "max": 450}}
)


def c5_rules_on_any_column(spark, sf):
    """First reason under rules that name a column of their own: a mandatory meter number within a range."""
    i = F.col("row_index")
    meter = F.when(i % 71 == 0, " ").when(i % 73 == 0, "n/a").otherwise((i % 500).cast("string"))
    rules = [replace(METER_RULE, name=rule.name) for rule in RULES]
    return rc.validate_rows(roles.feed(spark, sf).withColumn("meter", meter), rules).select("row_index", "rejection_reason")


def c6_staging_project(spark, sf):
    ids = rc.assign_staging_ids(staged(spark, sf), [F.col("dataset").asc(), F.col("row_index").asc()])
    return flat(
        ids.select(
            "staging_id", "dataset", "record_id", "site_id", "reading_date", "energy_kwh", "emissions_co2e",
            "validation_status",
        )
    )


def c7_load_stats(spark, sf):
    stats = rc.load_stats(judged(spark, sf), ["batch_id", "dataset"], RULES)
    return stats.withColumn("null_sites", F.coalesce(F.col("nulls_by_column")["site_id"], F.lit(0))).drop("nulls_by_column")


def c8_rejected_rows(spark, sf):
    return rc.rejected_rows(validated(spark, sf)).drop("batch_id", "dataset")


def c9_raw_to_staging_rules(spark, sf):
    feed = roles.feed(spark, sf).withColumn("energy_kwh", rc.parse_number("energy_kwh"))
    found = rc.collect_issues(feed, "energy_consumption")
    return found.filter("not accepted").select(
        "row_index",
        F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["column_name"], i["issue_type"])), ",").alias("issues"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        c1_mandatory_null, c2_duplicate_pk, c3_strict_iso_date, c4_numeric_cast_range, c5_first_reason,
        c5_rules_on_any_column,
        c6_staging_project, c7_load_stats, c8_rejected_rows, c9_raw_to_staging_rules,
    )
}

ORACLE = {
    "c1_mandatory_null": with_roles(FEED)
    + """SELECT dataset, CASE WHEN site_id = '' THEN 'null:site_id' END AS reason, count(*) AS n FROM feed GROUP BY 1, 2""",
    "c2_duplicate_pk": with_roles(FEED)
    + """SELECT file_name, row_index, record_id FROM (SELECT *, row_number() OVER (PARTITION BY file_name, record_id
     ORDER BY row_index) AS rn FROM feed) WHERE rn > 1""",
    "c3_strict_iso_date": with_roles(STAGED)
    + "SELECT row_index, reading_date, date_reason AS reason FROM marked WHERE date_reason IS NOT NULL",
    "c4_numeric_cast_range": with_roles(STAGED)
    + "SELECT row_index, energy_kwh, energy_reason AS reason FROM marked WHERE energy_reason IS NOT NULL",
    "c5_first_reason": with_roles(STAGED) + "SELECT row_index, validation_status, rejection_reason FROM staged",
    "c5_rules_on_any_column": with_roles(STAGED)
    + """SELECT row_index, coalesce(null_reason, CASE WHEN row_index % 71 = 0 THEN 'null:meter' END, repeat_reason, date_reason, energy_reason,
     CASE WHEN row_index % 73 = 0 THEN 'invalid_value:meter' WHEN row_index % 500 NOT BETWEEN 3 AND 450
     THEN 'range_violation:meter=' || (row_index % 500) END) AS rejection_reason FROM staged""",
    "c6_staging_project": with_roles(STAGED)
    + """SELECT 'S-' || batch_id || '-' || row_number() OVER (PARTITION BY batch_id ORDER BY dataset, row_index) AS staging_id,
     dataset, record_id, nullif(site_id, '') AS site_id,
     CASE WHEN date_reason IS NULL THEN reading_date END AS reading_date, CAST(energy_num AS DOUBLE) AS energy_kwh,
     CAST(emissions_num AS DOUBLE) AS emissions_co2e, validation_status FROM staged""",
    "c7_load_stats": with_roles(STAGED)
    + """SELECT batch_id, dataset, count(*) AS total_read, count(*) FILTER (rejection_reason IS NULL) AS total_valid,
     count(rejection_reason) AS total_rejected, count(*) FILTER (rejection_reason = 'invalid_date_format') AS invalid_dates,
     count(*) FILTER (rejection_reason LIKE '%energy_kwh%') AS range_violations,
     count(*) FILTER (rejection_reason = 'duplicate_record_id') AS duplicates,
     count(*) FILTER (rejection_reason = 'null:site_id') AS null_sites FROM staged GROUP BY 1, 2""",
    "c8_rejected_rows": with_roles(STAGED)
    + """SELECT record_id, nullif(site_id, '') AS site_id, reading_date, TRY_CAST(nullif(energy_kwh, '1d') AS DOUBLE) AS energy_kwh,
     CAST(emissions_co2e AS DOUBLE) AS emissions_co2e, rejection_reason, file_name AS source_file
     FROM staged WHERE rejection_reason IS NOT NULL""",
    "c9_raw_to_staging_rules": with_roles(FEED)
    + """SELECT row_index, issues FROM (SELECT row_index, concat_ws(',', CASE WHEN site_id = '' THEN 'site_id:NULL_VALUE' END,
     CASE WHEN energy_kwh = '1d' THEN 'energy_kwh:NULL_VALUE' WHEN CAST(energy_kwh AS DOUBLE) < 0
     THEN 'energy_kwh:OUT_OF_RANGE' END) AS issues FROM feed) WHERE issues <> ''""",
}
