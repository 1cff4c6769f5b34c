"""Batch checks over the events feed and the recorded checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import dq
from meterline.operators import rowchecks as rc
from meterline.plans import roles
from meterline.plans.catalog_rows import RULES, validated
from meterline.plans.oracle_roles import CHECKS, DELIVERIES, FACT, SITES, STAGED, with_roles
from meterline.plans.shape import flat

CONFIG = roles.readings_config()
SHOWN = ["batch_id", "dataset", "status", "column_name", "expected_value", "actual_value", "threshold_value", "error_details"]


def _check(spark, sf, name, extra=None):
    """One named check; `extra` builds further inputs from the written feed."""
    rows = validated(spark, sf)
    stats = rc.load_stats(rows, ["batch_id", "dataset"], RULES)
    inputs = extra(rc.stage_readings(rows, RULES)) if extra else {}
    return dq.staging_checks(stats, CONFIG, **inputs, names=[name]).select(*SHOWN)


def d1_null_check_mandatory(spark, sf):
    return _check(spark, sf, "null_check_mandatory")


def d2_duplicate_record_check(spark, sf):
    return _check(spark, sf, "duplicate_record_check")


def d3_date_validity_check(spark, sf):
    return _check(spark, sf, "date_validity_check")


def d4_numeric_range_check(spark, sf):
    return _check(spark, sf, "numeric_range_check", lambda staged: {"violations": dq.staged_violations(staged, RULES)})


def d5_referential_integrity(spark, sf):
    known = roles.sites(spark, sf)
    return _check(spark, sf, "referential_integrity_check", lambda staged: {"orphans": dq.orphan_counts(staged, known)})


def d6_rejected_threshold(spark, sf):
    return _check(spark, sf, "rejected_threshold_check")


def _files(spark, sf):
    d = roles.deliveries(spark, sf)
    empty = F.col("data_rows") == 0
    return d.select(
        "batch_id", "business_date", "file_name",
        F.when(empty, "QUARANTINED").otherwise("VALIDATED").alias("file_status"),
        F.when(empty, "EMPTY_FILE").alias("error_message"),
    )


def d7_quarantined_file_check(spark, sf):
    return dq.quarantine_check(_files(spark, sf)).select("batch_id", "status", "actual_value", "error_details")


def d8_freshness_check(spark, sf):
    fact = roles.fact(spark, sf)
    batches = fact.groupBy("batch_id").agg(F.max("reading_date").alias("business_date"))
    found = dq.freshness_check(batches, fact.withColumn("reading_date", F.date_sub("reading_date", 1)))
    return found.select("batch_id", "status", "expected_value", "actual_value", "error_details")


def d9_check_result(spark, sf):
    found = dq.with_catalogue(roles.checks(spark, sf), CONFIG)
    return found.select("check_id", "check_name", "check_category", "severity", "status")


def d10_incident_derive(spark, sf):
    checks = roles.checks(spark, sf).withColumns(
        {
            "dataset": F.lit(None).cast("string"),
            "mandatory": F.col("check_id") % 2 == 0,
            "incident_description": F.lit(None).cast("string"),
            "incident_file": F.lit(None).cast("string"),
            "incident_table": F.lit(None).cast("string"),
        }
    )
    found = dq.derive_incidents(checks, CONFIG, ["check_id"])
    return found.select(
        "incident_id", "batch_id", "incident_type", "severity", "short_description", "affected_table", "runbook_id"
    )


def _load_batches(spark, sf):
    d = roles.deliveries(spark, sf)
    broken = F.size("header") < 3
    return d.groupBy("batch_id").agg(
        F.bool_or(broken).alias("load_failed"),
        F.min(F.when(broken, F.col("file_name"))).alias("failed_file"),
        F.min(F.when(broken, F.concat(F.lit("bad rows in "), F.col("file_name")))).alias("error_message"),
    )


def d11_load_failure_incident(spark, sf):
    batches = _load_batches(spark, sf)
    audit = dq.task_audit(batches)
    raised = dq.load_failure_incidents(batches, CONFIG).select("batch_id", "incident_id", "severity", "short_description")
    return flat(audit.join(raised, "batch_id", "left").drop("run_id", "job_type"))


QUERIES = {
    f.__name__: f
    for f in (
        d1_null_check_mandatory, d2_duplicate_record_check, d3_date_validity_check, d4_numeric_range_check,
        d5_referential_integrity, d6_rejected_threshold, d7_quarantined_file_check, d8_freshness_check, d9_check_result,
        d10_incident_derive, d11_load_failure_incident,
    )
}

_COUNT = """SELECT batch_id, dataset, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, {column} AS column_name,
 '0' AS expected_value, CAST(n AS VARCHAR) AS actual_value, {threshold} AS threshold_value,
 CASE WHEN n > 0 THEN {details} END AS error_details FROM (SELECT batch_id, dataset, {n} AS n FROM staged {join} GROUP BY 1, 2)"""
_NULL = "CAST(NULL AS VARCHAR)"

ORACLE = {
    "d1_null_check_mandatory": with_roles(STAGED)
    + _COUNT.format(
        column="CASE WHEN n > 0 THEN 'site_id' ELSE 'record_id,site_id,reading_date,energy_kwh' END", threshold=_NULL,
        details="'blank where a value is required: site_id=' || n",
        n="count(*) FILTER (rejection_reason = 'null:site_id')", join="",
    ),
    "d2_duplicate_record_check": with_roles(STAGED)
    + _COUNT.format(
        column="'record_id'", threshold=_NULL, details="n || ' rows repeat an earlier record_id'",
        n="count(*) FILTER (rejection_reason = 'duplicate_record_id')", join="",
    ),
    "d3_date_validity_check": with_roles(STAGED)
    + _COUNT.format(
        column="'reading_date'", threshold=_NULL, details="n || ' rows have no readable date'",
        n="count(*) FILTER (rejection_reason = 'invalid_date_format')", join="",
    ),
    "d4_numeric_range_check": with_roles(STAGED)
    + _COUNT.format(
        column="'energy_kwh,emissions_co2e'", threshold="'energy_kwh>=0,emissions_co2e>=0'",
        details="n || ' refused on loading, 0 among accepted rows'",
        n="count(*) FILTER (rejection_reason LIKE '%energy_kwh%')", join="",
    ),
    "d5_referential_integrity": with_roles(STAGED, SITES)
    + _COUNT.format(
        column="'site_id'", threshold=_NULL,
        details="n || ' rows name a site that no site feed has delivered'",
        n="count(*) FILTER (validation_status = 'VALID' AND s IS NULL)",
        join="LEFT JOIN (SELECT DISTINCT site_id AS s FROM sites) ON staged.site_id = s",
    ),
    "d6_rejected_threshold": with_roles(STAGED)
    + """SELECT batch_id, dataset, CASE WHEN pct > 5 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(NULL AS VARCHAR) AS column_name,
     '<= 5%' AS expected_value, format('{:.1f}', CAST(pct AS DOUBLE)) || '%' AS actual_value, '5' AS threshold_value,
     CASE WHEN pct > 5 THEN rejected || '/' || total || ' rows refused' END AS error_details
     FROM (SELECT batch_id, dataset, count(*) AS total, count(rejection_reason) AS rejected,
      CAST(count(rejection_reason) AS DOUBLE) / count(*) * 100.0 AS pct FROM staged GROUP BY 1, 2)""",
    "d7_quarantined_file_check": with_roles(DELIVERIES)
    + """SELECT batch_id, CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END AS status, CAST(n AS VARCHAR) AS actual_value, t AS error_details
     FROM (SELECT batch_id, count(*) FILTER (data_rows = 0) AS n,
      string_agg(file_name || ': EMPTY_FILE', ' | ' ORDER BY file_name) FILTER (data_rows = 0) AS t FROM deliveries GROUP BY 1)""",
    "d8_freshness_check": with_roles(FACT)
    + """SELECT b.batch_id, CASE WHEN max(f.d) < b.d - 1 THEN 'FAIL' ELSE 'PASS' END AS status,
     '>= ' || CAST(b.d - 1 AS VARCHAR) AS expected_value,
     coalesce(CAST(max(f.d) AS VARCHAR), 'nothing loaded yet') AS actual_value,
     CASE WHEN max(f.d) < b.d - 1 THEN 'newest reading is of ' || max(f.d) || ', too old for ' || (b.d - 1) END
      AS error_details
     FROM (SELECT DISTINCT batch_id, reading_date AS d FROM fact) b
     LEFT JOIN (SELECT DISTINCT batch_id, reading_date - 1 AS d FROM fact) f ON f.batch_id < b.batch_id GROUP BY b.batch_id, b.d""",
    "d9_check_result": with_roles(CHECKS)
    + """SELECT check_id, check_name, CASE check_name WHEN 'custom_check' THEN 'OPERATIONS' WHEN 'duplicate_record_check' THEN
     'UNIQUENESS' WHEN 'source_to_target_rowcount_recon' THEN 'RECONCILIATION' ELSE 'COMPLETENESS' END AS check_category,
     CASE check_name WHEN 'custom_check' THEN 'MEDIUM' WHEN 'duplicate_record_check' THEN 'MEDIUM' WHEN 'null_check_mandatory'
     THEN 'HIGH' ELSE 'CRITICAL' END AS severity, status FROM checks""",
    "d10_incident_derive": with_roles(CHECKS)
    + """SELECT 'INC-' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS incident_id,
     batch_id, incident_type, CASE incident_type WHEN 'NULL_VALUES' THEN CASE WHEN check_id % 2 = 0 THEN 'P2' ELSE 'P3' END
     WHEN 'DUPLICATE_RECORDS' THEN 'P3' ELSE 'P2' END AS severity, check_name || ' failed (batch ' || batch_id || ')' AS short_description,
     table_name AS affected_table, CASE incident_type WHEN 'NULL_VALUES' THEN 'RB007' WHEN 'DUPLICATE_RECORDS' THEN 'RB006'
     WHEN 'FILE_MISSING' THEN 'RB001' ELSE 'RB005' END AS runbook_id
     FROM (SELECT *, row_number() OVER (ORDER BY check_id) AS n, CASE check_name WHEN 'null_check_mandatory' THEN 'NULL_VALUES'
      WHEN 'duplicate_record_check' THEN 'DUPLICATE_RECORDS' WHEN 'file_arrival_check' THEN 'FILE_MISSING'
      ELSE 'ROW_COUNT_MISMATCH' END AS incident_type FROM checks WHERE status = 'FAIL' AND check_name <> 'custom_check')""",
    "d11_load_failure_incident": with_roles(DELIVERIES)
    + """, b AS (SELECT batch_id, bool_or(header = 'garbage') AS bad, min(file_name) FILTER (header = 'garbage') AS f
      FROM deliveries GROUP BY 1),
     i AS (SELECT batch_id, 'INC-' || lpad(CAST(row_number() OVER (ORDER BY batch_id) AS VARCHAR), 6, '0') AS incident_id,
      'P1' AS severity, 'Staging stopped (' || f || ') in batch ' || batch_id AS short_description FROM b WHERE bad)
     SELECT b.batch_id, t.task_id, t.sequence, CASE WHEN bad AND t.sequence = 2 THEN 'FAILED' WHEN bad AND t.sequence BETWEEN 3 AND 5
      THEN 'SKIPPED' ELSE 'SUCCESS' END AS status, CASE WHEN bad AND t.sequence = 2 THEN 'bad rows in ' || f END AS error_message,
      i.incident_id, i.severity, i.short_description
     FROM b CROSS JOIN (VALUES (CAST(0 AS BIGINT), 'file_sensor_task'), (1, 'ingest_and_validate_file_task'), (2, 'load_staging_task'),
      (3, 'run_data_quality_checks_task'), (4, 'load_warehouse_task'), (5, 'reconcile_source_to_target_task'),
      (6, 'generate_ops_report_task'), (7, 'notify_incident_task')) t(sequence, task_id) LEFT JOIN i ON i.batch_id = b.batch_id""",
}
