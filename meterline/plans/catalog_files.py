"""File checks over the derived deliveries, and sources and sinks over files Spark writes from the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators import filechecks as fc
from meterline.operators import metrics as mt
from meterline.operators import ops
from meterline.operators import rowchecks as rc
from meterline.operators.incidents import incident_alerts
from meterline.plans import roles
from meterline.plans.catalog_ops import (
    _PERF, _QUALITY, CONFIG, FILES, ORACLE as OPS_ORACLE, _feed_batches, _performance, _quality, file_log, h10_daily_ops_report,
)
from meterline.plans.catalog_rows import staged, validated
from meterline.plans.oracle_roles import CHECKS, DELIVERIES, FEED, INCIDENTS, STAGED, TASKS, with_roles
from meterline.plans.shape import flat
from meterline.schemas import INCIDENT_COLUMNS, REJECTED_COLUMNS, REPORT_COLUMNS
from meterline.session import new_path
from meterline.sources import landing, sinks

HEADER = "record_id,site_id,reading_date,energy_kwh,emissions_co2e"
ROWS_PER_FILE = 1000
def feed_dir() -> Column:
    """The feed file name, from the folder it was written to."""
    return F.regexp_extract("path", r"feed=([^/]+)/", 1)



def feed_lines(spark, sf) -> DataFrame:
    """CSV lines of the feed, a file per thousand readings, with quoted, multi-line, short and long records."""
    f = roles.feed(spark, sf)
    i = F.col("row_index")
    name = F.format_string("readings_%07d", F.floor(i / ROWS_PER_FILE).cast("long"))
    # Every fourth file has values of several lines.
    site = F.when((i % 106 == 0) & (F.floor(i / ROWS_PER_FILE) % 4 == 0), F.lit('"a,""q""\n\n b"')).when(i % 53 == 0, F.lit('"a,""q"" b"')).otherwise(F.col("site_id"))
    tail = F.when(i % 61 == 0, "").when(i % 1997 == 5, F.concat(F.lit(","), "emissions_co2e", F.lit(","))).otherwise(
        F.concat(F.lit(","), "emissions_co2e")
    )
    line = F.concat(F.concat_ws(",", "record_id", site, "reading_date", "energy_kwh"), tail)
    body = f.select(name.alias("feed"), i.alias("place"), line.alias("value"))
    heads = body.select("feed").distinct().select("feed", F.lit(-1).cast("long").alias("place"), F.lit(HEADER).alias("value"))
    return body.unionByName(heads)


def write_feed_files(spark, sf) -> str:
    """One text file per feed name, records in order."""
    path = new_path(spark, "landing")
    lines = feed_lines(spark, sf).repartition("feed").sortWithinPartitions("feed", "place")
    lines.select("feed", "value").write.partitionBy("feed").text(path)
    return path


def a1_landing_scan(spark, sf):
    listed = landing.list_zone(spark, write_feed_files(spark, sf), feed_dir(), suffixes=r"\.txt$")
    return listed.select("file_name", "size_bytes")


def a2_manifest_read(spark, sf):
    d = roles.deliveries(spark, sf)
    good = F.to_json(F.struct("file_name", "dataset", F.col("expected_rows"), F.col("manifest_checksum").alias("checksum_sha256")))
    text = F.when(F.col("manifest_checksum").isNull(), "not json").otherwise(good)
    path = new_path(spark, "sidecars")
    d.select(F.col("file_name").alias("feed"), text.alias("value")).repartition("feed").write.partitionBy("feed").text(path)
    found = landing.read_sidecars(spark, path, feed_dir(), "*.txt")
    joined = d.select("file_name").join(found, F.col("file_name") == F.col("feed_file"), "left")
    return joined.select("file_name", F.col("expected_rows").cast("long").alias("expected_rows"), "checksum_sha256")


def a3_feed_read_csv(spark, sf):
    rows, _ = landing.read_feed(spark, write_feed_files(spark, sf), feed_dir(), "*.txt")
    return landing.feed_columns(rows, HEADER.split(","))


def a4_structural_corruption(spark, sf):
    rows, profiles = landing.read_feed(spark, write_feed_files(spark, sf), feed_dir(), "*.txt")
    errors = landing.structural_errors(rows)
    return profiles.select("file_name", (F.col("lines") - 1).alias("data_rows")).join(errors, "file_name", "left")


def a5_checksum(spark, sf):
    return landing.checksums(spark, write_feed_files(spark, sf), feed_dir(), "*.txt")


def a6_config_tables(spark, sf):
    counts = roles.feed(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    rules = CONFIG.rules_table(spark).select("dataset", "required_columns", "date_column", "staging_table")
    manifest = CONFIG.manifest_table(spark).select("dataset", "any_date_regex", "source_system", "sla_hours")
    return flat(counts.join(F.broadcast(rules), "dataset").join(F.broadcast(manifest), "dataset"))


def a7_staging_sink(spark, sf):
    path, rows = new_path(spark, "staging"), staged(spark, sf)
    sinks.write_batches(rows, path)
    sinks.write_batches(rows.filter("batch_id = 'B-20240105-01'"), path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("batch_id", "validation_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("energy_kwh").cast("decimal(18,2)")).cast("double").alias("kwh")
    )


def a8_zone_route(spark, sf):
    decided = fc.quarantine_decision(roles.deliveries(spark, sf), CONFIG).select("file_name", "file_status", "checksum_status", "zone")
    path = new_path(spark, "zones")
    sinks.write_batches(decided, path, ("zone",))
    return spark.read.schema(decided.schema).parquet(path)


def a9_query_export_csv(spark, sf):
    path = new_path(spark, "export")
    sinks.export_query(
        spark, "SELECT batch_id, site_id, energy_kwh, record_id FROM {fact} WHERE side = :side AND energy_kwh >= :least", path,
        {"side": "O", "least": 25}, fact=roles.fact(spark, sf),
    )
    return spark.read.option("header", "true").schema("batch_id string, site_id string, energy_kwh double, record_id string").csv(path)


def a10_metrics_jsonl(spark, sf):
    path = new_path(spark, "metrics")
    sinks.write_metrics(mt.metric_lines(None, _quality(spark, sf), _performance(spark, sf)), path)
    back = spark.read.schema(
        "timestamp string, type string, dataset string, batchId string, totalRecords long, validRecords long, qualityScore double, "
        "taskName string, durationMs double, recordsProcessed long, topIssues array<struct<issue string, count long>>"
    ).json(path)
    return back.select(
        "type", "dataset", F.col("batchId").alias("batch_id"), F.col("totalRecords").alias("total_records"),
        F.col("qualityScore").alias("quality_score"), F.col("taskName").alias("task_name"), F.col("durationMs").alias("duration_ms"),
        F.aggregate("topIssues", F.lit(0).cast("long"), lambda a, i: a + i["count"]).alias("issues"),
    )


def a11_sla_report_json(spark, sf):
    path = new_path(spark, "sla")
    violations = mt.sla_violations(_quality(spark, sf), _performance(spark, sf))
    sinks.write_sla_report(mt.sla_report(violations), violations, path)
    back = spark.read.schema(
        "total_violations long, critical_violations long, warning_violations long, by_component map<string, long>"
    ).json(f"{path}/summary")
    return back.select(
        "total_violations", "critical_violations", "warning_violations",
        F.col("by_component")["data_quality"].alias("data_quality"), F.col("by_component")["performance"].alias("performance"),
    )


def a12_failed_rows_csv(spark, sf):
    path = new_path(spark, "rejected")
    sinks.write_rejected(rc.rejected_rows(validated(spark, sf)), path)
    kinds = {"energy_kwh": "double", "emissions_co2e": "double"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in REJECTED_COLUMNS)
    return spark.read.option("header", "true").option("escape", '"').schema(schema + ", batch_id string").csv(path)


def a13_report_csv(spark, sf):
    path = new_path(spark, "reports")
    sinks.write_report_csv(h10_daily_ops_report(spark, sf), path)
    texts = {"report_date", "reconciliation_status", "overall_health"}
    schema = ", ".join(f"{c} {'string' if c in texts else 'long'}" for c in REPORT_COLUMNS)
    return spark.read.option("header", "true").schema(schema).csv(path)


def a13_report_md(spark, sf):
    return flat(sinks.report_lines(h10_daily_ops_report(spark, sf)))


def a14_incident_csv(spark, sf):
    path = new_path(spark, "incidents")
    sinks.write_incidents(ops.with_age(roles.incidents(spark, sf), "2001-08-02 00:00:00"), path)
    kinds = {"age_minutes": "long"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in INCIDENT_COLUMNS)
    back = spark.read.option("header", "true").schema(schema).csv(path)
    return back.select("incident_id", "batch_id", "severity", "short_description", "affected_check", "escalated", "age_minutes")


def a15_batch_lineage_md(spark, sf):
    tasks, incidents = _feed_batches(spark, sf)
    rows = staged(spark, sf)
    checks = roles.checks(spark, sf)
    summary = ops.batch_lineage(
        tasks, file_log(spark, sf), rows, checks, incidents, rows.filter("validation_status = 'VALID'"), incidents.select("batch_id"),
        energy="click", carbon="view",
    )
    lines = sinks.lineage_lines(
        summary, tasks, file_log(spark, sf), checks, ops.rejection_reasons(rows), incidents, incident_alerts(incidents)
    )
    path = new_path(spark, "lineage")
    sinks.write_lines(lines, path)
    back = spark.read.option("header", "true").option("escape", '"').schema("batch_id string, section int, key string, line string").csv(path)
    return back.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").startswith("- ")).alias("reasons"),
        F.count_if(F.col("line").startswith("#")).alias("headings"),
    )


# ---- file checks --------------------------------------------------------------------------------

SHOWN = ["batch_id", "dataset", "status", "expected_value", "actual_value", "threshold_value", "error_details"]


def _matched(spark, sf):
    d = roles.deliveries(spark, sf)
    days = d.select("business_date", "batch_id").distinct()
    return fc.match_files(fc.expected_feeds(days, CONFIG), d.filter("in_landing").select("file_name", "received_at"))


def b1_feed_arrival(spark, sf):
    log = file_log(spark, sf).filter("in_log")
    return fc.arrival_checks(_matched(spark, sf), log).select(*SHOWN)


def b2_sla_check(spark, sf):
    return fc.sla_checks(_matched(spark, sf)).select(*SHOWN, "incident_description")


def b3_naming_violation(spark, sf):
    d = roles.deliveries(spark, sf)
    name = F.when(F.col("data_rows") % 5 == 1, F.concat(F.lit("x_"), "file_name")).otherwise(F.col("file_name"))
    return fc.naming_violations(d.withColumn("file_name", name), CONFIG)


def _file_check(spark, sf, name):
    found = fc.file_checks(roles.deliveries(spark, sf), CONFIG)
    return flat(found.filter(F.col("check_name") == name).select(*SHOWN, "mandatory"))


def b4_empty_file(spark, sf):
    return _file_check(spark, sf, "empty_file_check")


def b5_checksum_validation(spark, sf):
    return _file_check(spark, sf, "checksum_validation")


def b6_schema_header(spark, sf):
    return _file_check(spark, sf, "schema_header_validation")


def b7_row_count_control(spark, sf):
    return _file_check(spark, sf, "row_count_check")


def b8_quarantine_decision(spark, sf):
    return fc.quarantine_decision(roles.deliveries(spark, sf), CONFIG).select("file_name", "file_status", "error_message")


def b9_hours_late(spark, sf):
    return fc.hours_late(roles.deliveries(spark, sf)).select("batch_id", "file_name", "hours_late")


def b10_recent_deliveries(spark, sf):
    return fc.recent_deliveries(roles.deliveries(spark, sf)).select("dataset", "file_name", F.col("position").cast("long").alias("position"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_landing_scan, a2_manifest_read, a3_feed_read_csv, a4_structural_corruption, a5_checksum, a6_config_tables, a7_staging_sink,
        a8_zone_route, a9_query_export_csv, a10_metrics_jsonl, a11_sla_report_json, a12_failed_rows_csv, a13_report_csv, a13_report_md,
        a14_incident_csv, a15_batch_lineage_md, b1_feed_arrival, b2_sla_check, b3_naming_violation, b4_empty_file,
        b5_checksum_validation, b6_schema_header, b7_row_count_control, b8_quarantine_decision, b9_hours_late, b10_recent_deliveries,
    )
}

_LINES = FEED + """, lines AS (SELECT *, 'readings_' || lpad(CAST(row_index // 1000 AS VARCHAR), 7, '0') AS feed_name, record_id || ',' ||
 CASE WHEN row_index % 106 = 0 AND row_index // 1000 % 4 = 0 THEN '"a,""q""' || chr(10) || chr(10) || ' b"' WHEN row_index % 53 = 0 THEN '"a,""q"" b"' ELSE site_id END || ',' || reading_date || ',' || energy_kwh ||
 CASE WHEN row_index % 61 = 0 THEN '' WHEN row_index % 1997 = 5 THEN ',' || emissions_co2e || ',' ELSE ',' || emissions_co2e END AS line FROM feed)"""
_BODY = f"'{HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY row_index) || chr(10)"
_FULL = "record_id,site_id,reading_date,energy_kwh,emissions_co2e"
_ROW = """SELECT batch_id, dataset, {status} AS status, {expected} AS expected_value, {actual} AS actual_value, {threshold} AS threshold_value,
 {details} AS error_details, {mandatory} AS mandatory FROM deliveries {where}"""
_NULL = "CAST(NULL AS VARCHAR)"
_REASON = f"""CASE WHEN data_rows = 0 THEN 'EMPTY_FILE — no data rows'
 WHEN manifest_checksum IS NOT NULL AND manifest_checksum <> computed_checksum THEN 'CHECKSUM_MISMATCH — integrity validation failed'
 WHEN header = 'garbage' THEN 'FILE_CORRUPTED — unreadable header' WHEN header NOT LIKE '%site_id%' THEN 'SCHEMA_DRIFT — missing columns: site_id'
 WHEN header NOT LIKE '%emissions_co2e%' THEN 'SCHEMA_DRIFT — missing columns: emissions_co2e' END"""
_DECIDED = f"SELECT *, {_REASON} AS reason FROM deliveries"

ORACLE = {
    "a1_landing_scan": with_roles(_LINES) + f"SELECT feed_name AS file_name, strlen({_BODY}) AS size_bytes FROM lines GROUP BY 1",
    "a2_manifest_read": with_roles(DELIVERIES)
    + """SELECT file_name, CASE WHEN manifest_checksum IS NOT NULL THEN expected_rows END AS expected_rows, manifest_checksum AS checksum_sha256 FROM deliveries""",
    "a3_feed_read_csv": with_roles(_LINES)
    + """SELECT feed_name AS file_name, row_number() OVER (PARTITION BY feed_name ORDER BY row_index) - 1 AS row_index,
     CASE WHEN row_index % 61 = 0 THEN 4 WHEN row_index % 1997 = 5 THEN 6 ELSE 5 END AS n_fields, record_id,
     CASE WHEN row_index % 106 = 0 AND row_index // 1000 % 4 = 0 THEN 'a,"q"' || chr(10) || chr(10) || ' b' WHEN row_index % 53 = 0 THEN 'a,"q" b' ELSE site_id END AS site_id, reading_date, energy_kwh,
     CASE WHEN row_index % 61 = 0 THEN '' ELSE emissions_co2e END AS emissions_co2e FROM lines""".replace("THEN 4 WHEN", "THEN CAST(4 AS BIGINT) WHEN"),
    "a4_structural_corruption": with_roles(_LINES)
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY feed_name ORDER BY row_index) + 1 AS line_no FROM lines)
     SELECT feed_name AS file_name, count(*) AS data_rows, 'record ' || min(line_no) FILTER (row_index % 1997 = 5 AND row_index % 61 <> 0)
     || ' holds 6 fields, the header 5' AS load_error FROM n GROUP BY 1""",
    "a5_checksum": with_roles(_LINES)
    + f"SELECT feed_name AS file_name, sha256({_BODY}) AS computed_checksum, strlen({_BODY}) AS size_bytes FROM lines GROUP BY 1",
    "a6_config_tables": """SELECT event_type AS dataset, count(*) AS rows, 'record_id,site_id,reading_date,energy_kwh,emissions_co2e' AS required_columns,
     'reading_date' AS date_column, 'staging_energy_data' AS staging_table, '^' || event_type || '_[0-9]{4}-[0-9]{2}-[0-9]{2}\\.csv$' AS any_date_regex,
     'SRC-' || event_type AS source_system, CAST(4 AS DOUBLE) AS sla_hours FROM events GROUP BY 1""",
    "a7_staging_sink": with_roles(STAGED)
    + "SELECT batch_id, validation_status, count(*) AS n, CAST(sum(energy_num) AS DOUBLE) AS kwh FROM staged GROUP BY 1, 2",
    "a8_zone_route": with_roles(DELIVERIES)
    + f"""SELECT file_name, CASE WHEN reason IS NULL THEN 'VALIDATED' ELSE 'QUARANTINED' END AS file_status,
     CASE WHEN reason IS NULL THEN 'INCOMING' ELSE 'QUARANTINE' END AS zone, CASE WHEN data_rows = 0 THEN 'PENDING' WHEN manifest_checksum IS NULL
     THEN 'SKIPPED' WHEN manifest_checksum <> computed_checksum THEN 'INVALID' ELSE 'VALID' END AS checksum_status FROM ({_DECIDED})""",
    "a9_query_export_csv": """SELECT 'B-' || strftime(l_shipdate, '%Y%m%d') || '-01' AS batch_id, CAST(l_suppkey AS VARCHAR) AS site_id,
     l_quantity AS energy_kwh, l_orderkey || '-' || l_linenumber AS record_id FROM lineitem WHERE l_linestatus = 'O' AND l_quantity >= 25""",
    "a10_metrics_jsonl": _PERF + ", " + STAGED + _QUALITY
    + """SELECT 'data_quality' AS type, dataset, batch_id, total_records, quality_score, CAST(NULL AS VARCHAR) AS task_name,
     CAST(NULL AS DOUBLE) AS duration_ms, rejected_records AS issues FROM quality
     UNION ALL SELECT 'performance', NULL, batch_id, NULL, NULL, task, ms, NULL FROM perf""",
    "a11_sla_report_json": _PERF + ", " + STAGED + _QUALITY
    + """SELECT q + p AS total_violations, qc + pc AS critical_violations, q + p - qc - pc AS warning_violations, nullif(q, 0) AS data_quality, nullif(p, 0) AS performance
     FROM (SELECT count(*) AS q, count(*) FILTER (quality_score < 90) AS qc FROM quality WHERE quality_score < 95),
     (SELECT count(*) AS p, count(*) FILTER (ms > 15000) AS pc FROM perf WHERE ms > 10000)""",
    "a12_failed_rows_csv": with_roles(STAGED)
    + """SELECT batch_id, record_id, nullif(site_id, '') AS site_id, reading_date, TRY_CAST(nullif(energy_kwh, '1d') AS DOUBLE) AS energy_kwh,
     CAST(emissions_co2e AS DOUBLE) AS emissions_co2e, rejection_reason, file_name AS source_file FROM staged WHERE rejection_reason IS NOT NULL""",
    "a13_report_csv": OPS_ORACLE["h10_daily_ops_report"],
    "a13_report_md": "WITH r AS (" + OPS_ORACLE["h10_daily_ops_report"] + """), l AS (SELECT report_date, [
      '# Daily operations report ' || report_date, 'Health: **' || overall_health || '**', '',
      'Feeds ' || files_received || ' of ' || files_expected || ', tasks ' || jobs_succeeded || ' of ' || jobs_executed || ', checks ' || dq_checks_passed || ' of ' ||
       dq_checks_executed || '; incidents open: ' || open_incidents || ', P1 ' || p1_incidents || ', P2 ' || p2_incidents || '; totals: ' || reconciliation_status,
      '', '## Files', '| Figure | Count |', '|---|---|', '| Expected | ' || files_expected || ' |', '| Received | ' || files_received || ' |',
      '| Set aside | ' || files_quarantined || ' |',
      '', '## Tasks', '| Figure | Count |', '|---|---|', '| Run | ' || jobs_executed || ' |', '| Done | ' || jobs_succeeded || ' |',
      '| Failed | ' || jobs_failed || ' |',
      '', '## Checks', '| Figure | Count |', '|---|---|', '| Made | ' || dq_checks_executed || ' |', '| Passed | ' || dq_checks_passed || ' |',
      '| Broken | ' || dq_checks_failed || ' |',
      '', '## Incidents', '| Figure | Count |', '|---|---|', '| Open | ' || open_incidents || ' |', '| P1 | ' || p1_incidents || ' |',
      '| P2 | ' || p2_incidents || ' |',
      '', '## Reconciliation', 'Source against target: ' || reconciliation_status] AS lines FROM r)
     SELECT report_date, n - 1 AS line_number, lines[n] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM l)""",
    "a14_incident_csv": with_roles(INCIDENTS)
    + """SELECT incident_id, batch_id, severity, short_description, affected_check, CAST(escalated_flag AS VARCHAR) AS escalated,
     greatest(0, date_diff('minute', created_at, TIMESTAMP '2001-08-02')) AS age_minutes FROM incidents""",
    "a15_batch_lineage_md": with_roles(TASKS, INCIDENTS, CHECKS, FILES, STAGED)
    + """, st AS (SELECT 'B-' || strftime(start_time + INTERVAL 8186 DAY, '%Y%m%d') || '-01' AS batch_id FROM tasks),
     si AS (SELECT 'B-' || strftime(created_at + INTERVAL 8186 DAY, '%Y%m%d') || '-01' AS batch_id FROM incidents),
     k AS (SELECT batch_id FROM st UNION SELECT batch_id FROM files UNION SELECT batch_id FROM si),
     x AS (SELECT batch_id, count(*) AS n, 0 AS r, 0 AS h FROM st GROUP BY 1 UNION ALL SELECT batch_id, count(*), 0, 0 FROM files GROUP BY 1
      UNION ALL SELECT batch_id, count(*), 0, 0 FROM checks GROUP BY 1
      UNION ALL SELECT batch_id, count(DISTINCT rejection_reason), count(DISTINCT rejection_reason), 0 FROM staged WHERE rejection_reason IS NOT NULL GROUP BY 1
      UNION ALL SELECT batch_id, 2 * count(*), 0, 0 FROM si GROUP BY 1 UNION ALL SELECT batch_id, 41, 0, 9 FROM k)
     SELECT batch_id, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(r) AS BIGINT) AS reasons, CAST(sum(h) AS BIGINT) AS headings FROM x GROUP BY 1""",
    "b1_feed_arrival": with_roles(FILES)
    + """, e AS (SELECT DISTINCT business_date, batch_id, unnest(['click','view','purchase','error','signup']) AS dataset FROM files),
     p AS (SELECT dataset, business_date, arg_max(file_status, created_at) AS st, arg_max(batch_id, created_at) AS pb FROM files
      WHERE in_log AND file_status IN ('PROCESSED', 'QUARANTINED', 'VALIDATED', 'FAILED') GROUP BY 1, 2)
     SELECT e.batch_id, e.dataset, CASE WHEN st IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, e.dataset || '_' || e.business_date || '.csv' AS expected_value,
     CASE WHEN st IS NULL THEN 'not received' ELSE 'handled before: ' || st || ' by batch ' || pb END AS actual_value, CAST(NULL AS VARCHAR) AS threshold_value,
     CASE WHEN st IS NULL THEN e.dataset || '_' || e.business_date || '.csv from SRC-' || e.dataset || ' has not come' END AS error_details
     FROM e LEFT JOIN p USING (dataset, business_date) WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.dataset = e.dataset AND f.business_date = e.business_date AND in_landing)""",
    "b2_sla_check": with_roles(DELIVERIES)
    + """, x AS (SELECT *, CAST(business_date AS TIMESTAMP) + INTERVAL 630 MINUTE AS deadline FROM deliveries WHERE in_landing)
     SELECT batch_id, dataset, CASE WHEN received_at > deadline THEN 'FAIL' ELSE 'PASS' END AS status, '<= 06:30+4h' AS expected_value,
     CASE WHEN received_at > deadline THEN 'late arrival' ELSE 'on time' END AS actual_value, '4' AS threshold_value, CASE WHEN received_at > deadline THEN
     'came ' || strftime(received_at, '%Y-%m-%dT%H:%M:%S.000Z') || ', due by ' || strftime(deadline, '%Y-%m-%dT%H:%M:%S.000Z') END AS error_details,
     CASE WHEN received_at > deadline THEN file_name || ' came ' || date_diff('minute', deadline, received_at) || ' minutes past its 4 hours' END
      AS incident_description FROM x""",
    "b3_naming_violation": with_roles(DELIVERIES)
    + """SELECT 'x_' || file_name AS file_name, 'unknown' AS dataset, 'QUARANTINED' AS file_status, 'SKIPPED' AS checksum_status, 'QUARANTINE' AS zone,
     'No feed delivers files of this name' AS error_message FROM deliveries WHERE data_rows % 5 = 1""",
    "b4_empty_file": with_roles(DELIVERIES)
    + _ROW.format(
        status="CASE WHEN data_rows = 0 THEN 'FAIL' ELSE 'PASS' END", expected="'>= 1 data row'", actual="CAST(data_rows AS VARCHAR)", threshold=_NULL,
        details="CASE WHEN data_rows = 0 THEN 'nothing after the header' END", mandatory="'false'", where="",
    ),
    "b5_checksum_validation": with_roles(DELIVERIES)
    + _ROW.format(
        status="CASE WHEN manifest_checksum IS NULL THEN 'WARN' WHEN manifest_checksum = computed_checksum THEN 'PASS' ELSE 'FAIL' END",
        expected="coalesce(substr(manifest_checksum, 1, 16) || '…', 'manifest checksum')",
        actual="CASE WHEN manifest_checksum IS NULL THEN 'no manifest sidecar' WHEN manifest_checksum = computed_checksum THEN 'match' ELSE substr(computed_checksum, 1, 16) || '…' END",
        threshold=_NULL,
        details="CASE WHEN manifest_checksum IS NULL THEN 'no digest to compare with' WHEN manifest_checksum <> computed_checksum "
        "THEN 'content and control record have different digests' END",
        mandatory="'false'", where="WHERE data_rows > 0",
    ),
    "b6_schema_header": with_roles(DELIVERIES)
    + _ROW.format(
        status="CASE WHEN header = 'garbage' OR header NOT LIKE '%site_id%' OR header NOT LIKE '%emissions_co2e%' THEN 'FAIL' ELSE 'PASS' END",
        expected=f"'{_FULL}'",
        actual="CASE WHEN header = 'garbage' OR header NOT LIKE '%site_id%' OR header NOT LIKE '%emissions_co2e%' THEN header ELSE 'all required columns present' END",
        threshold=_NULL,
        details="CASE WHEN header = 'garbage' THEN 'header cannot be read' WHEN header NOT LIKE '%site_id%' THEN 'columns not delivered: site_id' "
        "WHEN header NOT LIKE '%emissions_co2e%' THEN 'columns not delivered: emissions_co2e' END",
        mandatory="CASE WHEN header <> 'garbage' AND header NOT LIKE '%site_id%' THEN 'true' ELSE 'false' END", where="WHERE data_rows > 0",
    ),
    "b7_row_count_control": with_roles(DELIVERIES)
    + _ROW.format(
        status="CASE WHEN data_rows = expected_rows THEN 'PASS' ELSE 'FAIL' END", expected="CAST(expected_rows AS VARCHAR)",
        actual="CAST(data_rows AS VARCHAR)", threshold="'0'",
        details="CASE WHEN data_rows <> expected_rows THEN (data_rows - expected_rows) || ' rows off the control record' END",
        mandatory="'false'", where="WHERE data_rows > 0 AND expected_rows IS NOT NULL",
    ),
    "b8_quarantine_decision": with_roles(DELIVERIES)
    + f"SELECT file_name, CASE WHEN reason IS NULL THEN 'VALIDATED' ELSE 'QUARANTINED' END AS file_status, reason AS error_message FROM ({_DECIDED})",
    "b9_hours_late": with_roles(DELIVERIES)
    + """SELECT batch_id, file_name, round(CAST(date_diff('second', expected_arrival_at, received_at) AS DOUBLE) / 3600.0, 2) AS hours_late FROM deliveries""",
    "b10_recent_deliveries": with_roles(DELIVERIES)
    + """SELECT dataset, file_name, position FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY expected_arrival_at DESC, file_name DESC) AS position
     FROM deliveries) WHERE position <= 7""",
}
