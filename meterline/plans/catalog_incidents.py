"""Incident event-log jobs and the runbook reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import incidents as inc
from meterline.operators import rowchecks as rc
from meterline.operators import runbook as rb
from meterline.plans import roles
from meterline.plans.catalog_ops import CONFIG, FILES, _feed_batches, file_log
from meterline.plans.catalog_rows import judged, staged, validated
from meterline.plans.oracle_roles import ALERTS, CHECKS, FACT, INCIDENTS, STAGED, TASKS, TRANSITIONS, with_roles
from meterline.plans.shape import flat

SWEEP = "2001-07-01 04:00:00"
BATCH, DAY = "B-20240105-01", "2024-01-05"
TASK_BATCH = "B-19980704-01"


def i1_lifecycle_fold(spark, sf):
    applied = inc.apply_transitions(roles.transitions(spark, sf), chunk=20)
    return flat(applied.drop("at"))


def i1_final_states(spark, sf):
    return inc.final_states(inc.apply_transitions(roles.transitions(spark, sf)))


def i2_escalation_sweep(spark, sf):
    swept = inc.escalate(roles.incidents(spark, sf), SWEEP)
    return flat(swept.select("incident_id", "status", "escalated_flag", "assigned_to", "updated_at"))


def i3_alert_derive(spark, sf):
    i = roles.incidents(spark, sf)
    due = inc.escalation_due(i, SWEEP)
    per_batch = (
        i.groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("incidents"), F.count_if("escalated_flag").alias("escalations"))
        .withColumns({"files": F.lit(3).cast("long"), "business_date": F.substring("batch_id", 3, 8)})
    )
    found = inc.incident_alerts(i).unionByName(inc.escalation_alerts(due, SWEEP)).unionByName(inc.completion_alerts(per_batch, SWEEP))
    return flat(found)


def i4_alert_ack(spark, sf):
    alerts = roles.alerts(spark, sf)
    wanted = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("alert_id"))
    acked = inc.acknowledge(alerts, wanted, SWEEP)
    return flat(acked.select("alert_id", "acknowledged_flag", "newly_acknowledged"))


def i4_ack_all(spark, sf):
    return inc.acknowledge(roles.alerts(spark, sf), None, SWEEP).agg(F.count_if("newly_acknowledged").alias("acknowledged"))


def i5_incident_detail(spark, sf):
    i = roles.incidents(spark, sf)
    li = roles.table(spark, sf, "lineitem")
    key = F.concat(F.lit("INC-"), F.col("l_orderkey").cast("string")).alias("incident_id")
    notes = li.select(
        key, F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("note_id"),
        F.concat(F.lit("note "), F.col("l_partkey").cast("string")).alias("note"),
    )
    evidence = li.select(
        key, F.col("l_shipdate").alias("created_at"), F.col("l_suppkey").alias("evidence_id"), F.col("l_returnflag").alias("evidence_type")
    )
    return flat(inc.incident_detail(i, notes, evidence).select("incident_id", "section", "place", "text"))


def i6_evidence_package(spark, sf):
    _, i = _feed_batches(spark, sf)
    tasks, _ = _feed_batches(spark, sf)
    lines = inc.evidence_lines(
        i, roles.checks(spark, sf), rc.rejected_rows(validated(spark, sf)), file_log(spark, sf), tasks
    ).filter("artefact <> 'escalation_handoff.md'")
    return lines.groupBy("batch_id", "incident_id", "artefact").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters")
    )


def i6_handoff_text(spark, sf):
    advice = {"SLA_BREACH": ("Consumers may read stale data.", ["Compare arrival with the window", "Ask the owner"])}
    return inc.handoff_lines(roles.incidents(spark, sf), advice)


def i7_incident_query(spark, sf):
    return flat(inc.incident_query(roles.incidents(spark, sf), status="OPEN", severity="P1").select("incident_id", "created_at"))


def i8_bulk_lifecycle(spark, sf):
    ids = roles.table(spark, sf, "customer").select(F.concat(F.lit("INC-"), F.col("c_custkey").cast("string")).alias("incident_id"))
    changed, notes = inc.bulk_lifecycle(roles.incidents(spark, sf), ids, "close", "checked", SWEEP)
    return flat(changed.select("incident_id", "status", "resolution_notes").join(notes.select("incident_id", "note"), "incident_id", "left"))


def i9_likely_causes(spark, sf):
    _, i = _feed_batches(spark, sf)
    return inc.likely_causes(i, roles.checks(spark, sf))


def j1_files_of_batch(spark, sf):
    return rb.files_of_batch(file_log(spark, sf), BATCH).select("file_name", "dataset", "file_status", "size_bytes", "computed_checksum")


def j2_checks_of_day(spark, sf):
    return flat(rb.checks_of_day(roles.checks(spark, sf), DAY, "file_arrival_check").select("check_id", "status", "severity", "actual_value"))


def j3_checks_of_batch_in(spark, sf):
    found = rb.checks_of_batch(roles.checks(spark, sf), BATCH, ["null_check_mandatory", "source_to_target_rowcount_recon"])
    return found.select("check_id", "check_name", "table_name", "column_name", "status", "actual_value")


def j4_incidents_of_batch(spark, sf):
    found = rb.incidents_of_batch(roles.incidents(spark, sf), ["CHECKSUM_MISMATCH", "FILE_CORRUPTED", "NULL_VALUES"], TASK_BATCH)
    return flat(found.select("incident_id", "incident_type", "severity", "status", "escalated_flag"))


def j4_latest_incidents(spark, sf):
    return flat(rb.incidents_of_batch(roles.incidents(spark, sf), ["SLA_BREACH"], newest=5).select("incident_id", "created_at"))


def j5_task_audit(spark, sf):
    found = rb.task_audit(roles.tasks(spark, sf), TASK_BATCH)
    return found.select("task_id", "status", "sequence", "rows_read", "rows_loaded", "rows_rejected", "error_message")


def j5_failed_tasks(spark, sf):
    found = rb.task_audit(roles.tasks(spark, sf), TASK_BATCH, status="FAILED")
    return flat(found.select("task_id", "job_name", "start_time", "duration_seconds", "error_message"))


def j6_staging_status_counts(spark, sf):
    return rb.staging_status(judged(spark, sf))


def j7_rejection_breakdown(spark, sf):
    return rb.rejection_breakdown(judged(spark, sf))


def j8_staging_duplicates(spark, sf):
    return rb.repeated(roles.feed(spark, sf), ["batch_id", "record_id"])


def j9_fact_duplicates(spark, sf):
    return flat(rb.repeated(roles.fact(spark, sf), ["record_id", "reading_date"]))


def j10_defective_rows(spark, sf):
    return flat(
        rb.defective_rows(staged(spark, sf), order=("source_file_name", "row_index")).select(
            "row_index", "record_id", "site_id", "reading_date", "energy_kwh", "emissions_co2e", "rejection_reason"
        )
    )


def j11_feeds_of_day(spark, sf):
    found = rb.feeds_of_day(file_log(spark, sf), DAY)
    return flat(found.select("file_name", "dataset", "expected_arrival_at", "received_at", "size_bytes", "file_status"))


def j12_failed_or_warn(spark, sf):
    return rb.failed_or_warned(roles.checks(spark, sf), BATCH).select("check_id", "check_name", "status", "severity", "error_details")


QUERIES = {
    f.__name__: f
    for f in (
        i1_lifecycle_fold, i1_final_states, i2_escalation_sweep, i3_alert_derive, i4_alert_ack, i4_ack_all, i5_incident_detail,
        i6_evidence_package, i6_handoff_text, i7_incident_query, i8_bulk_lifecycle, i9_likely_causes, j1_files_of_batch, j2_checks_of_day,
        j3_checks_of_batch_in, j4_incidents_of_batch, j4_latest_incidents, j5_task_audit, j5_failed_tasks, j6_staging_status_counts,
        j7_rejection_breakdown, j8_staging_duplicates, j9_fact_duplicates, j10_defective_rows, j11_feeds_of_day, j12_failed_or_warn,
    )
}

_FOLD = f"""WITH RECURSIVE {TRANSITIONS}, t AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY moment, seq) AS step FROM transitions),
 walk AS (SELECT incident_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS from_status, CAST(NULL AS VARCHAR) AS to_status,
  'OPEN' AS status FROM (SELECT DISTINCT incident_id FROM transitions)
 UNION ALL SELECT t.incident_id, t.step, t.seq, w.status, t.to_status, CASE WHEN (w.status = 'OPEN' AND t.to_status IN ('IN_PROGRESS', 'RESOLVED'))
  OR (w.status = 'IN_PROGRESS' AND t.to_status IN ('RESOLVED', 'OPEN')) OR (w.status = 'RESOLVED' AND t.to_status IN ('CLOSED', 'OPEN'))
  THEN t.to_status ELSE w.status END FROM walk w JOIN t ON t.incident_id = w.incident_id AND t.step = w.step + 1),
 steps AS (SELECT *, CASE WHEN from_status = to_status THEN 'unchanged' WHEN from_status = status THEN 'rejected' ELSE 'applied' END AS outcome
  FROM walk WHERE step > 0) """
_DUE = f"status IN ('OPEN', 'IN_PROGRESS') AND NOT escalated_flag AND created_at < TIMESTAMP '{SWEEP}' - INTERVAL 240 MINUTE"
_SHIFTED = """, si AS (SELECT * REPLACE ('B-' || strftime(created_at + INTERVAL 8186 DAY, '%Y%m%d') || '-01' AS batch_id) FROM incidents)"""
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"

ORACLE = {
    "i1_lifecycle_fold": _FOLD + "SELECT incident_id, step, seq, from_status, to_status, status, outcome FROM steps",
    "i1_final_states": _FOLD
    + """SELECT incident_id, arg_max(status, step) AS status, count(*) FILTER (outcome = 'applied') AS applied,
     count(*) FILTER (outcome = 'rejected') AS rejected, count(*) AS requests FROM steps GROUP BY 1""",
    "i2_escalation_sweep": with_roles(INCIDENTS)
    + f"""SELECT incident_id, status, CAST(escalated_flag OR d AS VARCHAR) AS escalated_flag,
     CASE WHEN d THEN 'Data Engineering L2' ELSE assigned_to END AS assigned_to, CASE WHEN d THEN '{SWEEP}' ELSE {_TS.format('updated_at')} END AS updated_at
     FROM (SELECT *, {_DUE} AS d FROM incidents)""",
    "i3_alert_derive": with_roles(INCIDENTS)
    + f""", a AS (SELECT {_TS.format('created_at')} AS created_at, batch_id, incident_type AS alert_type, severity, incident_id || ': ' || short_description AS message
      FROM incidents UNION ALL SELECT '{SWEEP}', batch_id, 'INCIDENT_ESCALATED', severity, incident_id || ' open longer than 240 min: ' || short_description
      FROM incidents WHERE {_DUE}
      UNION ALL SELECT '{SWEEP}', batch_id, 'PIPELINE_COMPLETED', 'WARN', 'Run ' || batch_id || ' of ' || substr(batch_id, 3, 8) || ': files 3, incidents '
      || count(*) || CASE WHEN count(*) FILTER (escalated_flag) > 0 THEN ', ' || count(*) FILTER (escalated_flag) || ' handed over' ELSE '' END
      FROM incidents GROUP BY batch_id)
     SELECT *, 'console,email_stub,webhook_stub' AS channels FROM a""",
    "i4_alert_ack": with_roles(ALERTS)
    + """SELECT alert_id, CAST(acknowledged_flag OR h AS VARCHAR) AS acknowledged_flag, CAST(h AND NOT acknowledged_flag AS VARCHAR) AS newly_acknowledged
     FROM (SELECT *, alert_id IN (SELECT c_custkey FROM customer) AS h FROM alerts)""",
    "i4_ack_all": with_roles(ALERTS) + "SELECT count(*) AS acknowledged FROM alerts WHERE NOT acknowledged_flag",
    "i5_incident_detail": with_roles(INCIDENTS)
    + """SELECT incident_id, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS place, severity || ' | ' || status || ' | ' || short_description AS text FROM incidents
     UNION ALL SELECT 'INC-' || l_orderkey, 1, -epoch_us(l_shipdate), 'note ' || l_partkey FROM lineitem
     UNION ALL SELECT 'INC-' || l_orderkey, 2, epoch_us(l_shipdate), l_returnflag FROM lineitem""",
    "i6_evidence_package": with_roles(INCIDENTS, CHECKS, FILES, STAGED, TASKS) + _SHIFTED
    + """, l AS (SELECT batch_id, CAST(NULL AS VARCHAR) AS incident_id, 'query_results.json' AS artefact, '{"check_name":"' || check_name || '","status":"' || status ||
       '","severity":"' || severity || '","expected_value":"0","actual_value":"' || actual_value || '","error_details":"' || error_details || '"}' AS line
      FROM checks WHERE status <> 'PASS'
      UNION ALL SELECT batch_id, NULL, 'files.json', '{"file_name":"' || file_name || '","dataset":"' || dataset || '","file_status":"' || file_status || '"}' FROM files
      UNION ALL SELECT 'B-' || strftime(start_time + INTERVAL 8186 DAY, '%Y%m%d') || '-01', NULL, 'tasks.json', '{"task_id":"' || task_id || '","status":"' || status || '"' ||
       coalesce(',"duration_seconds":' || CAST(duration_seconds AS VARCHAR), '') || coalesce(',"error_message":"' || error_message || '"', '') || '}' FROM tasks
      UNION ALL SELECT batch_id, NULL, 'failed_rows.json', '{"record_id":"' || record_id || '"' || coalesce(',"site_id":"' || nullif(site_id, '') || '"', '') ||
       ',"reading_date":"' || reading_date || '"' || coalesce(',"energy_kwh":' || CAST(TRY_CAST(nullif(energy_kwh, '1d') AS DOUBLE) AS VARCHAR), '') ||
       ',"emissions_co2e":' || CAST(CAST(emissions_co2e AS DOUBLE) AS VARCHAR) || ',"rejection_reason":"' || rejection_reason || '","source_file":"' || file_name || '"}'
      FROM staged WHERE rejection_reason IS NOT NULL
      UNION ALL SELECT batch_id, incident_id, 'incident_summary.json', '{"incident_id":"' || incident_id || '","severity":"' || severity || '","status":"' || status ||
       '","incident_type":"' || incident_type || '","short_description":"' || short_description || '","batch_id":"' || batch_id || '","run_id":"' || run_id ||
       '","affected":{"file":"' || affected_file || '","table":"' || affected_table || '"' || coalesce(',"check":"' || affected_check || '"', '') || '},"runbook":"' ||
       CASE incident_type WHEN 'FILE_MISSING' THEN 'RB001' WHEN 'EMPTY_FILE' THEN 'RB002' WHEN 'CHECKSUM_MISMATCH' THEN 'RB003' WHEN 'FILE_CORRUPTED' THEN 'RB003'
        WHEN 'SCHEMA_DRIFT' THEN 'RB004' WHEN 'ROW_COUNT_MISMATCH' THEN 'RB005' WHEN 'DUPLICATE_RECORDS' THEN 'RB006' WHEN 'NULL_VALUES' THEN 'RB007'
        WHEN 'RANGE_VIOLATION' THEN 'RB007' WHEN 'LOAD_FAILURE' THEN 'RB008' WHEN 'SLA_BREACH' THEN 'RB009' ELSE 'RB010' END || '"}' FROM si)
     SELECT batch_id, incident_id, artefact, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM l GROUP BY 1, 2, 3""",
    "i6_handoff_text": with_roles(INCIDENTS)
    + """, b AS (SELECT * FROM (VALUES ('FILE_MISSING', 'RB001 Missing File'), ('EMPTY_FILE', 'RB002 Empty File'),
       ('CHECKSUM_MISMATCH', 'RB003 Checksum Mismatch / Corrupted File'), ('FILE_CORRUPTED', 'RB003 Checksum Mismatch / Corrupted File'),
       ('SCHEMA_DRIFT', 'RB004 Schema Drift'), ('ROW_COUNT_MISMATCH', 'RB005 Row Count Mismatch'), ('DUPLICATE_RECORDS', 'RB006 Duplicate Records'),
       ('NULL_VALUES', 'RB007 Null / Invalid Values'), ('RANGE_VIOLATION', 'RB007 Null / Invalid Values'), ('LOAD_FAILURE', 'RB008 Load Failure'),
       ('SLA_BREACH', 'RB009 SLA Breach / Late File'), ('FRESHNESS_FAILURE', 'RB010 Freshness Failure')) v(incident_type, book))
     SELECT batch_id, incident_id, 'escalation_handoff.md' AS artefact, lpad(CAST(n - 1 AS VARCHAR), 4, '0') AS key, lines[n] AS line FROM
      (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT batch_id, incident_id, ['# Escalation handoff: ' || incident_id,
       '**Incident:** ' || short_description, '**Type:** ' || incident_type || ' | **Severity:** ' || severity || ' | **Status:** ' || status,
       '**Runbook:** ' || book, '**Impact:** ' || CASE WHEN incident_type = 'SLA_BREACH' THEN 'Consumers may read stale data.' ELSE 'Impact not assessed yet.' END,
       '- File: ' || affected_file, '- Table: ' || affected_table, '- Check: ' || coalesce(affected_check, 'n/a')] ||
       CASE WHEN incident_type = 'SLA_BREACH' THEN ['- Compare arrival with the window', '- Ask the owner'] ELSE [] END AS lines
       FROM incidents JOIN b USING (incident_type)))""",
    "i7_incident_query": with_roles(INCIDENTS)
    + f"""SELECT incident_id, {_TS.format('created_at')} AS created_at FROM (SELECT * FROM incidents WHERE status = 'OPEN' AND severity = 'P1'
     ORDER BY created_at DESC, incident_id DESC)""",
    "i8_bulk_lifecycle": with_roles(INCIDENTS)
    + """SELECT incident_id, CASE WHEN h THEN 'CLOSED' ELSE status END AS status, CASE WHEN h THEN 'checked' END AS resolution_notes,
     CASE WHEN h THEN 'Closed: checked' END AS note FROM
     (SELECT *, incident_number IN (SELECT c_custkey FROM customer) AS h FROM incidents)""",
    "i9_likely_causes": with_roles(INCIDENTS, CHECKS) + _SHIFTED
    + """, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY executed_at DESC, check_id DESC) AS place FROM checks
      WHERE status <> 'PASS') WHERE place <= 8),
     b AS (SELECT batch_id, count(*) AS n, string_agg('- ' || check_name || ': ' || coalesce(error_details, status), chr(10) ORDER BY place)
      FILTER (place <= 3) AS t FROM w GROUP BY 1)
     SELECT incident_id, coalesce(n, 0) AS checks_considered, coalesce(t, '- every check of this batch passed') AS causes
     FROM si LEFT JOIN b USING (batch_id)""",
    "j1_files_of_batch": with_roles(FILES)
    + f"SELECT file_name, dataset, file_status, size_bytes, computed_checksum FROM files WHERE batch_id = '{BATCH}'",
    "j2_checks_of_day": with_roles(CHECKS)
    + f"SELECT check_id, status, severity, actual_value FROM checks WHERE business_date = '{DAY}' AND check_name = 'file_arrival_check'",
    "j3_checks_of_batch_in": with_roles(CHECKS)
    + f"""SELECT check_id, check_name, table_name, column_name, status, actual_value FROM checks WHERE batch_id = '{BATCH}'
     AND check_name IN ('null_check_mandatory', 'source_to_target_rowcount_recon')""",
    "j4_incidents_of_batch": with_roles(INCIDENTS)
    + f"""SELECT incident_id, incident_type, severity, status, CAST(escalated_flag AS VARCHAR) AS escalated_flag FROM incidents
     WHERE batch_id = '{TASK_BATCH}' AND incident_type IN ('CHECKSUM_MISMATCH', 'FILE_CORRUPTED', 'NULL_VALUES')""",
    "j4_latest_incidents": with_roles(INCIDENTS)
    + f"""SELECT incident_id, {_TS.format('created_at')} AS created_at FROM (SELECT * FROM incidents WHERE incident_type = 'SLA_BREACH'
     ORDER BY created_at DESC, incident_id DESC LIMIT 5)""",
    "j5_task_audit": with_roles(TASKS)
    + f"SELECT task_id, status, sequence, rows_read, rows_loaded, rows_rejected, CASE WHEN status = 'FAILED' THEN 'error in ' || task_id END AS error_message FROM tasks WHERE batch_id = '{TASK_BATCH}'",
    "j5_failed_tasks": with_roles(TASKS)
    + f"""SELECT task_id, job_name, {_TS.format('start_time')} AS start_time, duration_seconds, error_message FROM tasks
     WHERE batch_id = '{TASK_BATCH}' AND status = 'FAILED'""",
    "j6_staging_status_counts": with_roles(STAGED)
    + "SELECT batch_id, dataset, validation_status, count(*) AS row_count FROM staged GROUP BY 1, 2, 3",
    "j7_rejection_breakdown": with_roles(STAGED)
    + "SELECT batch_id, validation_status, rejection_reason, count(*) AS row_count FROM staged GROUP BY 1, 2, 3",
    "j8_staging_duplicates": with_roles(STAGED)
    + """SELECT batch_id, record_id, count(*) AS occurrences FROM feed GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY occurrences DESC, batch_id, record_id""",
    "j9_fact_duplicates": with_roles(FACT)
    + """SELECT record_id, strftime(reading_date, '%Y-%m-%d') AS reading_date, count(*) AS occurrences FROM fact GROUP BY 1, 2 HAVING count(*) > 1
     ORDER BY occurrences DESC, record_id, reading_date""",
    "j10_defective_rows": with_roles(STAGED)
    + """SELECT row_index, record_id, nullif(site_id, '') AS site_id, CASE WHEN date_reason IS NULL THEN reading_date END AS reading_date,
     CAST(energy_num AS DOUBLE) AS energy_kwh, CAST(emissions_num AS DOUBLE) AS emissions_co2e, rejection_reason FROM staged
     WHERE site_id = '' OR date_reason IS NOT NULL OR energy_num IS NULL OR energy_num < 0 OR emissions_num IS NULL ORDER BY file_name, row_index""",
    "j11_feeds_of_day": with_roles(FILES)
    + f"""SELECT file_name, dataset, {_TS.format('expected_arrival_at')} AS expected_arrival_at, {_TS.format('received_at')} AS received_at, size_bytes, file_status
     FROM files WHERE business_date = '{DAY}'""",
    "j12_failed_or_warn": with_roles(CHECKS)
    + f"SELECT check_id, check_name, status, severity, error_details FROM checks WHERE batch_id = '{BATCH}' AND status IN ('FAIL', 'WARN')",
}
