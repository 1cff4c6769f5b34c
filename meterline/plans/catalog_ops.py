"""Operational analytics over orders (tasks, incidents, alerts) and events (checks, files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import metrics as mt
from meterline.operators import ops
from meterline.operators import sites as st
from meterline.operators.recon import rowcount_recon
from meterline.plans import roles
from meterline.plans.catalog_rows import judged, staged, validated
from meterline.plans.catalog_sites import sql_round, two
from meterline.plans.catalog_warehouse import _TOTALS, _sides, _starts
from meterline.plans.oracle_roles import ALERTS, CHECKS, DELIVERIES, FACT, INCIDENTS, STAGED, TASKS, with_roles
from meterline.plans.shape import flat

CONFIG = roles.readings_config()
AS_OF = "2001-08-02 00:00:00"
FEED_AS_OF = "2024-01-25 12:00:00"
TASK_DAY, FEED_DAY = "2001-08-01", "2024-01-20"


def file_log(spark, sf):
    """The deliveries as an ingestion log: empty files are quarantined, the rest processed."""
    d = roles.deliveries(spark, sf)
    return d.withColumn(
        "file_status",
        F.when(F.col("data_rows") == 0, "QUARANTINED").when(F.size("header") < 3, "FAILED").otherwise("PROCESSED"),
    ).withColumn("created_at", F.col("received_at"))


def shifted_tasks(spark, sf):
    """Task and incident times moved so that their last days meet the feed's."""
    return roles.tasks(spark, sf).withColumn("start_time", F.col("start_time") + F.expr("INTERVAL 8186 DAYS"))


def shifted_incidents(spark, sf):
    return roles.incidents(spark, sf).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 8186 DAYS"))


def h1_jobs_24h(spark, sf):
    return ops.jobs_last_day(roles.tasks(spark, sf), AS_OF)


def h1_files_24h(spark, sf):
    log = file_log(spark, sf)
    return ops.files_last_day(log, log.filter("in_landing"), FEED_AS_OF)


def h2_open_by_severity(spark, sf):
    return ops.open_by_severity(roles.incidents(spark, sf))


def _trend(spark, sf):
    return ops.daily_trend(
        shifted_tasks(spark, sf), roles.checks(spark, sf), file_log(spark, sf), shifted_incidents(spark, sf), FEED_DAY
    )


def h3_daily_trend(spark, sf):
    return flat(_trend(spark, sf))


def h4_batch_summary(spark, sf):
    return flat(ops.batch_summary(roles.tasks(spark, sf), roles.incidents(spark, sf)))


def h5_check_summary(spark, sf):
    return ops.check_summary(roles.checks(spark, sf), "2024-01-11 00:00:00")


def h6_fails_by_severity(spark, sf):
    return flat(ops.fails_by_severity(roles.checks(spark, sf)))


def h7_batch_timeline(spark, sf):
    return flat(ops.batch_timeline(roles.tasks(spark, sf)))


def _batch_status(spark, sf):
    return rowcount_recon(_sides(spark, sf)).join(_starts(spark, sf), "batch_id")


def h8_health_rollup(spark, sf):
    recon = _batch_status(spark, sf)
    return flat(ops.health_rollup(roles.tasks(spark, sf), roles.checks(spark, sf), roles.incidents(spark, sf), recon))


def h9_sla_status_today(spark, sf):
    log = file_log(spark, sf)
    days = log.select(F.to_date("business_date").alias("day")).distinct()
    got = log.filter("in_landing").select("dataset", F.to_date("business_date").alias("day"))
    as_of = F.lit("2024-01-25 10:00:00").cast("timestamp")
    return flat(ops.sla_status(days, CONFIG.manifest_table(spark), got, as_of))


def h10_daily_ops_report(spark, sf):
    return ops.daily_report(
        file_log(spark, sf).filter("in_log"), shifted_tasks(spark, sf), roles.checks(spark, sf), shifted_incidents(spark, sf),
        roles.EVENT_TYPES,
    )


def h11_day_over_day(spark, sf):
    return flat(ops.day_over_day(_trend(spark, sf)))


def h12_rolling_pass_rate(spark, sf):
    return ops.rolling_pass_rate(roles.checks(spark, sf))


def h13_check_history(spark, sf):
    return flat(ops.check_history(roles.checks(spark, sf), CONFIG, 50))


def h13_check_trend(spark, sf):
    return ops.check_trend(ops.check_history(roles.checks(spark, sf), CONFIG, 40))


def h14_mttr(spark, sf):
    return ops.mttr(roles.incidents(spark, sf))


def h15_incident_age(spark, sf):
    return ops.with_age(roles.incidents(spark, sf), AS_OF).select("incident_id", "age_minutes")


def h15_mean_age(spark, sf):
    return ops.mean_age(ops.with_age(roles.incidents(spark, sf), AS_OF))


def h16_alert_stats(spark, sf):
    return ops.alert_stats(roles.alerts(spark, sf))


def h16_alerts_by_severity(spark, sf):
    return ops.alerts_by_severity(roles.alerts(spark, sf))


def h17_subscription_preview(spark, sf):
    types = {"FILE_MISSING": True, "SCHEMA_DRIFT": True, "LOAD_FAILURE": False, "SLA_BREACH": True}
    return ops.subscription_preview(roles.alerts(spark, sf), types, {"P1": True, "P2": True, "P3": False})


def h18_status_filters(spark, sf):
    return ops.facet_filter(roles.incidents(spark, sf), status="ACTIVE", severity="P2", batch_id="ALL").select(
        "incident_id", "status", "severity"
    )


def h18_alert_filters(spark, sf):
    return ops.facet_filter(roles.alerts(spark, sf), severity="P1", alert_type="ALL", acknowledged_flag="UNACKED").select("alert_id", "alert_type")


def h18_run_filters(spark, sf):
    return ops.facet_filter(roles.tasks(spark, sf), status="FAILED", task_id="1-URGENT", batch_id="ALL").select("run_id", "batch_id")


def h18_check_filters(spark, sf):
    return ops.facet_filter(roles.checks(spark, sf), status="WARN", check_name="file_arrival_check").select("check_id", "severity")


def h18_file_status_counts(spark, sf):
    return ops.facet_counts(file_log(spark, sf), "file_status")


def h19_incident_calendar(spark, sf):
    batches = ops.batch_summary(roles.tasks(spark, sf), roles.incidents(spark, sf), newest=None)
    return flat(ops.incident_calendar(roles.incidents(spark, sf), batches))


def h20_pass_rate(spark, sf):
    return ops.pass_rate(roles.checks(spark, sf))


def _feed_batches(spark, sf):
    """Task, incident and alert batch ids moved onto the feed's calendar."""
    stamp = F.concat(F.lit("B-"), F.date_format(F.col("_t"), "yyyyMMdd"), F.lit("-01"))
    t = shifted_tasks(spark, sf).withColumn("_t", F.col("start_time")).withColumn("batch_id", stamp).drop("_t")
    shift = F.when(F.col("duration_seconds").isNotNull(), F.col("start_time") + F.make_dt_interval(secs=F.col("duration_seconds").cast("decimal(18,6)")))
    t = t.withColumn("end_time", shift)
    i = shifted_incidents(spark, sf).withColumn("_t", F.col("created_at")).withColumn("batch_id", stamp).drop("_t")
    return t, i


def _lineage(spark, sf):
    tasks, incidents = _feed_batches(spark, sf)
    rows = staged(spark, sf)
    fact = rows.filter("validation_status = 'VALID' and dataset = 'click' and energy_kwh < 400")
    return ops.batch_lineage(
        tasks, file_log(spark, sf), rows, roles.checks(spark, sf), incidents, fact, incidents.select("batch_id"),
        energy="click", carbon="view",
    )


def h21_batch_lineage(spark, sf):
    return flat(_lineage(spark, sf))


def h21_incident_counts(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    c = roles.table(spark, sf, "customer")
    notes = li.select(F.concat(F.lit("INC-"), F.col("l_orderkey").cast("string")).alias("incident_id"))
    evidence = c.select(F.concat(F.lit("INC-"), F.col("c_custkey").cast("string")).alias("incident_id"))
    return ops.incident_counts(roles.incidents(spark, sf), notes, evidence)


def h21_rejection_reasons(spark, sf):
    return ops.rejection_reasons(validated(spark, sf))


LEFT, RIGHT = "B-20240105-01", "B-20240106-01"


def h22_batch_compare(spark, sf):
    return ops.check_diff(roles.checks(spark, sf), LEFT, RIGHT)


def h22_compare_metrics(spark, sf):
    lineage = _lineage(spark, sf)
    return flat(ops.compare_batches(lineage, LEFT, RIGHT).drop("started_at"))


def h22_batch_sides(spark, sf):
    side = ops.batch_side(roles.tasks(spark, sf))
    return flat(side.drop("ended_at"))


def h23_shift_context(spark, sf):
    return ops.shift_context(roles.tasks(spark, sf), AS_OF)


def h23_shift_summary(spark, sf):
    return ops.shift_summary(
        roles.tasks(spark, sf), roles.incidents(spark, sf), roles.alerts(spark, sf), roles.checks(spark, sf), AS_OF
    )


def h24_queue_lines(spark, sf):
    return flat(ops.queue_lines(ops.queue_summary(roles.incidents(spark, sf))))


def h24_queue_summary(spark, sf):
    return ops.queue_summary(roles.incidents(spark, sf))


def h25_escalation_remaining(spark, sf):
    aged = ops.with_age(roles.incidents(spark, sf), "2001-08-01 03:00:00")
    return ops.escalation_remaining(aged)


def _performance(spark, sf):
    t = roles.tasks(spark, sf).filter("duration_seconds is not null")
    return t.select(
        F.col("end_time").alias("timestamp"), F.col("task_id").alias("task_name"), "batch_id", "run_id",
        (F.col("duration_seconds") * 300).alias("duration_ms"), F.col("rows_read").alias("records_processed"),
        mt.throughput(F.col("rows_read"), F.col("duration_seconds") * 300).alias("throughput"), "status",
    )


def _quality(spark, sf):
    return mt.quality_metrics(judged(spark, sf).withColumnRenamed("ts", "load_timestamp"))


def h26_perf_summary(spark, sf):
    return mt.performance_summary(_performance(spark, sf))


def h27_metric_sla_violations(spark, sf):
    found = mt.sla_violations(_quality(spark, sf), _performance(spark, sf))
    return found.select("component", "batch_id", "metric", "expected_value", "actual_value", "severity")


def h28_quality_trend(spark, sf):
    return mt.quality_trend(_quality(spark, sf), "click").select(
        "dataset", "batch_id", "total_records", "valid_records", "rejected_records", "quality_score"
    )


def h29_last_load(spark, sf):
    return flat(ops.last_load(roles.fact(spark, sf), roles.sites(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        h1_jobs_24h, h1_files_24h, h2_open_by_severity, h3_daily_trend, h4_batch_summary, h5_check_summary, h6_fails_by_severity,
        h7_batch_timeline, h8_health_rollup, h9_sla_status_today, h10_daily_ops_report, h11_day_over_day, h12_rolling_pass_rate,
        h13_check_history, h13_check_trend, h14_mttr, h15_incident_age, h15_mean_age, h16_alert_stats, h16_alerts_by_severity,
        h17_subscription_preview, h18_status_filters, h18_alert_filters, h18_run_filters, h18_check_filters,
        h18_file_status_counts, h19_incident_calendar, h20_pass_rate,
        h21_batch_lineage, h21_incident_counts, h21_rejection_reasons, h22_batch_compare, h22_compare_metrics, h22_batch_sides,
        h23_shift_context, h23_shift_summary, h24_queue_summary, h24_queue_lines,
        h25_escalation_remaining, h26_perf_summary, h27_metric_sla_violations, h28_quality_trend, h29_last_load,
    )
}

_OPEN = "status IN ('OPEN', 'IN_PROGRESS')"
_SEV = ", ".join(f"count(*) FILTER ({_OPEN} AND severity = 'P{i}') AS P{i}" for i in (1, 2, 3, 4))
FILES = DELIVERIES + """, files AS (SELECT *, CASE WHEN data_rows = 0 THEN 'QUARANTINED' WHEN header = 'garbage' THEN 'FAILED' ELSE 'PROCESSED' END
 AS file_status, received_at AS created_at FROM deliveries)"""
_SHIFT = """, st AS (SELECT *, CAST(start_time + INTERVAL 8186 DAY AS DATE) AS day FROM tasks),
 si AS (SELECT *, CAST(created_at + INTERVAL 8186 DAY AS DATE) AS day FROM incidents)"""
_DAYS = f"""{with_roles(TASKS, INCIDENTS, CHECKS, FILES)}{_SHIFT}, cal AS (SELECT DATE '{FEED_DAY}' - 13 + CAST(i AS INTEGER) AS day FROM range(14) t(i)),
 trend AS (SELECT day, (SELECT count(*) FROM st WHERE st.day = cal.day AND status = 'SUCCESS') AS jobs_success,
  (SELECT count(*) FROM st WHERE st.day = cal.day AND status = 'FAILED') AS jobs_failed,
  (SELECT count(*) FROM checks WHERE business_date = CAST(cal.day AS VARCHAR) AND status = 'PASS') AS dq_pass,
  (SELECT count(*) FROM checks WHERE business_date = CAST(cal.day AS VARCHAR) AND status = 'FAIL') AS dq_fail,
  (SELECT count(DISTINCT dataset) FROM files WHERE business_date = CAST(cal.day AS VARCHAR)) AS files_received,
  (SELECT count(*) FROM files WHERE business_date = CAST(cal.day AS VARCHAR) AND file_status = 'QUARANTINED') AS files_quarantined,
  (SELECT count(*) FROM si WHERE si.day = cal.day) AS incidents FROM cal)"""
_PCT = "CAST(floor(CAST({p} AS DOUBLE) / {n} * 100.0 + 0.5) AS BIGINT)"
_BATCHES = f"""{with_roles(TASKS, INCIDENTS)}, b AS (SELECT batch_id, substr(batch_id, 3, 4) || '-' || substr(batch_id, 7, 2) || '-' || substr(batch_id, 9, 2)
  AS business_date, min(start_time) AS started_at, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS tasks
  FROM tasks GROUP BY 1)"""
_PERF = with_roles(TASKS) + """, perf AS (SELECT batch_id, task_id AS task, duration_seconds * 300 AS ms, status,
 CASE WHEN duration_seconds > 0 THEN floor(rows_read / (duration_seconds * 300) * 1000 + 0.5) END AS tp FROM tasks WHERE duration_seconds IS NOT NULL)"""
_QUALITY = f""", quality AS (SELECT dataset, batch_id, count(*) AS total_records, count(*) FILTER (validation_status = 'VALID') AS valid_records,
 count(*) FILTER (validation_status <> 'VALID') AS rejected_records, {sql_round("100.0 * count(*) FILTER (validation_status = 'VALID') / count(*)")}
 AS quality_score FROM staged GROUP BY 1, 2)"""
_SIDE = f"""min(start_time) AS started_at, max(end_time) AS ended_at, count(*) AS tasks, count(*) FILTER (status = 'FAILED') AS failed_tasks,
 count(*) FILTER (status = 'SKIPPED') AS skipped_tasks, coalesce({two("epoch_us(max(end_time)) / 1000000.0 - epoch_us(min(start_time)) / 1000000.0", 10.0)},
 {two('sum(duration_seconds)', 10.0)}, 0) AS duration_seconds"""

ORACLE = {
    "h1_jobs_24h": with_roles(TASKS)
    + f"""SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed,
     count(*) FILTER (status = 'SKIPPED') AS skipped FROM tasks WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR""",
    "h1_files_24h": with_roles(FILES)
    + f""", r AS (SELECT * FROM files WHERE created_at >= TIMESTAMP '{FEED_AS_OF}' - INTERVAL 24 HOUR)
     SELECT count(*) FILTER (file_status = 'QUARANTINED') AS quarantined, count(*) FILTER (file_status = 'PROCESSED') AS processed,
     (SELECT count(*) FROM (SELECT dataset FROM r UNION SELECT dataset FROM files WHERE in_landing)) AS received FROM r""",
    "h2_open_by_severity": with_roles(INCIDENTS) + f"SELECT count(*) FILTER ({_OPEN}) AS active, {_SEV} FROM incidents",
    "h3_daily_trend": _DAYS
    + """SELECT strftime(day, '%Y-%m-%d') AS day, jobs_success, jobs_failed, dq_pass, dq_fail, files_received, files_quarantined, incidents FROM trend""",
    "h4_batch_summary": _BATCHES
    + """SELECT b.batch_id, business_date, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, b.status, tasks,
     (SELECT count(*) FROM incidents i WHERE i.batch_id = b.batch_id) AS incidents FROM b ORDER BY b.started_at DESC, b.batch_id DESC LIMIT 15""",
    "h5_check_summary": with_roles(CHECKS)
    + f"""SELECT *, {_PCT.format(p='pass', n='total')} AS pass_pct FROM (SELECT check_name, count(*) FILTER (status = 'PASS') AS pass,
     count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'WARN') AS warn, count(*) AS total FROM checks
     WHERE executed_at >= TIMESTAMP '2024-01-11' GROUP BY 1)""",
    "h6_fails_by_severity": with_roles(CHECKS)
    + """SELECT severity, count(*) AS count, CAST(CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END
     AS BIGINT) AS position FROM checks WHERE status = 'FAIL' GROUP BY 1""",
    "h7_batch_timeline": with_roles(TASKS)
    + f""", s AS (SELECT batch_id, min(start_time) AS batch_start, {two('sum(duration_seconds)')} AS total_duration_seconds FROM tasks
      WHERE duration_seconds IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 8)
     SELECT batch_id, strftime(batch_start, '%Y-%m-%d %H:%M:%S') AS batch_start, total_duration_seconds, task_id, sequence,
     (epoch_us(start_time) - epoch_us(s.batch_start)) / 1000000.0 AS start_seconds, duration_seconds, status
     FROM tasks JOIN s USING (batch_id) WHERE duration_seconds IS NOT NULL""",
    "h8_health_rollup": with_roles(TASKS, INCIDENTS, CHECKS, FACT) + _TOTALS
    + f""", latest AS (SELECT batch_id FROM tasks ORDER BY start_time DESC, batch_id DESC LIMIT 1),
     s AS (SELECT batch_id, min(start_time) AS t FROM tasks GROUP BY 1),
     x AS (SELECT (SELECT batch_id FROM latest) AS last_batch_id, (SELECT bool_or(status = 'FAILED') FROM tasks WHERE batch_id IN (FROM latest)) AS failed,
      (SELECT count(*) FROM checks WHERE status <> 'PASS' AND batch_id IN (FROM latest)) AS weak,
      (SELECT CASE WHEN source_count = target_count THEN 'PASS' ELSE 'FAIL' END FROM totals JOIN s USING (batch_id) ORDER BY t DESC, batch_id DESC LIMIT 1) AS recon,
      {_SEV} FROM incidents),
     y AS (SELECT *, failed OR P1 > 0 OR P2 > 0 OR recon = 'FAIL' AS red FROM x)
     SELECT last_batch_id, CASE WHEN red THEN 'RED' WHEN P3 > 0 OR weak > 0 THEN 'AMBER' ELSE 'GREEN' END AS health,
     coalesce(nullif(concat_ws(',', CASE WHEN failed THEN 'a task of the newest batch failed' END, CASE WHEN P1 > 0 THEN P1 || ' unresolved at P1' END,
      CASE WHEN P2 > 0 THEN P2 || ' unresolved at P2' END, CASE WHEN recon = 'FAIL' THEN 'the newest reconciliation does not balance' END,
      CASE WHEN NOT red AND P3 > 0 THEN P3 || ' unresolved at P3' END, CASE WHEN NOT red AND weak > 0 THEN weak || ' checks of the newest batch not passed' END), ''),
      'nothing to report') AS reasons FROM y""",
    "h9_sla_status_today": with_roles(FILES)
    + """, d AS (SELECT DISTINCT business_date AS day FROM files), m AS (SELECT DISTINCT unnest(['click','view','purchase','error','signup']) AS dataset),
     x AS (SELECT d.day, CAST(d.day AS TIMESTAMP) + INTERVAL 630 MINUTE AS deadline, coalesce(string_agg(m.dataset, ',' ORDER BY m.dataset)
      FILTER (f.dataset IS NULL), '') AS missing FROM d CROSS JOIN m LEFT JOIN (SELECT DISTINCT dataset, business_date FROM files WHERE in_landing) f
      ON f.dataset = m.dataset AND f.business_date = d.day GROUP BY 1)
     SELECT day, CASE WHEN missing = '' THEN 'OK' WHEN TIMESTAMP '2024-01-25 10:00:00' < deadline THEN 'PENDING' ELSE 'BREACHED' END AS sla_status,
     missing, strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline FROM x""",
    "h10_daily_ops_report": with_roles(TASKS, INCIDENTS, CHECKS, FILES) + _SHIFT
    + f""", t AS (SELECT CAST(day AS VARCHAR) AS d, count(*) AS je, count(*) FILTER (status = 'SUCCESS') AS js, count(*) FILTER (status = 'FAILED') AS jf
      FROM st GROUP BY 1),
     c AS (SELECT business_date AS d, count(*) AS ce, count(*) FILTER (status = 'PASS') AS cp, count(*) FILTER (status = 'FAIL') AS cf,
      arg_max(status, (executed_at, check_id)) FILTER (check_name = 'source_to_target_rowcount_recon') AS rc FROM checks GROUP BY 1),
     f AS (SELECT business_date AS d, count(DISTINCT dataset) AS fr, count(*) FILTER (file_status = 'QUARANTINED') AS fq FROM files WHERE in_log GROUP BY 1),
     i AS (SELECT CAST(day AS VARCHAR) AS d, count(*) FILTER ({_OPEN}) AS oi, {_SEV} FROM si GROUP BY 1),
     x AS (SELECT coalesce(t.d, c.d, f.d, i.d) AS d, coalesce(fr, 0) AS fr, coalesce(fq, 0) AS fq, coalesce(je, 0) AS je, coalesce(js, 0) AS js,
      coalesce(jf, 0) AS jf, coalesce(ce, 0) AS ce, coalesce(cp, 0) AS cp, coalesce(cf, 0) AS cf, coalesce(oi, 0) AS oi, coalesce(P1, 0) AS p1,
      coalesce(P2, 0) AS p2, coalesce(P3, 0) AS p3, CASE WHEN rc IS NULL THEN 'NO_DATA' WHEN rc = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS rs
      FROM t FULL JOIN c ON t.d = c.d FULL JOIN f ON coalesce(t.d, c.d) = f.d FULL JOIN i ON coalesce(t.d, c.d, f.d) = i.d)
     SELECT d AS report_date, CAST(5 AS BIGINT) AS files_expected, fr AS files_received, fq AS files_quarantined, je AS jobs_executed, js AS jobs_succeeded,
     jf AS jobs_failed, ce AS dq_checks_executed, cp AS dq_checks_passed, cf AS dq_checks_failed, oi AS open_incidents, p1 AS p1_incidents,
     p2 AS p2_incidents, rs AS reconciliation_status, CASE WHEN jf > 0 OR p1 > 0 OR p2 > 0 OR rs = 'FAIL' OR fr < 5 THEN 'RED'
     WHEN cf > 0 OR p3 > 0 OR fq > 0 THEN 'AMBER' ELSE 'GREEN' END AS overall_health FROM x""",
    "h11_day_over_day": _DAYS
    + """, p AS (SELECT * FROM trend)
     SELECT strftime(a.day, '%Y-%m-%d') AS day, (a.jobs_success + a.jobs_failed) - (b.jobs_success + b.jobs_failed) AS jobs_delta,
     a.incidents - b.incidents AS incidents_delta, a.files_received - b.files_received AS files_delta, a.dq_fail - b.dq_fail AS dq_fail_delta
     FROM p a LEFT JOIN p b ON b.day = a.day - 1""",
    "h12_rolling_pass_rate": with_roles(CHECKS)
    + f"""SELECT check_name, check_id, run_number, status, {_PCT.format(p='p', n='n')} AS rate FROM (SELECT *,
     row_number() OVER (PARTITION BY check_name ORDER BY executed_at, check_id) AS run_number,
     count(*) FILTER (status = 'PASS') OVER w AS p, count(*) OVER w AS n FROM checks
     WINDOW w AS (PARTITION BY check_name ORDER BY executed_at, check_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
    "h13_check_history": with_roles(CHECKS)
    + """SELECT check_name, position, check_id, status, CASE check_name WHEN 'duplicate_record_check' THEN 'UNIQUENESS'
     WHEN 'source_to_target_rowcount_recon' THEN 'RECONCILIATION' WHEN 'custom_check' THEN NULL ELSE 'COMPLETENESS' END AS rule_category,
     CASE check_name WHEN 'duplicate_record_check' THEN 'MEDIUM' WHEN 'null_check_mandatory' THEN 'HIGH' WHEN 'custom_check' THEN NULL
      ELSE 'CRITICAL' END AS rule_severity,
     CASE check_name WHEN 'duplicate_record_check' THEN 'DUPLICATE_RECORDS' WHEN 'null_check_mandatory' THEN 'NULL_VALUES'
      WHEN 'file_arrival_check' THEN 'FILE_MISSING' WHEN 'source_to_target_rowcount_recon' THEN 'ROW_COUNT_MISMATCH' END AS incident_type,
     CASE check_name WHEN 'duplicate_record_check' THEN 'RB006' WHEN 'null_check_mandatory' THEN 'RB007' WHEN 'file_arrival_check' THEN 'RB001'
      WHEN 'source_to_target_rowcount_recon' THEN 'RB005' END AS runbook_id,
     CASE check_name WHEN 'duplicate_record_check' THEN 'Duplicate Records' WHEN 'null_check_mandatory' THEN 'Null / Invalid Values'
      WHEN 'file_arrival_check' THEN 'Missing File' WHEN 'source_to_target_rowcount_recon' THEN 'Row Count Mismatch' END AS runbook_title
     FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY executed_at DESC, check_id DESC) AS position FROM checks) WHERE position <= 50""",
    "h13_check_trend": with_roles(CHECKS)
    + """SELECT check_name, count(*) AS examined, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail,
     count(*) FILTER (status = 'WARN') AS warn FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY executed_at DESC, check_id DESC)
      AS position FROM checks) WHERE position <= 40 GROUP BY 1""",
    "h14_mttr": with_roles(INCIDENTS)
    + """SELECT count(*) AS resolved, CAST(floor(CAST(sum(epoch_us(updated_at) - epoch_us(created_at)) AS DOUBLE) / 60000000.0 / count(*) + 0.5) AS BIGINT)
     AS mttr_minutes FROM incidents WHERE status IN ('RESOLVED', 'CLOSED')""",
    "h15_incident_age": with_roles(INCIDENTS)
    + f"""SELECT incident_id, greatest(0, date_diff('minute', created_at, TIMESTAMP '{AS_OF}')) AS age_minutes FROM incidents""",
    "h15_mean_age": with_roles(INCIDENTS)
    + f"""SELECT count(*) AS active, CAST(floor(CAST(sum(greatest(0, date_diff('minute', created_at, TIMESTAMP '{AS_OF}'))) AS DOUBLE) / count(*) + 0.5)
     AS BIGINT) AS avg_age_minutes FROM incidents WHERE {_OPEN}""",
    "h16_alert_stats": with_roles(ALERTS)
    + f"""SELECT total, unacknowledged, critical, high, CASE WHEN total > 0 THEN {_PCT.format(p='(total - unacknowledged)', n='total')} ELSE 100 END AS ack_pct
     FROM (SELECT count(*) AS total, count(*) FILTER (NOT acknowledged_flag) AS unacknowledged, count(*) FILTER (severity IN ('CRITICAL', 'P1')) AS critical,
      count(*) FILTER (severity IN ('HIGH', 'P2')) AS high FROM alerts)""",
    "h16_alerts_by_severity": with_roles(ALERTS) + "SELECT severity, count(*) AS count FROM alerts GROUP BY 1",
    "h17_subscription_preview": with_roles(ALERTS)
    + """SELECT count(*) FILTER (s) AS shown, count(*) FILTER (NOT s) AS hidden FROM (SELECT alert_type IN ('FILE_MISSING', 'SCHEMA_DRIFT', 'SLA_BREACH')
     AND severity IN ('P1', 'P2') AS s FROM alerts)""",
    "h18_status_filters": with_roles(INCIDENTS) + f"SELECT incident_id, status, severity FROM incidents WHERE {_OPEN} AND severity = 'P2'",
    "h18_alert_filters": with_roles(ALERTS) + "SELECT alert_id, alert_type FROM alerts WHERE severity = 'P1' AND NOT acknowledged_flag",
    "h18_run_filters": with_roles(TASKS) + "SELECT run_id, batch_id FROM tasks WHERE status = 'FAILED' AND task_id = '1-URGENT'",
    "h18_check_filters": with_roles(CHECKS) + "SELECT check_id, severity FROM checks WHERE status = 'WARN' AND check_name = 'file_arrival_check'",
    "h18_file_status_counts": with_roles(FILES) + "SELECT file_status, count(*) AS count FROM files GROUP BY 1",
    "h19_incident_calendar": _BATCHES
    + """, d AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS incidents FROM incidents GROUP BY 1)
     SELECT day, incidents, arg_max(status, (started_at, batch_id)) AS batch_status, (SELECT CAST(sum(incidents) AS BIGINT) FROM d) AS total_incidents,
     CAST(day = (SELECT day FROM d ORDER BY incidents DESC, day LIMIT 1) AS VARCHAR) AS is_busiest
     FROM d LEFT JOIN b ON b.business_date = d.day GROUP BY day, incidents""",
    "h20_pass_rate": with_roles(CHECKS)
    + f"SELECT executed, passed, {_PCT.format(p='passed', n='executed')} AS pass_pct FROM (SELECT count(*) AS executed, count(*) FILTER (status = 'PASS') AS passed FROM checks)",
    "h21_batch_lineage": with_roles(TASKS, INCIDENTS, CHECKS, FILES, STAGED.replace("feed AS", "feed AS", 1))
    + f""", st AS (SELECT * REPLACE ('B-' || strftime(start_time + INTERVAL 8186 DAY, '%Y%m%d') || '-01' AS batch_id, start_time + INTERVAL 8186 DAY AS start_time,
      end_time + INTERVAL 8186 DAY AS end_time) FROM tasks),
     si AS (SELECT * REPLACE ('B-' || strftime(created_at + INTERVAL 8186 DAY, '%Y%m%d') || '-01' AS batch_id) FROM incidents),
     t AS (SELECT batch_id, {_SIDE} FROM st GROUP BY 1),
     f AS (SELECT batch_id, count(*) AS files, count(*) FILTER (file_status = 'QUARANTINED') AS files_quarantined FROM files GROUP BY 1),
     i AS (SELECT batch_id, count(*) AS incidents, count(*) FILTER ({_OPEN}) AS open_incidents FROM si GROUP BY 1),
     s AS (SELECT batch_id, count(*) FILTER (dataset = 'click' AND validation_status = 'VALID') AS ev, count(*) FILTER (dataset = 'click' AND validation_status <> 'VALID') AS er,
      count(*) FILTER (dataset = 'view' AND validation_status = 'VALID') AS cv, count(*) FILTER (dataset = 'view' AND validation_status <> 'VALID') AS cr,
      count(DISTINCT rejection_reason) AS rr, sum(energy_num) FILTER (dataset = 'click' AND validation_status = 'VALID') AS se,
      count(*) FILTER (dataset = 'click' AND validation_status = 'VALID' AND energy_num < 400) AS tc,
      sum(energy_num) FILTER (dataset = 'click' AND validation_status = 'VALID' AND energy_num < 400) AS te,
      sum(emissions_num) FILTER (dataset = 'click' AND validation_status = 'VALID' AND energy_num < 400) AS tm,
      count(DISTINCT site_id) FILTER (dataset = 'click' AND validation_status = 'VALID' AND energy_num < 400) AS sc FROM staged GROUP BY 1),
     c AS (SELECT batch_id, count(*) AS ce, count(*) FILTER (status = 'PASS') AS cp, count(*) FILTER (status = 'FAIL') AS cf, count(*) FILTER (status = 'WARN') AS cw
      FROM checks GROUP BY 1),
     k AS (SELECT batch_id FROM t UNION SELECT batch_id FROM f UNION SELECT batch_id FROM i)
     SELECT k.batch_id, substr(k.batch_id, 3, 4) || '-' || substr(k.batch_id, 7, 2) || '-' || substr(k.batch_id, 9, 2) AS business_date,
     CASE WHEN failed_tasks > 0 THEN 'FAILED' WHEN skipped_tasks > 0 THEN 'PARTIAL' WHEN tasks > 0 THEN 'SUCCESS' ELSE 'NO_RUNS' END AS status,
     strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, coalesce(duration_seconds, 0) AS duration_seconds, coalesce(tasks, 0) AS tasks,
     coalesce(failed_tasks, 0) AS failed_tasks, coalesce(skipped_tasks, 0) AS skipped_tasks, coalesce(files, 0) AS files,
     coalesce(files_quarantined, 0) AS files_quarantined, coalesce(ev, 0) AS energy_valid, coalesce(er, 0) AS energy_rejected, coalesce(cv, 0) AS carbon_valid,
     coalesce(cr, 0) AS carbon_rejected, coalesce(rr, 0) AS rejection_reasons, coalesce(ce, 0) AS dq_executed, coalesce(cp, 0) AS dq_passed,
     coalesce(cf, 0) AS dq_failed, coalesce(cw, 0) AS dq_warn, coalesce(incidents, 0) AS incidents, coalesce(open_incidents, 0) AS open_incidents,
     coalesce(incidents, 0) AS alerts, coalesce(ev, 0) AS source_count, coalesce(tc, 0) AS target_count, coalesce({two('se')}, 0) AS source_energy,
     coalesce({two('te')}, 0) AS target_energy, {two('coalesce(se, 0) - coalesce(te, 0)')} AS energy_diff, coalesce({two('tm')}, 0) AS target_emissions,
     coalesce(sc, 0) AS sites_covered, CASE WHEN coalesce(ev, 0) = coalesce(tc, 0) AND abs(coalesce(se, 0) - coalesce(te, 0)) <= 0.01 THEN 'PASS' ELSE 'FAIL' END
      AS recon_status FROM k LEFT JOIN t USING (batch_id) LEFT JOIN f USING (batch_id) LEFT JOIN i USING (batch_id) LEFT JOIN s USING (batch_id)
     LEFT JOIN c USING (batch_id)""",
    "h21_incident_counts": with_roles(INCIDENTS)
    + """SELECT batch_id, incident_id, incident_type, severity, status, (SELECT count(*) FROM lineitem WHERE l_orderkey = incident_number) AS work_notes,
     (SELECT count(*) FROM customer WHERE c_custkey = incident_number) AS evidence_items FROM incidents""",
    "h21_rejection_reasons": with_roles(STAGED)
    + "SELECT DISTINCT batch_id, rejection_reason FROM staged WHERE rejection_reason IS NOT NULL",
    "h22_batch_compare": with_roles(CHECKS)
    + f""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_name, table_name, column_name ORDER BY check_id DESC) AS rn FROM checks
      WHERE batch_id = '{LEFT}') WHERE rn = 1),
     r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_name, table_name, column_name ORDER BY check_id DESC) AS rn FROM checks
      WHERE batch_id = '{RIGHT}') WHERE rn = 1)
     SELECT coalesce(l.check_name, r.check_name) AS check_name, coalesce(l.check_category, r.check_category) AS check_category,
     coalesce(l.table_name, r.table_name) || coalesce('.' || coalesce(l.column_name, r.column_name), '') AS target, l.status AS left_status,
     r.status AS right_status, l.expected_value AS left_expected, r.expected_value AS right_expected, l.actual_value AS left_actual,
     r.actual_value AS right_actual, coalesce(l.severity, r.severity) AS severity, CASE WHEN l.check_id IS NULL THEN 'ADDED'
     WHEN r.check_id IS NULL THEN 'REMOVED' WHEN l.status <> r.status THEN 'CHANGED' ELSE 'SAME' END AS diff
     FROM l FULL JOIN r ON l.check_name = r.check_name AND l.table_name = r.table_name AND l.column_name IS NOT DISTINCT FROM r.column_name""",
    "h22_batch_sides": with_roles(TASKS)
    + f"SELECT * EXCLUDE (ended_at) REPLACE (strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at) FROM (SELECT batch_id, {_SIDE} FROM tasks GROUP BY 1)",
    "h23_shift_context": with_roles(TASKS)
    + f"""SELECT batch_id, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS tasks FROM tasks
     WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1""",
    "h23_shift_summary": with_roles(TASKS, ALERTS, CHECKS)
    + f""", b AS (SELECT batch_id, bool_or(status = 'FAILED') AS f FROM tasks WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1)
     SELECT count(*) AS dq_executed, count(*) FILTER (status = 'FAIL') AS dq_failed, count(*) FILTER (status = 'WARN') AS dq_warn,
     (SELECT count(*) FROM b) AS batches, (SELECT count(*) FROM b WHERE f) AS batches_failed,
     (SELECT count(*) FROM incidents WHERE {_OPEN}) AS active_incidents, (SELECT count(*) FROM alerts) AS alerts,
     (SELECT count(*) FROM alerts WHERE NOT acknowledged_flag) AS alerts_unacknowledged FROM checks""",
    "h24_queue_lines": with_roles(INCIDENTS)
    + f""", q AS (SELECT count(*) AS n, count(*) FILTER ({_OPEN}) AS a, {', '.join(f"count(*) FILTER (severity = 'P{i}') AS p{i}" for i in (1, 2, 3, 4))},
      count(*) FILTER (escalated_flag) AS e FROM incidents)
     SELECT CAST(0 AS BIGINT) AS line_number, '- Listed: ' || n || ' (' || a || ' active)' AS line FROM q UNION ALL
     SELECT 1, '- Severities: P1 ' || p1 || ' · P2 ' || p2 || ' · P3 ' || p3 || ' · P4 ' || p4 FROM q UNION ALL
     SELECT 2, '- Handed over: ' || e FROM q""",
    "h24_queue_summary": with_roles(INCIDENTS)
    + f"""SELECT count(*) AS in_view, count(*) FILTER ({_OPEN}) AS active, {', '.join(f"count(*) FILTER (severity = 'P{i}') AS P{i}" for i in (1, 2, 3, 4))},
     count(*) FILTER (escalated_flag) AS escalated FROM incidents""",
    "h25_escalation_remaining": with_roles(INCIDENTS)
    + f"""SELECT incident_id, a AS age_minutes, 240 - a AS remaining_minutes, CASE WHEN 240 - a > 0 THEN 'in' ELSE 'past' END AS state FROM
     (SELECT incident_id, greatest(0, date_diff('minute', created_at, TIMESTAMP '2001-08-01 03:00:00')) AS a FROM incidents
      WHERE {_OPEN} AND NOT escalated_flag)""",
    "h26_perf_summary": _PERF
    + f"""SELECT task, count(*) AS count, CAST(floor(sum(ms) / count(*) + 0.5) AS BIGINT) AS avg_duration_ms,
     CAST(floor(coalesce(sum(tp), 0) / count(*) + 0.5) AS BIGINT) AS avg_throughput,
     {_PCT.format(p="count(*) FILTER (status = 'SUCCESS')", n='count(*)')} AS success_rate FROM perf GROUP BY 1""",
    "h27_metric_sla_violations": _PERF + ", " + STAGED + _QUALITY
    + """SELECT 'data_quality' AS component, batch_id, dataset || '_quality_score' AS metric, CAST(95 AS DOUBLE) AS expected_value,
     quality_score AS actual_value, CASE WHEN quality_score < 90 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM quality WHERE quality_score < 95
     UNION ALL SELECT 'performance', batch_id, task || '_duration_ms', CAST(10000 AS DOUBLE), ms, CASE WHEN ms > 15000 THEN 'CRITICAL' ELSE 'WARNING' END
     FROM perf WHERE ms > 10000""",
    "h28_quality_trend": with_roles(STAGED) + _QUALITY + "SELECT * FROM quality WHERE dataset = 'click'",
    "h29_last_load": with_roles(FACT)
    + """SELECT strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') AS last_load_time, arg_max(batch_id, (loaded_at, batch_id)) AS last_batch_id,
     strftime(max(reading_date), '%Y-%m-%d') AS latest_reading_date, count(*) AS fact_rows, (SELECT count(*) FROM supplier) AS sites FROM fact""",
}

ORACLE["h22_compare_metrics"] = (
    f"SELECT * EXCLUDE (started_at), CASE WHEN batch_id = '{LEFT}' THEN 'left' ELSE 'right' END AS side FROM ("
    + ORACLE["h21_batch_lineage"]
    + f") WHERE batch_id IN ('{LEFT}', '{RIGHT}')"
)
