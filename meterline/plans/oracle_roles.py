"""The role tables of `roles.py` as SQL common table expressions for the check engine."""

from __future__ import annotations

FEED = """feed AS (
 SELECT event_id AS row_index, 'readings_' || strftime(ts, '%Y-%m-%d') || '.csv' AS file_name,
  strftime(ts, '%Y-%m-%d') AS business_date, 'B-' || strftime(ts, '%Y%m%d') || '-01' AS batch_id, event_type AS dataset,
  CASE WHEN event_id % 50 = 0 THEN 'EN-U' || (user_id % 3) ELSE 'EN-' || event_id END AS record_id,
  CASE WHEN event_id % 97 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS site_id,
  CASE WHEN event_id % 89 = 0 THEN strftime(ts, '%d-%m-%Y') WHEN event_id % 101 = 0 THEN '2024-02-31'
   ELSE strftime(ts, '%Y-%m-%d') END AS reading_date,
  CASE WHEN event_id % 83 = 0 THEN '-' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) WHEN event_id % 103 = 0 THEN '1d'
   ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS energy_kwh,
  CAST(CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.4 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS VARCHAR) AS emissions_co2e, ts
 FROM events)"""

STAGED = FEED + """, marked AS (
 SELECT *, CASE WHEN site_id = '' THEN 'null:site_id' END AS null_reason,
  CASE WHEN row_number() OVER (PARTITION BY file_name, record_id ORDER BY row_index) > 1
   THEN 'duplicate_record_id' END AS repeat_reason,
  CASE WHEN NOT regexp_full_match(reading_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR TRY_CAST(reading_date AS DATE) IS NULL
   THEN 'invalid_date_format' END AS date_reason,
  CASE WHEN energy_kwh = '1d' THEN 'invalid_value:energy_kwh' WHEN CAST(energy_kwh AS DOUBLE) < 0
   THEN 'range_violation:energy_kwh=' || regexp_replace(regexp_replace(energy_kwh, '0+$', ''), '\\.$', '') END AS energy_reason
 FROM feed), staged AS (
 SELECT *, coalesce(null_reason, repeat_reason, date_reason, energy_reason) AS rejection_reason,
  CASE WHEN coalesce(null_reason, repeat_reason, date_reason, energy_reason) IS NULL THEN 'VALID' ELSE 'REJECTED' END
   AS validation_status,
  CASE WHEN energy_kwh <> '1d' AND coalesce(null_reason, repeat_reason, date_reason) IS NULL
   THEN CAST(energy_kwh AS DECIMAL(18,2)) END AS energy_num,
  CASE WHEN coalesce(null_reason, repeat_reason, date_reason, energy_reason) IS NULL
   THEN CAST(emissions_co2e AS DECIMAL(18,2)) END AS emissions_num
 FROM marked)"""

SITES = """sites AS (
 SELECT CAST(s_suppkey AS VARCHAR) AS site_id, s_name AS site_name, n_name AS country, r_name AS region,
  'T' || (s_suppkey % 6) AS site_type, s_suppkey % 10 <> 0 AS active_flag
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FACT = """fact AS (
 SELECT 'B-' || strftime(l_shipdate, '%Y%m%d') || '-01' AS batch_id, l_orderkey || '-' || l_linenumber AS record_id,
  CAST(l_suppkey AS VARCHAR) AS site_id, CAST(l_shipdate AS DATE) AS reading_date,
  CAST(l_quantity AS DECIMAL(18,2)) AS energy_kwh, CAST(l_extendedprice AS DECIMAL(18,2)) AS emissions_co2e,
  l_returnflag AS source_file_name, l_linestatus AS side, l_shipdate AS loaded_at FROM lineitem)"""

CHECKS = """checks AS (
 SELECT event_id AS check_id, 'B-' || strftime(ts, '%Y%m%d') || '-01' AS batch_id, strftime(ts, '%Y-%m-%d') AS business_date,
  CASE event_type WHEN 'click' THEN 'null_check_mandatory' WHEN 'view' THEN 'duplicate_record_check'
   WHEN 'purchase' THEN 'source_to_target_rowcount_recon' WHEN 'error' THEN 'file_arrival_check'
   ELSE 'custom_check' END AS check_name,
  CASE WHEN event_type = 'purchase' THEN 'RECONCILIATION' ELSE 'COMPLETENESS' END AS check_category,
  'table_' || (user_id % 3) AS table_name, CASE WHEN user_id % 7 <> 0 THEN 'col_' || (user_id % 4) END AS column_name,
  CASE WHEN value < 100 THEN 'PASS' WHEN value < 150 THEN 'WARN' ELSE 'FAIL' END AS status, '0' AS expected_value,
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS actual_value, '0' AS threshold_value,
  CASE user_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE WHEN value >= 100 THEN 'value ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS error_details,
  ts AS executed_at FROM events)"""

TASKS = """tasks AS (
 SELECT *, CASE WHEN duration_seconds IS NOT NULL THEN start_time + to_seconds(duration_seconds) END AS end_time,
  CASE WHEN status = 'FAILED' THEN 'error in ' || task_id END AS error_message FROM (
 SELECT 'run-' || o_orderkey AS run_id, 'B-' || strftime(o_orderdate, '%Y%m%d') || '-01' AS batch_id,
  o_orderpriority AS task_id, 'job ' || o_orderpriority AS job_name, 'LOAD' AS job_type, o_orderkey AS sequence,
  o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS start_time,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) END AS duration_seconds,
  CASE o_orderstatus WHEN 'P' THEN 'SUCCESS' WHEN 'O' THEN 'SKIPPED' ELSE 'FAILED' END AS status,
  o_custkey AS rows_read, o_custkey - o_custkey % 7 AS rows_loaded, o_custkey % 7 AS rows_rejected FROM orders))"""

INCIDENTS = """incidents AS (
 SELECT *, incident_type || ' on customer ' || custkey AS short_description FROM (
 SELECT 'INC-' || o_orderkey AS incident_id, o_orderkey AS incident_number, o_orderdate AS created_at,
  o_orderdate + to_hours(CAST(o_orderkey % 72 AS BIGINT)) AS updated_at,
  'B-' || strftime(o_orderdate, '%Y%m%d') || '-01' AS batch_id, 'run-' || o_orderkey AS run_id, o_custkey AS custkey,
  list_extract(['FILE_MISSING','FILE_CORRUPTED','SCHEMA_DRIFT','EMPTY_FILE','CHECKSUM_MISMATCH','DUPLICATE_RECORDS',
   'NULL_VALUES','RANGE_VIOLATION','ROW_COUNT_MISMATCH','LOAD_FAILURE','SLA_BREACH','FRESHNESS_FAILURE'],
   CAST(o_custkey % 12 + 1 AS BIGINT)) AS incident_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'P1' WHEN '2-HIGH' THEN 'P2' WHEN '3-MEDIUM' THEN 'P3' ELSE 'P4' END AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'RESOLVED' END AS status,
  'file_' || (o_custkey % 5) AS affected_file, 'staging_energy_data' AS affected_table,
  CASE WHEN o_custkey % 3 <> 0 THEN 'null_check_mandatory' END AS affected_check, 'L1 On-call' AS assigned_to,
  o_orderkey % 4 = 0 AS escalated_flag FROM orders))"""

ALERTS = INCIDENTS + """, alerts AS (
 SELECT incident_number AS alert_id, created_at, batch_id, incident_type AS alert_type, severity,
  incident_id || ': ' || short_description AS message, 'console,email_stub,webhook_stub' AS channels,
  incident_number % 3 = 0 AS acknowledged_flag FROM incidents)"""

TRANSITIONS = """transitions AS (
 SELECT user_id AS incident_id, ts AS moment, event_id AS seq, CASE event_type WHEN 'click' THEN 'IN_PROGRESS'
  WHEN 'view' THEN 'RESOLVED' WHEN 'purchase' THEN 'CLOSED' WHEN 'error' THEN 'OPEN' ELSE 'IN_PROGRESS' END AS to_status
 FROM events)"""

DELIVERIES = """deliveries AS (
 SELECT dataset, business_date, file_name, batch_id, CASE WHEN ids % 29 = 0 THEN 0 ELSE n END AS data_rows, size_bytes,
  CAST(business_date AS TIMESTAMP) + INTERVAL 390 MINUTE AS expected_arrival_at,
  CAST(business_date AS TIMESTAMP) + INTERVAL 6 HOUR + to_minutes(CAST((ids * 37) % 420 AS BIGINT)) AS received_at,
  digest AS computed_checksum, CASE WHEN ids % 11 = 0 THEN upper(digest) WHEN ids % 13 <> 0 THEN digest END AS manifest_checksum,
  CASE WHEN ids % 17 = 0 THEN n + 5 WHEN ids % 13 <> 0 THEN n END AS expected_rows,
  CASE ids % 7 WHEN 1 THEN 'record_id,site_id,reading_date,energy_kwh,emissions_co2e,scope'
   WHEN 2 THEN 'record_id,reading_date,energy_kwh,emissions_co2e' WHEN 3 THEN 'record_id,site_id,reading_date,energy_kwh'
   WHEN 4 THEN 'garbage' ELSE 'record_id,site_id,reading_date,energy_kwh,emissions_co2e' END AS header,
  ids % 9 <> 0 AS in_landing, ids % 2 = 0 AS in_log
 FROM (SELECT *, sha256(file_name || ':' || n) AS digest FROM (
  SELECT event_type AS dataset, strftime(ts, '%Y-%m-%d') AS business_date,
   event_type || '_' || strftime(min(ts), '%Y-%m-%d') || '.csv' AS file_name,
   'B-' || strftime(min(ts), '%Y%m%d') || '-01' AS batch_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids,
   CAST(sum(length(props)) AS BIGINT) AS size_bytes FROM events GROUP BY 1, 2)))"""


def with_roles(*parts: str) -> str:
    """`WITH` clause of the wanted roles, each named once."""
    return "WITH " + ", ".join(parts) + " "
