"""Explicit schemas; nothing is inferred at run time."""

from __future__ import annotations

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}

SIDECAR = (
    "file_name string, dataset string, business_date string, source_system string, expected_rows double, "
    "checksum_algorithm string, checksum_sha256 string"
)

STAGING_READINGS = (
    "batch_id string, dataset string, row_index long, record_id string, site_id string, reading_date date, "
    "energy_kwh double, emissions_co2e double, source_file_name string, source_system string, "
    "validation_status string, rejection_reason string"
)

FACT = (
    "batch_id string, record_id string, site_id string, reading_date date, energy_kwh double, emissions_co2e double, "
    "source_file_name string, source_system string"
)

REPORT_COLUMNS = [
    "report_date", "files_expected", "files_received", "files_quarantined", "jobs_executed", "jobs_succeeded", "jobs_failed",
    "dq_checks_executed", "dq_checks_passed", "dq_checks_failed", "open_incidents", "p1_incidents", "p2_incidents",
    "reconciliation_status", "overall_health",
]

INCIDENT_COLUMNS = [
    "incident_id", "created_at", "updated_at", "batch_id", "incident_type", "severity", "status", "short_description",
    "affected_file", "affected_table", "affected_check", "runbook_link", "assigned_to", "escalated", "age_minutes",
]

REJECTED_COLUMNS = [
    "record_id", "site_id", "reading_date", "energy_kwh", "emissions_co2e", "rejection_reason", "source_file",
]
