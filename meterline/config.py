"""Feed rules, delivery manifest, check catalogue and settings.

Defaults are Python values; `load_config` overlays them with YAML or JSON
files. Everything here is configuration-sized, so the DataFrames built from it
have a row per configured feed or check and may be broadcast.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# ---- Fixed values: they decide check results, severities and identifiers ----------------------

FEED_RULES = {
    "energy_consumption": {
        "required_columns": ["record_id", "site_id", "reading_date", "energy_kwh", "emissions_co2e"],
        "primary_key": ["record_id"],
        "mandatory_not_null": ["record_id", "site_id", "reading_date", "energy_kwh"],
        "numeric_range": {"energy_kwh": {"min": 0}, "emissions_co2e": {"min": 0}},
    },
    "carbon_emissions": {
        "required_columns": ["record_id", "site_id", "reading_date", "emissions_co2e"],
        "primary_key": ["record_id"],
        "mandatory_not_null": ["record_id", "site_id", "reading_date", "emissions_co2e"],
        "numeric_range": {"emissions_co2e": {"min": 0}},
    },
    "site_master": {
        "required_columns": ["site_id", "site_name", "country", "region", "site_type", "effective_from_date"],
        "primary_key": ["site_id"],
        "mandatory_not_null": ["site_id", "site_name", "country"],
        "date_column": "effective_from_date",
        "is_dimension": True,
    },
}

MANIFEST = {
    "energy_consumption": {
        "pattern": "energy_consumption_{date}.csv",
        "source_system": "ESG-IOT-HUB",
        "expected_arrival": "06:30",
        "sla_hours": 4,
    },
    "carbon_emissions": {
        "pattern": "carbon_emissions_{date}.csv",
        "source_system": "CARBON-LEDGER-API",
        "expected_arrival": "06:40",
        "sla_hours": 4,
    },
    "site_master": {
        "pattern": "site_master_{date}.csv",
        "source_system": "FACILITIES-MDM",
        "expected_arrival": "06:15",
        "sla_hours": 2,
    },
}

# check name: (category, severity, incident type or None, raises an incident)
CHECKS = {
    "file_arrival_check": ("COMPLETENESS", "CRITICAL", "FILE_MISSING", True),
    "empty_file_check": ("COMPLETENESS", "CRITICAL", "EMPTY_FILE", True),
    "checksum_validation": ("INTEGRITY", "CRITICAL", "CHECKSUM_MISMATCH", True),
    "schema_header_validation": ("SCHEMA", "CRITICAL", "SCHEMA_DRIFT", True),
    "row_count_check": ("COMPLETENESS", "HIGH", "ROW_COUNT_MISMATCH", True),
    "sla_check": ("OPERATIONS", "HIGH", "SLA_BREACH", True),
    "null_check_mandatory": ("COMPLETENESS", "HIGH", "NULL_VALUES", True),
    "duplicate_record_check": ("UNIQUENESS", "MEDIUM", "DUPLICATE_RECORDS", True),
    "date_validity_check": ("VALIDITY", "MEDIUM", "RANGE_VIOLATION", True),
    "numeric_range_check": ("VALIDITY", "MEDIUM", "RANGE_VIOLATION", True),
    "referential_integrity_check": ("INTEGRITY", "MEDIUM", None, False),
    "freshness_check": ("FRESHNESS", "HIGH", "FRESHNESS_FAILURE", True),
    "quarantined_file_check": ("OPERATIONS", "INFO", None, False),
    "rejected_threshold_check": ("OPERATIONS", "HIGH", None, False),
    "source_to_target_rowcount_recon": ("RECONCILIATION", "CRITICAL", "ROW_COUNT_MISMATCH", True),
    "source_to_target_aggregate_recon": ("RECONCILIATION", "HIGH", "ROW_COUNT_MISMATCH", True),
    "cross_dataset_emissions_consistency": ("RECONCILIATION", "LOW", None, False),
}

INCIDENT_SEVERITY = {
    "FILE_MISSING": "P2",
    "FILE_CORRUPTED": "P2",
    "EMPTY_FILE": "P2",
    "CHECKSUM_MISMATCH": "P2",
    "SCHEMA_DRIFT_MANDATORY": "P1",
    "SCHEMA_DRIFT_OPTIONAL": "P2",
    "ROW_COUNT_MISMATCH": "P2",
    "DUPLICATE_RECORDS": "P3",
    "NULL_VALUES_MANDATORY": "P2",
    "NULL_VALUES_OPTIONAL": "P3",
    "RANGE_VIOLATION": "P3",
    "LOAD_FAILURE": "P1",
    "SLA_BREACH": "P2",
    "FRESHNESS_FAILURE": "P2",
}

INCIDENT_RUNBOOK = {
    "FILE_MISSING": "RB001",
    "EMPTY_FILE": "RB002",
    "CHECKSUM_MISMATCH": "RB003",
    "FILE_CORRUPTED": "RB003",
    "SCHEMA_DRIFT": "RB004",
    "ROW_COUNT_MISMATCH": "RB005",
    "DUPLICATE_RECORDS": "RB006",
    "NULL_VALUES": "RB007",
    "RANGE_VIOLATION": "RB007",
    "LOAD_FAILURE": "RB008",
    "SLA_BREACH": "RB009",
    "FRESHNESS_FAILURE": "RB010",
}

RUNBOOK_TITLE = {
    "RB001": "Missing File",
    "RB002": "Empty File",
    "RB003": "Checksum Mismatch / Corrupted File",
    "RB004": "Schema Drift",
    "RB005": "Row Count Mismatch",
    "RB006": "Duplicate Records",
    "RB007": "Null / Invalid Values",
    "RB008": "Load Failure",
    "RB009": "SLA Breach / Late File",
    "RB010": "Freshness Failure",
}

LIFECYCLE = {
    "OPEN": ["IN_PROGRESS", "RESOLVED"],
    "IN_PROGRESS": ["RESOLVED", "OPEN"],
    "RESOLVED": ["CLOSED", "OPEN"],
    "CLOSED": [],
}

OPEN_STATES = ["OPEN", "IN_PROGRESS"]
HANDLED_STATES = ["PROCESSED", "QUARANTINED", "VALIDATED", "FAILED"]
INCIDENT_LEVELS = ["P1", "P2", "P3", "P4"]
CHECK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]

# ---- End of fixed values ----------------------------------------------------------------------


@dataclass(frozen=True)
class FeedRules:
    name: str
    required_columns: list[str]
    primary_key: list[str]
    mandatory_not_null: list[str]
    numeric_range: dict[str, dict[str, float]] = field(default_factory=dict)
    date_column: str = "reading_date"
    row_count_variance_threshold: int = 0
    is_dimension: bool = False

    @property
    def staging_table(self) -> str:
        return "staging_site_master" if self.is_dimension else "staging_energy_data"


@dataclass(frozen=True)
class Delivery:
    name: str
    pattern: str
    source_system: str = "UNKNOWN"
    expected_arrival: str = "06:30"
    sla_hours: float = 4
    mandatory: bool = True

    def any_date_regex(self) -> str:
        """File names of this feed for any date; other characters are literal."""
        parts = [re.escape(p) for p in self.pattern.split("{date}")]
        return "^" + r"[0-9]{4}-[0-9]{2}-[0-9]{2}".join(parts) + "$"


@dataclass(frozen=True)
class Check:
    name: str
    category: str = "OPERATIONS"
    severity: str = "MEDIUM"
    incident_type: str | None = None
    create_incident: bool = False


@dataclass(frozen=True)
class Settings:
    pipeline_name: str = "daily_feeds"
    rejected_threshold_pct: float = 5
    aggregate_tolerance: float = 0.01
    escalation_threshold_minutes: int = 240
    trend_days: int = 14
    freshness_days: int = 1
    freshness_label_hours: int = 26
    cross_pass_pct: float = 5
    cross_warn_pct: float = 10
    alert_channels: tuple[str, ...] = ("console", "email_stub", "webhook_stub")
    assigned_to: str = "L1 On-call"
    escalation_group: str = "Data Engineering L2"
    quality_objective: float = 95
    quality_critical: float = 90
    duration_objective_ms: float = 10_000
    duration_critical_ms: float = 15_000


@dataclass(frozen=True)
class Config:
    feeds: dict[str, FeedRules]
    manifest: dict[str, Delivery]
    checks: dict[str, Check]
    settings: Settings = Settings()
    severity: dict[str, str] = field(default_factory=lambda: dict(INCIDENT_SEVERITY))

    # -- small DataFrames, one row per configured item ------------------------------------------

    def manifest_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, d.name, d.pattern, d.any_date_regex(), d.source_system, d.expected_arrival, float(d.sla_hours), d.mandatory)
            for i, d in enumerate(self.manifest.values())
        ]
        return spark.createDataFrame(
            rows,
            "feed_order int, dataset string, pattern string, any_date_regex string, source_system string, "
            "expected_arrival string, sla_hours double, mandatory boolean",
        )

    def rules_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f.name, f.required_columns, f.primary_key, f.mandatory_not_null, f.date_column,
             f.row_count_variance_threshold, f.staging_table)
            for f in self.feeds.values()
        ]
        return spark.createDataFrame(
            rows,
            "dataset string, required_columns array<string>, primary_key array<string>, "
            "mandatory_not_null array<string>, date_column string, row_count_threshold int, staging_table string",
        )

    def checks_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.category, c.severity, c.incident_type, c.create_incident) for c in self.checks.values()]
        return spark.createDataFrame(
            rows,
            "check_name string, check_category string, severity string, incident_type string, create_incident boolean",
        )

    def runbook_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, rb, RUNBOOK_TITLE[rb]) for t, rb in INCIDENT_RUNBOOK.items()]
        return spark.createDataFrame(rows, "incident_type string, runbook_id string, runbook_title string")


def _feed(name: str, raw: dict) -> FeedRules:
    pk = list(raw.get("primary_key") or ["record_id"])
    return FeedRules(
        name=name,
        required_columns=list(raw.get("required_columns") or []),
        primary_key=pk,
        mandatory_not_null=list(raw.get("mandatory_not_null") or []),
        numeric_range=dict(raw.get("numeric_range") or {}),
        date_column=raw.get("date_column") or ("effective_from_date" if name == "site_master" else "reading_date"),
        row_count_variance_threshold=int(raw.get("row_count_variance_threshold") or 0),
        is_dimension=bool(raw.get("is_dimension", name == "site_master")),
    )


def _delivery(name: str, raw: dict) -> Delivery:
    return Delivery(
        name=name,
        pattern=raw.get("pattern") or f"{name}_{{date}}.csv",
        source_system=raw.get("source_system") or "UNKNOWN",
        expected_arrival=raw.get("expected_arrival") or "06:30",
        sla_hours=raw.get("sla_hours") or 4,
        mandatory=bool(raw.get("mandatory", True)),
    )


def default_config() -> Config:
    return Config(
        feeds={n: _feed(n, r) for n, r in FEED_RULES.items()},
        manifest={n: _delivery(n, r) for n, r in MANIFEST.items()},
        checks={n: Check(n, *c) for n, c in CHECKS.items()},
    )


def _read_document(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as err:  # YAML support is optional
        raise RuntimeError(f"{path}: PyYAML is not installed, use JSON") from err
    return yaml.safe_load(text) or {}


def load_config(
    rules: str | None = None, manifest: str | None = None, settings: str | None = None
) -> Config:
    """Config from YAML or JSON documents; every missing key keeps its default."""
    config = default_config()
    if rules:
        doc = _read_document(rules)
        if doc.get("datasets"):
            config = replace(config, feeds={n: _feed(n, r or {}) for n, r in doc["datasets"].items()})
        if doc.get("checks"):
            checks = {
                n: Check(
                    n,
                    c.get("category") or "OPERATIONS",
                    c.get("severity") or "MEDIUM",
                    c.get("incident_type"),
                    bool(c.get("create_incident", False)),
                )
                for n, c in doc["checks"].items()
            }
            config = replace(config, checks=checks)
    if manifest:
        doc = _read_document(manifest)
        if doc.get("datasets"):
            config = replace(config, manifest={n: _delivery(n, r or {}) for n, r in doc["datasets"].items()})
    if settings:
        doc = _read_document(settings)
        incidents, reporting = doc.get("incidents") or {}, doc.get("reporting") or {}
        base = config.settings
        config = replace(
            config,
            severity={**config.severity, **(incidents.get("severity_mapping") or {})},
            settings=replace(
                base,
                pipeline_name=(doc.get("pipeline") or {}).get("dag_id") or base.pipeline_name,
                rejected_threshold_pct=reporting.get("rejected_record_threshold_pct", base.rejected_threshold_pct),
                aggregate_tolerance=reporting.get("aggregate_tolerance", base.aggregate_tolerance),
                escalation_threshold_minutes=incidents.get(
                    "escalation_threshold_minutes", base.escalation_threshold_minutes
                ),
                assigned_to=incidents.get("assigned_to") or base.assigned_to,
                escalation_group=incidents.get("escalation_group") or base.escalation_group,
                trend_days=(doc.get("dashboard") or {}).get("trend_days", base.trend_days),
                alert_channels=tuple((doc.get("alerts") or {}).get("channels") or base.alert_channels),
            ),
        )
    return config
