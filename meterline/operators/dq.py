"""Batch data-quality checks and the incidents they raise.

Every check becomes one row of the canonical layout, so checks of all batches,
feeds and kinds union into one table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.config import INCIDENT_RUNBOOK, Config, FeedRules
from meterline.functions.joins import lookup_join, number_rows
from meterline.functions.numbers import pad_left
from meterline.functions.times import batch_date, batch_place

TEXT_FIELDS = [
    "batch_id", "business_date", "dataset", "check_name", "status", "table_name", "column_name", "expected_value",
    "actual_value", "threshold_value", "error_details", "incident_file", "incident_table", "incident_description",
]


def check_row(**values: Column | str | int | float | None) -> Column:
    """A canonical check as a struct; absent fields are null, numbers become text."""
    fields = []
    for name in TEXT_FIELDS:
        value = values.get(name)
        column = value if isinstance(value, Column) else F.lit(None if value is None else str(value))
        fields.append(column.cast("string").alias(name))
    mandatory = values.get("mandatory", False)
    fields.append((mandatory if isinstance(mandatory, Column) else F.lit(bool(mandatory))).alias("mandatory"))
    return F.struct(*fields)


def emit(df: DataFrame, *rows: Column) -> DataFrame:
    """One output row per non-null check struct of each input row."""
    made = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return df.select(F.explode(made).alias("c")).select("c.*")


def union_checks(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def fail_if(broken: Column, otherwise: str = "PASS", status: str = "FAIL") -> Column:
    return F.when(broken, status).otherwise(otherwise)


# ---- checks from load statistics ----------------------------------------------------------------


def rules_columns(rules: Iterable[FeedRules], spark) -> DataFrame:
    """Per-feed texts the checks print; a row per configured feed."""
    rows = [
        (
            r.name,
            r.staging_table,
            ",".join(r.mandatory_not_null),
            ",".join(r.primary_key),
            r.date_column,
            ",".join(r.numeric_range),
            ",".join(f"{c}>={r.numeric_range[c].get('min', '-inf')}" for c in r.numeric_range),
        )
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "dataset string, staging_table string, mandatory_text string, key_text string, date_text string, "
        "range_text string, range_limits string",
    )


def null_check() -> Column:
    """Fails when any mandatory value was missing; names each bad column with its count."""
    entries = F.map_entries("nulls_by_column")
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    found = total > 0
    named = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "; ")
    return check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), dataset=F.col("dataset"),
        check_name="null_check_mandatory", status=fail_if(found), table_name=F.col("staging_table"),
        column_name=F.when(found, F.array_join(F.map_keys("nulls_by_column"), ",")).otherwise(F.col("mandatory_text")),
        expected_value=0, actual_value=total,
        error_details=F.when(found, F.concat(F.lit("blank where a value is required: "), named)),
        mandatory=found,
    )


def duplicate_check() -> Column:
    n = F.col("duplicates")
    details = F.concat(
        n.cast("string"), F.lit(" rows repeat an earlier "), F.col("key_text")
    )
    return check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), dataset=F.col("dataset"),
        check_name="duplicate_record_check", status=fail_if(n > 0), table_name=F.col("staging_table"),
        column_name=F.col("key_text"), expected_value=0, actual_value=n, error_details=F.when(n > 0, details),
    )


def date_check() -> Column:
    n = F.col("invalid_dates")
    return check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), dataset=F.col("dataset"),
        check_name="date_validity_check", status=fail_if(n > 0), table_name=F.col("staging_table"),
        column_name=F.col("date_text"), expected_value=0, actual_value=n,
        error_details=F.when(n > 0, F.concat(n.cast("string"), F.lit(" rows have no readable date"))),
    )


def range_check() -> Column:
    """Violations rejected at load plus violations found in the accepted rows."""
    total = F.col("range_violations") + F.coalesce(F.col("staged_violations"), F.lit(0))
    details = F.concat(
        F.col("range_violations").cast("string"), F.lit(" refused on loading, "),
        F.coalesce(F.col("staged_violations"), F.lit(0)).cast("string"), F.lit(" among accepted rows"),
    )
    return check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), dataset=F.col("dataset"),
        check_name="numeric_range_check", status=fail_if(total > 0), table_name=F.col("staging_table"),
        column_name=F.col("range_text"), expected_value=0, actual_value=total, threshold_value=F.col("range_limits"),
        error_details=F.when(total > 0, details),
    )


def orphan_check() -> Column:
    n = F.coalesce(F.col("orphans"), F.lit(0))
    row = check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), dataset=F.col("dataset"),
        check_name="referential_integrity_check", status=fail_if(n > 0), table_name=F.col("staging_table"),
        column_name="site_id", expected_value=0, actual_value=n,
        error_details=F.when(
            n > 0, F.concat(n.cast("string"), F.lit(" rows name a site that no site feed has delivered"))
        ),
    )
    return F.when(F.col("staging_table") != "staging_site_master", row)


def rejected_share_check(threshold_pct: float) -> Column:
    """Only for feeds that delivered rows; strictly above the threshold fails."""
    share = F.col("total_rejected") / F.col("total_read") * F.lit(100.0)
    limit = f"{threshold_pct:g}"
    over = share > threshold_pct
    row = check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), dataset=F.col("dataset"),
        check_name="rejected_threshold_check", status=fail_if(over), table_name=F.col("staging_table"),
        expected_value=f"<= {limit}%", actual_value=F.concat(F.format_string("%.1f", share), F.lit("%")),
        threshold_value=limit,
        error_details=F.when(
            over,
            F.concat_ws("", F.col("total_rejected").cast("string"), F.lit("/"), F.col("total_read").cast("string"),
                        F.lit(" rows refused")),
        ),
    )
    return F.when(F.col("total_read") > 0, row)


def staged_violations(staged: DataFrame, rules: Iterable[FeedRules]) -> DataFrame:
    """Range violations among accepted rows, per batch and feed."""
    count = F.lit(0).cast("long")
    for r in rules:
        for column, limits in r.numeric_range.items():
            if column not in staged.columns:
                continue
            bad = F.lit(False)
            if limits.get("min") is not None:
                bad = bad | (F.col(column) < float(limits["min"]))
            if limits.get("max") is not None:
                bad = bad | (F.col(column) > float(limits["max"]))
            hit = (F.col("dataset") == r.name) & F.coalesce(bad, F.lit(False))
            count = count + hit.cast("long")
    valid = staged.filter(F.col("validation_status") == "VALID")
    return valid.groupBy("batch_id", "dataset").agg(F.sum(count).alias("staged_violations"))


def orphan_counts(staged: DataFrame, known_sites: DataFrame) -> DataFrame:
    """Accepted rows per batch and feed whose site is null or unknown.

    Rows are counted per site before the anti join, so the join sees one row per
    site however many readings a site has.
    """
    valid = staged.filter(F.col("validation_status") == "VALID")
    per_site = valid.groupBy("batch_id", "dataset", "site_id").agg(F.count(F.lit(1)).alias("n"))
    unknown = lookup_join(per_site, known_sites.select("site_id").distinct(), ["site_id"], "left_anti")
    return unknown.groupBy("batch_id", "dataset").agg(F.sum("n").alias("orphans"))


def staging_checks(
    stats: DataFrame, config: Config, violations: DataFrame | None = None, orphans: DataFrame | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """The per-feed checks (all, or the named ones) of every batch in `stats`, in one pass over it.

    `stats` has a row per batch and feed; feeds that delivered nothing may be
    present with zero counts and then skip the rejected-share check.
    """
    builders = {
        "null_check_mandatory": null_check,
        "duplicate_record_check": duplicate_check,
        "date_validity_check": date_check,
        "numeric_range_check": range_check,
        "referential_integrity_check": orphan_check,
        "rejected_threshold_check": lambda: rejected_share_check(config.settings.rejected_threshold_pct),
    }
    spark = stats.sparkSession
    base = stats if "business_date" in stats.columns else stats.withColumn("business_date", batch_date("batch_id"))
    base = base.join(F.broadcast(rules_columns(config.feeds.values(), spark)), "dataset")
    for extra, name in ((violations, "staged_violations"), (orphans, "orphans")):
        if extra is None:
            base = base.withColumn(name, F.lit(0).cast("long"))
        else:
            base = base.join(extra, ["batch_id", "dataset"], "left")
    return emit(base, *[build() for name, build in builders.items() if names is None or name in names])


# ---- batch-level checks -------------------------------------------------------------------------


def quarantine_check(files: DataFrame) -> DataFrame:
    """One row per batch: WARN when any receipt was quarantined.

    A batch has at most one receipt per configured feed, so the joined text is
    bounded by the manifest.
    """
    bad = F.col("file_status") == "QUARANTINED"
    per_batch = files.groupBy("batch_id", "business_date").agg(
        F.count_if(bad).alias("n"),
        F.sort_array(F.collect_list(F.when(bad, F.concat_ws(": ", "file_name", "error_message")))).alias("texts"),
    )
    return emit(
        per_batch,
        check_row(
            batch_id=F.col("batch_id"), business_date=F.col("business_date"), check_name="quarantined_file_check",
            status=fail_if(F.col("n") > 0, status="WARN"), table_name="file_ingestion_log", expected_value=0,
            actual_value=F.col("n"), error_details=F.when(F.col("n") > 0, F.array_join("texts", " | ")),
        ),
    )


def freshness_check(batches: DataFrame, fact: DataFrame, days: int = 1, label: int = 26) -> DataFrame:
    """For each batch: is the newest reading loaded by earlier batches recent enough?

    `batches` has batch_id and business_date (date). Facts shrink to one row per
    batch before the running maximum, so the only global window is batch-sized.
    """
    loaded = fact.groupBy("batch_id").agg(F.max("reading_date").alias("newest"))
    earlier = Window.orderBy(batch_place(F.col("batch_id"))).rowsBetween(Window.unboundedPreceding, -1)
    line = batches.select("batch_id", "business_date").join(loaded, "batch_id", "full_outer")
    seen = line.withColumn("latest", F.max("newest").over(earlier)).filter(F.col("business_date").isNotNull())
    floor = F.date_sub("business_date", days)
    stale = F.coalesce(F.col("latest") < floor, F.lit(False))
    details = F.concat(
        F.lit("newest reading is of "), F.col("latest").cast("string"), F.lit(", too old for "),
        floor.cast("string"),
    )
    return emit(
        seen,
        check_row(
            batch_id=F.col("batch_id"), business_date=F.col("business_date"), check_name="freshness_check",
            status=fail_if(stale), table_name="fact_energy_emissions", column_name="reading_date",
            expected_value=F.concat(F.lit(">= "), floor.cast("string")),
            actual_value=F.coalesce(F.col("latest").cast("string"), F.lit("nothing loaded yet")),
            threshold_value=label, error_details=F.when(stale, details), incident_table="fact_energy_emissions",
        ),
    )


# ---- catalogue and incidents --------------------------------------------------------------------


def with_catalogue(checks: DataFrame, config: Config) -> DataFrame:
    """Category and severity by check name; unknown checks are MEDIUM / OPERATIONS."""
    catalogue = config.checks_table(checks.sparkSession).select("check_name", "check_category", "severity")
    kept = checks.drop("check_category", "severity")
    joined = kept.join(F.broadcast(catalogue), "check_name", "left")
    return joined.withColumn("check_category", F.coalesce("check_category", F.lit("OPERATIONS"))).withColumn(
        "severity", F.coalesce("severity", F.lit("MEDIUM"))
    )


def severity_of(config: Config, incident_type: Column, mandatory: Column) -> Column:
    """Configured severity; schema drift and null values depend on mandatory columns."""
    by_type = F.create_map(*[F.lit(x) for pair in config.severity.items() for x in pair])
    suffix = F.when(
        incident_type.isin("SCHEMA_DRIFT", "NULL_VALUES"),
        F.when(F.coalesce(mandatory, F.lit(False)), "_MANDATORY").otherwise("_OPTIONAL"),
    ).otherwise("")
    return F.coalesce(by_type[F.concat(incident_type, suffix)], F.lit("P3"))


def runbook_of(incident_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in INCIDENT_RUNBOOK.items() for x in pair])[incident_type]


def derive_incidents(checks: DataFrame, config: Config, order: list[str], already: int = 0) -> DataFrame:
    """An incident for each failed check whose catalogue entry raises one."""
    raising = config.checks_table(checks.sparkSession).filter("create_incident and incident_type is not null")
    failed = checks.filter(F.col("status") == "FAIL").join(
        F.broadcast(raising.select("check_name", "incident_type")), "check_name"
    )
    numbered = number_rows(failed, [], [F.col(c).asc() for c in order], "_n")
    feed_part = F.when(F.col("dataset").isNotNull(), F.concat(F.lit(" for "), F.col("dataset"))).otherwise("")
    default_text = F.concat(F.col("check_name"), F.lit(" failed"), feed_part, F.lit(" (batch "), F.col("batch_id"), F.lit(")"))
    return numbered.select(
        F.concat(F.lit("INC-"), pad_left(F.col("_n") + already, 6)).alias("incident_id"),
        "batch_id",
        "business_date",
        "incident_type",
        severity_of(config, F.col("incident_type"), F.col("mandatory")).alias("severity"),
        F.lit("OPEN").alias("status"),
        F.coalesce("incident_description", default_text).alias("short_description"),
        F.col("error_details").alias("error_message"),
        F.col("incident_file").alias("affected_file"),
        F.coalesce("incident_table", "table_name").alias("affected_table"),
        F.col("check_name").alias("affected_check"),
        runbook_of(F.col("incident_type")).alias("runbook_id"),
        F.lit(config.settings.assigned_to).alias("assigned_to"),
    )


TASKS = [  # fixed values: task, kind, critical
    ("file_sensor_task", "SENSOR", True),
    ("ingest_and_validate_file_task", "VALIDATE", True),
    ("load_staging_task", "LOAD", True),
    ("run_data_quality_checks_task", "VALIDATE", True),
    ("load_warehouse_task", "TRANSFORM", True),
    ("reconcile_source_to_target_task", "RECONCILE", True),
    ("generate_ops_report_task", "REPORT", False),
    ("notify_incident_task", "NOTIFY", False),
]


def task_audit(batches: DataFrame, failed_task: str = "load_staging_task") -> DataFrame:
    """Eight audit rows per batch; a failed load skips the critical tasks after it.

    `batches` has batch_id, load_failed and error_message.
    """
    at = next(i for i, t in enumerate(TASKS) if t[0] == failed_task)
    spec = F.array(
        *[
            F.struct(F.lit(i).alias("sequence"), F.lit(t).alias("task_id"), F.lit(k).alias("job_type"), F.lit(c).alias("critical"))
            for i, (t, k, c) in enumerate(TASKS)
        ]
    )
    rows = batches.select("batch_id", "load_failed", "error_message", F.explode(spec).alias("t")).select(
        "batch_id", "load_failed", "error_message", "t.*"
    )
    status = (
        F.when(F.col("load_failed") & (F.col("sequence") == at), "FAILED")
        .when(F.col("load_failed") & F.col("critical") & (F.col("sequence") > at), "SKIPPED")
        .otherwise("SUCCESS")
    )
    return rows.withColumn("status", status).select(
        F.concat_ws(".", F.lit("daily_feeds"), "task_id", "batch_id").alias("run_id"),
        "batch_id", "task_id", "job_type", "sequence", "status",
        F.when(status == "FAILED", F.col("error_message")).alias("error_message"),
    )


def load_failure_incidents(batches: DataFrame, config: Config, already: int = 0) -> DataFrame:
    """One P1 incident per batch whose load aborted."""
    failed = number_rows(batches.filter("load_failed"), [], [F.col("batch_id").asc()], "_n")
    in_file = F.when(F.col("failed_file").isNotNull(), F.concat(F.lit(" ("), F.col("failed_file"), F.lit(")"))).otherwise("")
    return failed.select(
        F.concat(F.lit("INC-"), pad_left(F.col("_n") + already, 6)).alias("incident_id"),
        "batch_id",
        F.lit("LOAD_FAILURE").alias("incident_type"),
        F.lit(config.severity.get("LOAD_FAILURE", "P1")).alias("severity"),
        F.concat(F.lit("Staging stopped"), in_file, F.lit(" in batch "), F.col("batch_id")).alias(
            "short_description"
        ),
        "error_message",
        F.col("failed_file").alias("affected_file"),
        F.lit("staging_energy_data").alias("affected_table"),
        F.lit(INCIDENT_RUNBOOK["LOAD_FAILURE"]).alias("runbook_id"),
    )
