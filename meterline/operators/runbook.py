"""The runbook catalogue: filtered, ordered reads of the operations tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.times import as_timestamp


def files_of_batch(files: DataFrame, batch_id: str) -> DataFrame:
    return files.filter(F.col("batch_id") == batch_id).orderBy("file_name")


def checks_of_day(checks: DataFrame, business_date: str, check_name: str) -> DataFrame:
    kept = checks.filter((F.col("business_date") == business_date) & (F.col("check_name") == check_name))
    return kept.orderBy(F.col("executed_at").desc())


def checks_of_batch(checks: DataFrame, batch_id: str, names: Sequence[str]) -> DataFrame:
    return checks.filter((F.col("batch_id") == batch_id) & F.col("check_name").isin(list(names))).orderBy("check_name", "check_id")


def incidents_of_batch(
    incidents: DataFrame, types: Sequence[str], batch_id: str | None = None, newest: int | None = None
) -> DataFrame:
    """Incidents of the given types, for one batch or the newest few."""
    kept = incidents.filter(F.col("incident_type").isin(list(types)))
    if batch_id is not None:
        kept = kept.filter(F.col("batch_id") == batch_id)
    ordered = kept.orderBy(F.col("created_at").desc(), F.col("incident_id").desc())
    return ordered if newest is None else ordered.limit(newest)


def task_audit(tasks: DataFrame, batch_id: str, task_id: str | None = None, status: str | None = None) -> DataFrame:
    kept = tasks.filter(F.col("batch_id") == batch_id)
    if task_id is not None:
        kept = kept.filter(F.col("task_id") == task_id)
    if status is not None:
        kept = kept.filter(F.col("status") == status)
    return kept.orderBy("sequence")


def staging_status(staging: DataFrame) -> DataFrame:
    return staging.groupBy("batch_id", "dataset", "validation_status").agg(F.count(F.lit(1)).alias("row_count"))


def rejection_breakdown(staging: DataFrame) -> DataFrame:
    counts = staging.groupBy("batch_id", "validation_status", "rejection_reason").agg(F.count(F.lit(1)).alias("row_count"))
    return counts.orderBy(F.col("row_count").desc())


def repeated(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys occurring more than once, most frequent first."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    ordered = counts.orderBy(F.col("occurrences").desc(), *keys)
    return ordered if limit is None else ordered.limit(limit)


def defective_rows(
    staging: DataFrame,
    limit: int | None = None,
    order: Sequence[str] = ("record_id",),
    required: Sequence[str] = ("record_id", "site_id", "reading_date"),
    measures: Sequence[str] = ("energy_kwh", "emissions_co2e"),
) -> DataFrame:
    """Rows with a missing key or date, or a missing or negative measure."""
    bad = F.lit(False)
    for column in required:
        bad = bad | F.col(column).isNull()
    for column in measures:
        bad = bad | F.col(column).isNull() | (F.col(column) < 0)
    kept = staging.filter(bad)
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def feeds_of_day(files: DataFrame, business_date: str) -> DataFrame:
    start = as_timestamp(f"{business_date} 00:00:00")
    inside = (F.col("expected_arrival_at") >= start) & (F.col("expected_arrival_at") < start + F.expr("INTERVAL 1 DAY"))
    return files.filter(inside).orderBy("dataset")


def failed_or_warned(checks: DataFrame, batch_id: str) -> DataFrame:
    return checks.filter((F.col("batch_id") == batch_id) & F.col("status").isin("FAIL", "WARN")).orderBy("severity", "executed_at")
