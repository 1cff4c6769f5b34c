"""Quality and performance metrics, their objectives and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.config import Settings
from meterline.functions.numbers import half_up_int, percent, sql_round


def throughput(records: Column, duration_ms: Column) -> Column:
    """Whole records per second; null when no time passed."""
    return F.when(duration_ms > 0, half_up_int(records / duration_ms * 1000))


def quality_metrics(staging: DataFrame, moment: str = "load_timestamp") -> DataFrame:
    """One quality metric per feed and batch, with the kinds of issue it met."""
    kind = F.regexp_extract("rejection_reason", "^[a-z_]+", 0)
    per_kind = staging.groupBy("dataset", "batch_id", F.when(F.col("rejection_reason").isNotNull(), kind).alias("issue")).agg(
        F.count(F.lit(1)).alias("count"), F.max(moment).alias("moment")
    )
    # The kinds of rejection are the handful of test names, so the list per group is bounded.
    issues = F.sort_array(F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("count", "issue"))), asc=False)
    total = F.sum("count")
    valid = F.coalesce(F.sum(F.when(F.col("issue").isNull(), F.col("count"))), F.lit(0))
    return per_kind.groupBy("dataset", "batch_id").agg(
        F.max("moment").alias("timestamp"),
        total.alias("total_records"),
        valid.alias("valid_records"),
        (total - valid).alias("rejected_records"),
        sql_round(F.lit(100.0) * valid / total).alias("quality_score"),
        F.transform(issues, lambda i: F.struct(i["issue"].alias("issue"), i["count"].alias("count"))).alias("top_issues"),
    )


def performance_summary(performance: DataFrame, task: str | None = None) -> DataFrame:
    """Count, mean duration, mean throughput and success rate per task."""
    kept = performance if task is None else performance.filter(F.col("task_name") == task)
    n = F.count(F.lit(1))
    return kept.groupBy(F.col("task_name").alias("task")).agg(
        n.alias("count"),
        half_up_int(F.sum("duration_ms") / n).alias("avg_duration_ms"),
        half_up_int(F.coalesce(F.sum("throughput"), F.lit(0)) / n).alias("avg_throughput"),
        percent(F.count_if(F.col("status") == "SUCCESS"), n).alias("success_rate"),
    )


def sla_violations(quality: DataFrame, performance: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Metrics outside their objective; far outside is critical."""
    q, low = F.col("quality_score"), float(settings.quality_objective)
    ms, slow = F.col("duration_ms").cast("double"), float(settings.duration_objective_ms)

    def row(component: str, metric: Column, expected: float, actual: Column, tolerance: float, critical: Column) -> list[Column]:
        return [
            F.lit(component).alias("component"), "batch_id", "timestamp", metric.alias("metric"), F.lit(expected).alias("expected_value"),
            actual.alias("actual_value"), F.lit(tolerance).alias("tolerance"), F.when(critical, "CRITICAL").otherwise("WARNING").alias("severity"),
        ]

    bad_quality = quality.filter(q < low).select(
        *row("data_quality", F.concat("dataset", F.lit("_quality_score")), low, q, 5.0, q < settings.quality_critical)
    )
    too_slow = performance.filter(ms > slow).select(
        *row("performance", F.concat("task_name", F.lit("_duration_ms")), slow, ms, 2000.0, ms > settings.duration_critical_ms)
    )
    return bad_quality.unionByName(too_slow)


def quality_trend(quality: DataFrame, dataset: str | None = None) -> DataFrame:
    return quality if dataset is None else quality.filter(F.col("dataset") == dataset)


def metric_lines(generic: DataFrame | None, quality: DataFrame, performance: DataFrame) -> DataFrame:
    """All metrics as one JSON text per row, in the export's field names."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    parts = [
        quality.select(
            F.to_json(
                F.struct(
                    stamp, F.lit("data_quality").alias("type"), "dataset", F.col("batch_id").alias("batchId"),
                    F.col("total_records").alias("totalRecords"), F.col("valid_records").alias("validRecords"),
                    F.col("rejected_records").alias("rejectedRecords"), F.col("quality_score").alias("qualityScore"),
                    F.col("top_issues").alias("topIssues"),
                )
            ).alias("value")
        ),
        performance.select(
            F.to_json(
                F.struct(
                    stamp, F.lit("performance").alias("type"), F.col("task_name").alias("taskName"), F.col("batch_id").alias("batchId"),
                    F.col("run_id").alias("runId"), F.col("duration_ms").alias("durationMs"),
                    F.col("records_processed").alias("recordsProcessed"), F.col("throughput").alias("throughputRecordsPerSecond"), "status",
                )
            ).alias("value")
        ),
    ]
    if generic is not None:
        parts.insert(0, generic.select(F.to_json(F.struct(stamp, "name", "value", "unit", "labels")).alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sla_report(violations: DataFrame) -> DataFrame:
    """Totals and the count per component, one row; components are a fixed few."""
    per = violations.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warning"),
    )
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_violations"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical_violations"),
        F.coalesce(F.sum("warning"), F.lit(0)).alias("warning_violations"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("component", "n")))).alias("by_component"),
    )
