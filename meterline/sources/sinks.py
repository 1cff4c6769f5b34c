"""Sinks: idempotent batch partitions, CSV, JSON lines and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.numbers import half_up
from meterline.schemas import INCIDENT_COLUMNS, REJECTED_COLUMNS, REPORT_COLUMNS


def write_batches(df: DataFrame, path: str, partitions: tuple[str, ...] = ("batch_id",), batches: DataFrame | None = None) -> None:
    """Replace exactly the partitions present in `df`, so a replayed batch lands once.

    Rows are dealt by partition first, large ones over several tasks, so a
    batch gets few files. `batches` (batch_id) are those that were run: one that
    has no row any more loses the rows it had.
    """
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    if batches is None:
        return
    empty = df.drop(*partitions).limit(0)
    # A run has as many batches as it was asked for; an empty file takes the place of the rows of those left without any.
    for row in batches.select("batch_id").distinct().join(df.select("batch_id"), "batch_id", "left_anti").toLocalIterator():
        empty.write.mode("overwrite").parquet(f"{path}/batch_id={row.batch_id}")


def _csv(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    writer = df.write.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.csv(path)


def export_query(spark: SparkSession, sql: str, path: str, args: dict | None = None, **tables: DataFrame) -> None:
    """Any query's result as CSV with a header; values are bound, never spliced into the text."""
    _csv(spark.sql(sql, args=args or {}, **tables), path)


def write_rejected(rejected: DataFrame, path: str) -> None:
    """Rejected rows as seven-column CSV files per batch; a batch that comes again replaces its own."""
    rows = rejected.select("batch_id", *REJECTED_COLUMNS).hint("rebalance", "batch_id")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
    writer.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_metrics(lines: DataFrame, path: str) -> None:
    """Append metric JSON lines."""
    lines.write.mode("append").text(path)


def write_sla_report(report: DataFrame, violations: DataFrame, path: str) -> None:
    """Report totals and the violations themselves, as JSON lines in two folders."""
    report.write.mode("overwrite").json(f"{path}/summary")
    violations.write.mode("overwrite").json(f"{path}/violations")


def write_report_csv(report: DataFrame, path: str) -> None:
    """Daily reports as 15-column CSV; one row per date, so dates share files."""
    _csv(report.select(*REPORT_COLUMNS), path)


def report_lines(report: DataFrame) -> DataFrame:
    """Markdown of each daily report, one row per line."""

    def table(title: str, rows: list[tuple[str, str]]) -> list[Column]:
        head = [F.lit(""), F.lit(f"## {title}"), F.lit("| Figure | Count |"), F.lit("|---|---|")]
        return head + [F.format_string(f"| {label} | %d |", F.col(c)) for label, c in rows]

    lines = [
        F.concat(F.lit("# Daily operations report "), F.col("report_date")),
        F.concat(F.lit("Health: **"), F.col("overall_health"), F.lit("**")),
        F.lit(""),
        F.format_string(
            "Feeds %d of %d, tasks %d of %d, checks %d of %d; incidents open: %d, P1 %d, P2 %d; totals: %s",
            "files_received", "files_expected", "jobs_succeeded", "jobs_executed", "dq_checks_passed", "dq_checks_executed",
            "open_incidents", "p1_incidents", "p2_incidents", "reconciliation_status",
        ),
        *table("Files", [("Expected", "files_expected"), ("Received", "files_received"), ("Set aside", "files_quarantined")]),
        *table("Tasks", [("Run", "jobs_executed"), ("Done", "jobs_succeeded"), ("Failed", "jobs_failed")]),
        *table("Checks", [("Made", "dq_checks_executed"), ("Passed", "dq_checks_passed"), ("Broken", "dq_checks_failed")]),
        *table("Incidents", [("Open", "open_incidents"), ("P1", "p1_incidents"), ("P2", "p2_incidents")]),
        F.lit(""),
        F.lit("## Reconciliation"),
        F.concat(F.lit("Source against target: "), F.col("reconciliation_status")),
    ]
    return report.select("report_date", F.posexplode(F.array(*lines)).alias("line_number", "line"))


def incident_table(aged: DataFrame) -> DataFrame:
    """The 15-column incident queue."""
    shaped = aged
    if "runbook_link" not in shaped.columns:
        shaped = shaped.withColumn("runbook_link", F.lit(None).cast("string"))
    return shaped.withColumn("escalated", F.col("escalated_flag")).select(*INCIDENT_COLUMNS)


def write_incidents(aged: DataFrame, path: str) -> None:
    _csv(incident_table(aged), path)


def lineage_lines(
    summary: DataFrame, tasks: DataFrame, files: DataFrame, checks: DataFrame, reasons: DataFrame, incidents: DataFrame, alerts: DataFrame
) -> DataFrame:
    """Batch lineage as Markdown: batch, section, key within the section and line.

    Sections: overview, tasks, files, rejection reasons, checks, warehouse,
    source against target, incidents, alerts. Every task, file, check, reason,
    incident and alert is its own row, so a large batch is never gathered; sort
    by section and key when writing one batch.
    """

    def section(df: DataFrame, number: int, key: Column, line: Column) -> DataFrame:
        return df.select("batch_id", F.lit(number).alias("section"), key.cast("string").alias("key"), line.alias("line"))

    def heads(number: int, *lines: str) -> DataFrame:
        text = F.array(*[F.lit(x) for x in lines])
        return summary.select("batch_id", F.lit(number).alias("section"), F.posexplode(text).alias("n", "line")).select(
            "batch_id", "section", F.concat(F.lit(" "), F.col("n").cast("string")).alias("key"), "line"
        )

    def cells(*columns: Column) -> Column:
        text = F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
        return F.concat(F.lit("| "), text, F.lit(" |"))

    facts = [
        ("Business date", F.col("business_date")), ("Status", F.col("status")), ("Wall clock", F.concat(F.col("duration_seconds").cast("string"), F.lit("s"))),
        ("Tasks", F.format_string("%d total, %d failed, %d skipped", "tasks", "failed_tasks", "skipped_tasks")),
        ("Staged", F.format_string("%d valid, %d rejected", "energy_valid", "energy_rejected")),
        ("Fact rows", F.col("target_count")), ("Reconciliation", F.col("recon_status")),
        ("Checks", F.format_string("%d executed, %d passed, %d failed, %d warn", "dq_executed", "dq_passed", "dq_failed", "dq_warn")),
    ]

    def figures(number: int, pairs: list[tuple[str, Column]]) -> DataFrame:
        lines = F.posexplode(F.array(*[cells(F.lit(label), value) for label, value in pairs])).alias("n", "line")
        return summary.select("batch_id", F.lit(number).alias("section"), lines).select(
            "batch_id", "section", F.concat(F.lit("0"), F.col("n").cast("string")).alias("key"), "line"
        )

    def both(source: str, target: str) -> Column:
        return F.concat_ws(" -> ", F.col(source).cast("string"), F.col(target).cast("string"))

    loaded = [
        ("Rows", F.col("target_count")), ("Sites", F.col("sites_covered")), ("kWh", F.col("target_energy")), ("kgCO2e", F.col("target_emissions")),
    ]
    sides = [
        ("Rows", both("source_count", "target_count")), ("kWh", both("source_energy", "target_energy")), ("kWh apart", F.col("energy_diff")),
        ("Result", F.col("recon_status")),
    ]
    target = F.concat_ws(".", "table_name", "column_name")
    moved = F.concat_ws(" -> ", "expected_value", "actual_value")
    parts = [
        heads(1, "# Batch lineage", "| Field | Value |", "|---|---|"),
        figures(1, facts),
        heads(2, "## Tasks", "| # | Task | Duration | Read | Loaded | Rejected | Status |", "|---|---|---|---|---|---|---|"),
        section(
            tasks, 2, F.lpad(F.col("sequence").cast("string"), 20, "0"),
            cells(F.col("sequence"), F.col("task_id"), half_up("duration_seconds", 1), F.col("rows_read"), F.col("rows_loaded"),
                  F.col("rows_rejected"), F.col("status")),
        ),
        heads(3, "## Files", "| File | Dataset | Status |", "|---|---|---|"),
        section(files, 3, F.col("file_name"), cells(F.col("file_name"), F.col("dataset"), F.col("file_status"))),
        heads(4, "## Rejection reasons"),
        section(reasons, 4, F.col("rejection_reason"), F.concat(F.lit("- `"), F.col("rejection_reason"), F.lit("`"))),
        heads(5, "## Checks", "| Check | Target | Expected -> Actual | Severity | Status |", "|---|---|---|---|---|"),
        section(
            checks, 5, F.lpad(F.col("check_id").cast("string"), 20, "0"),
            cells(F.col("check_name"), target, moved, F.col("severity"), F.col("status")),
        ),
        heads(6, "## Warehouse", "| Figure | Value |", "|---|---|"),
        figures(6, loaded),
        heads(7, "## Source -> target", "| Figure | Value |", "|---|---|"),
        figures(7, sides),
        heads(8, "## Incidents", "| Incident | Type | Severity | Status | What |", "|---|---|---|---|---|"),
        section(
            incidents, 8, F.col("incident_id"),
            cells(F.col("incident_id"), F.col("incident_type"), F.col("severity"), F.col("status"), F.col("short_description")),
        ),
        heads(9, "## Alerts", "| At | Type | Severity | Message |", "|---|---|---|---|"),
        section(
            alerts, 9, F.concat_ws(" ", "created_at", "message"),
            cells(F.col("created_at"), F.col("alert_type"), F.col("severity"), F.col("message")),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str, batch_id: str | None = None) -> None:
    """One batch's lines as a text file, or every batch's as sorted CSV.

    A folder per batch would mean thousands of tiny files, so the full export
    keeps the batch as a column and is range-partitioned by it.
    """
    order = ["batch_id", "section", "key"]
    if batch_id is not None:
        one = lines.filter(F.col("batch_id") == batch_id).orderBy(*order)
        one.select(F.col("line").alias("value")).write.text(path)
    else:
        _csv(lines.repartitionByRange(*order).sortWithinPartitions(*order), path)
