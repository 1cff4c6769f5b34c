"""The daily run: landing files to checks, staging, warehouse, reconciliation, incidents and report.

`run_batches` handles any number of business dates in one set of Spark jobs; a
replay is the same call with a new batch id for an old date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.config import Config
from meterline.functions.joins import lookup_join
from meterline.functions.times import batch_place
from meterline.operators import dq, filechecks, incidents, ops, recon
from meterline.operators import rowchecks as rc
from meterline.session import cut_lineage
from meterline.sources import landing

ENERGY, CARBON, SITES = "energy_consumption", "carbon_emissions", "site_master"

FILE_LOG = (
    "dataset string, batch_id string, file_name string, file_status string, expected_arrival_at timestamp, created_at timestamp"
)

CHECK_ORDER = [
    "sla_check", "file_arrival_check", "empty_file_check", "checksum_validation", "schema_header_validation", "row_count_check",
    "null_check_mandatory", "duplicate_record_check", "date_validity_check", "numeric_range_check", "referential_integrity_check",
    "rejected_threshold_check", "quarantined_file_check", "freshness_check", "source_to_target_rowcount_recon",
    "source_to_target_aggregate_recon", "cross_dataset_emissions_consistency",
]


@dataclass(frozen=True)
class BatchResult:
    """Tables a run produces; all of them lazy or already written.

    `escalated` holds stored incidents that the run's sweeps handed over, as they are now; `notes` those of all hand-overs.
    """

    files: DataFrame
    checks: DataFrame
    readings: DataFrame
    sites: DataFrame
    fact: DataFrame
    rejected: DataFrame
    tasks: DataFrame
    incidents: DataFrame
    alerts: DataFrame
    report: DataFrame
    escalated: DataFrame
    notes: DataFrame


def dataset_of(config: Config, file_name: Column) -> Column:
    """Feed whose pattern the file name matches for any date."""
    found = F.lit(None).cast("string")
    for d in reversed(list(config.manifest.values())):
        found = F.when(file_name.rlike(d.any_date_regex()), d.name).otherwise(found)
    return found


def receive(spark: SparkSession, folder: str, config: Config, arrivals: DataFrame | None):
    """Delivered CSV files with content profile, digest and control record, and their rows."""
    listed = landing.list_zone(spark, folder).filter(F.col("file_name").endswith(".csv")).select("file_name", "size_bytes", "received_at")
    if arrivals is not None:
        given = arrivals.select("file_name", F.col("received_at").alias("_at"))
        listed = listed.join(given, "file_name", "left").withColumn("received_at", F.coalesce("_at", "received_at")).drop("_at")
    rows, profiles = landing.read_feed(spark, folder)
    sums = landing.checksums(spark, folder).select("file_name", "computed_checksum")
    sidecars = landing.read_sidecars(spark, folder).select(
        F.col("feed_file").alias("file_name"), "expected_rows", F.col("checksum_sha256").alias("manifest_checksum")
    )
    files = (
        listed.join(profiles, "file_name", "left")
        .join(sums, "file_name", "left")
        .join(sidecars, "file_name", "left")
        .join(landing.structural_errors(rows), "file_name", "left")
        .withColumn("dataset", dataset_of(config, F.col("file_name")))
        .withColumn("business_date", F.regexp_extract("file_name", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
        .withColumn("data_rows", F.greatest(F.lit(0), F.coalesce(F.col("lines"), F.lit(0)) - 1))
        .withColumn("header", F.coalesce("header", F.array().cast("array<string>")))
    )
    return files, rows


def stray_files(delivered: DataFrame, days: DataFrame, log: DataFrame, config: Config) -> DataFrame:
    """Delivered files that match no feed, quarantined by the first batch of the call unless an earlier call did so."""
    handled = log.filter("file_status = 'QUARANTINED'").select("file_name").distinct()
    stray = filechecks.naming_violations(delivered.drop("dataset", "business_date"), config).join(handled, "file_name", "left_anti")
    first = days.agg(F.min(F.struct(batch_place(F.col("batch_id")).alias("place"), "batch_id", "business_date")).alias("b"))
    return stray.join(F.broadcast(first.select("b.batch_id", "b.business_date").withColumn("dataset", F.lit("unknown"))), "dataset").withColumn(
        "expected_arrival_at", F.col("business_date").cast("timestamp")
    )


def known_since(sites: DataFrame) -> DataFrame:
    """The place of the first batch that staged each site as valid; `sites` has batch_id and site_id of valid rows."""
    return sites.groupBy("site_id").agg(F.min(batch_place(F.col("batch_id"))).alias("since"))


def fact_of(readings: DataFrame, since: DataFrame, going: DataFrame) -> DataFrame:
    """Accepted energy readings of batches that load, for sites known by then; missing measures load as 0."""
    accepted = lookup_join(readings, since, ["site_id"], "left", ["record_id"]).filter(
        (F.col("validation_status") == "VALID") & (F.col("dataset") == ENERGY) & (F.col("since") <= batch_place(F.col("batch_id")))
    )
    return lookup_join(accepted, going.select("batch_id"), ["batch_id"], "left_semi", ["record_id"]).select(
        "batch_id", "record_id", "site_id", "reading_date", F.coalesce("energy_kwh", F.lit(0.0)).alias("energy_kwh"),
        F.coalesce("emissions_co2e", F.lit(0.0)).alias("emissions_co2e"), "source_file_name", "source_system",
    )


def orphans_of(readings: DataFrame, sites: DataFrame, since: DataFrame) -> DataFrame:
    """Accepted readings per batch and feed whose site neither an earlier batch nor the batch's own site feed has."""
    per_site = readings.filter("validation_status = 'VALID'").groupBy("batch_id", "dataset", "site_id").agg(F.count(F.lit(1)).alias("n"))
    in_master = sites.select("batch_id", "site_id").distinct().withColumn("_listed", F.lit(True))
    return (
        lookup_join(per_site, since, ["site_id"], "left", ["batch_id"])
        .join(in_master, ["batch_id", "site_id"], "left")
        .filter(F.coalesce(F.col("since") >= batch_place(F.col("batch_id")), F.lit(True)) & F.col("_listed").isNull())
        .groupBy("batch_id", "dataset")
        .agg(F.sum("n").alias("orphans"))
    )


def finished_checks(parts: list[DataFrame], days: DataFrame, config: Config) -> DataFrame:
    """Checks with catalogue entry, order and time of their batch."""
    place = F.array_position(F.array(*[F.lit(c) for c in CHECK_ORDER]), F.col("check_name"))
    named = dq.with_catalogue(dq.union_checks(parts), config).withColumn("check_order", place)
    return named.join(days.select("batch_id", F.col("as_of").alias("executed_at")), "batch_id", "left")


def raised_incidents(checks: DataFrame, config: Config, already: int) -> DataFrame:
    """Incidents of failed checks, numbered by batch and order of checks."""
    placed = checks.withColumn("_place", batch_place(F.col("batch_id"))).select("*", "_place.before", "_place.number")
    return dq.derive_incidents(placed, config, ["before", "number", "check_order", "dataset"], already).drop("business_date")


def last_number(stored: DataFrame) -> int:
    """The highest incident number in use."""
    return stored.agg(F.max(F.regexp_extract("incident_id", "([0-9]+)$", 1).try_cast("long"))).first()[0] or 0


def report_of(files: DataFrame, tasks: DataFrame, checks: DataFrame, incident_log: DataFrame, config: Config) -> DataFrame:
    """Daily reports as of the report task, while it runs itself."""
    at_report = tasks.filter("task_id <> 'notify_incident_task'").withColumn(
        "status", F.when(F.col("task_id") == "generate_ops_report_task", "RUNNING").otherwise(F.col("status"))
    )
    mandatory = [d.name for d in config.manifest.values() if d.mandatory]
    return ops.daily_report(files, at_report, checks.withColumn("check_id", F.col("check_order")), incident_log, mandatory)


def recon_checks(readings: DataFrame, fact: DataFrame, batches: DataFrame, config: Config) -> DataFrame:
    """The three source-to-target checks of every batch."""
    valid = readings.filter("validation_status = 'VALID'")
    totals = recon.both_sides(valid.filter(F.col("dataset") == ENERGY), fact)
    line = batches.select("batch_id", "business_date").join(totals, "batch_id", "left").na.fill(0)
    diff = F.col("source_count") - F.col("target_count")
    energy, emissions = F.col("source_energy") - F.col("target_energy"), F.col("source_emissions") - F.col("target_emissions")
    limit = F.lit(str(config.settings.aggregate_tolerance)).cast("decimal(18,6)")
    ok = (F.abs(energy) <= limit) & (F.abs(emissions) <= limit)
    layer = "staging_energy_data -> fact_energy_emissions"

    def pair(e: str, m: str) -> Column:
        return F.format_string("%.2f kWh / %.2f kgCO2e", F.col(e).cast("double"), F.col(m).cast("double"))

    counts = dq.check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), check_name="source_to_target_rowcount_recon",
        status=F.when(diff == 0, "PASS").otherwise("FAIL"), table_name=layer, column_name="batch_id",
        expected_value=F.col("source_count"), actual_value=F.col("target_count"), threshold_value=0,
        error_details=F.when(
            diff != 0,
            F.format_string("%d accepted rows staged, %d loaded: %d apart in batch %s", F.col("source_count"), F.col("target_count"),
                            diff, F.col("batch_id")),
        ),
        incident_table="fact_energy_emissions",
    )
    sums = dq.check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), check_name="source_to_target_aggregate_recon",
        status=F.when(ok, "PASS").otherwise("FAIL"), table_name=layer, column_name="energy_kwh, emissions_co2e",
        expected_value=pair("source_energy", "source_emissions"), actual_value=pair("target_energy", "target_emissions"),
        threshold_value=config.settings.aggregate_tolerance,
        error_details=F.when(
            ~ok, F.format_string("totals differ by %.3f kWh and %.3f kgCO2e", energy.cast("double"), emissions.cast("double"))
        ),
        incident_table="fact_energy_emissions",
    )
    cross = recon.cross_dataset(valid, ENERGY, CARBON, config.settings.cross_pass_pct, config.settings.cross_warn_pct)
    both = batches.select("batch_id", "business_date").join(cross, "batch_id")
    drift = dq.check_row(
        batch_id=F.col("batch_id"), business_date=F.col("business_date"), check_name="cross_dataset_emissions_consistency",
        status=F.col("status"), table_name="staging_energy_data", column_name="emissions_co2e",
        expected_value=F.format_string("%.2f by energy", "base_total"), actual_value=F.format_string("%.2f by carbon", "other_total"),
        threshold_value=f"{config.settings.cross_pass_pct:g}%",
        error_details=F.when(
            F.col("status") != "PASS",
            F.format_string("the two feeds disagree by %.1f%%", "variance_pct"),
        ),
    )
    return dq.emit(line, counts, sums).unionByName(dq.emit(both, drift))


def run_batches(
    spark: SparkSession, folder: str, days: DataFrame, config: Config, arrivals: DataFrame | None = None, log: DataFrame | None = None,
    stored_sites: DataFrame | None = None, stored_fact: DataFrame | None = None,
    stored_incidents: DataFrame | None = None,
) -> BatchResult:
    """Run every batch of `days` (batch_id, business_date text, as_of) over the landing folder.

    `arrivals` may state when files were received; `log` holds files handled by earlier runs. `stored_sites`, `stored_fact`
    and `stored_incidents` are the tables `sites`, `fact` and `incidents` that earlier runs returned: their sites stay known,
    freshness looks at their readings, and incident numbers go on after theirs. What they hold of the batches of `days` is
    replaced by this run.
    """
    days = days.select("batch_id", "business_date", "as_of")

    def before(stored: DataFrame) -> DataFrame:
        return stored.join(F.broadcast(days.select("batch_id")), "batch_id", "left_anti")

    log = log if log is not None else spark.createDataFrame([], FILE_LOG)
    delivered, rows = receive(spark, folder, config, arrivals)

    # Sensor and file gate.
    matched = filechecks.match_files(filechecks.expected_feeds(days, config), delivered.select("file_name", "received_at"))
    receipts = matched.filter("received_at is not null").select(
        "batch_id", "business_date", "dataset", "feed_order", F.col("expected_name").alias("file_name"), "expected_arrival_at", "source_system"
    )
    receipts = receipts.join(delivered.drop("dataset", "business_date"), "file_name")
    files = cut_lineage(
        filechecks.quarantine_decision(receipts, config).withColumn(
            "file_status",
            F.when(F.col("file_status") == "QUARANTINED", "QUARANTINED").when(F.col("load_error").isNotNull(), "FAILED").otherwise("PROCESSED"),
        ).withColumn(
            "zone", F.when(F.col("file_status") == "PROCESSED", "PROCESSED").otherwise(F.col("zone"))
        )
    )

    # Staging: rows of files that passed the gate and have no broken record.
    loaded = files.filter("file_status = 'PROCESSED'").select("file_name", "batch_id", "dataset", "source_system")
    columns = sorted({c for f in config.feeds.values() for c in f.required_columns})
    feed = landing.feed_columns(lookup_join(rows, loaded, ["file_name"], "inner", ["row_index"]), columns)
    checked = cut_lineage(rc.validate_rows(feed, config.feeds.values()))
    dims = [f.name for f in config.feeds.values() if f.is_dimension]
    is_dim = F.col("dataset").isin(dims)
    readings = rc.stage_readings(checked.filter(~is_dim), config.feeds.values(), source_system=F.col("source_system"))
    sites = rc.stage_sites(checked.filter(is_dim))
    rejected = rc.rejected_rows(checked.filter(~is_dim))

    # A broken file fails its batch: later critical steps do not run.
    broken = files.groupBy("batch_id").agg(
        F.bool_or(F.col("file_status") == "FAILED").alias("load_failed"),
        F.min(F.when(F.col("file_status") == "FAILED", F.col("file_name"))).alias("failed_file"),
        F.min(F.when(F.col("file_status") == "FAILED", F.col("load_error"))).alias("error_message"),
    )
    status = cut_lineage(days.join(broken, "batch_id", "left").withColumn("load_failed", F.coalesce("load_failed", F.lit(False))))
    going = status.filter("not load_failed").select("batch_id", "business_date")

    # Warehouse: a site is known from the first batch that staged it as valid.
    valid_sites = sites.filter("validation_status = 'VALID'").select("batch_id", "site_id")
    if stored_sites is not None:
        valid_sites = valid_sites.unionByName(before(stored_sites.filter("validation_status = 'VALID'").select("batch_id", "site_id")))
    since = known_since(valid_sites)
    fact = cut_lineage(fact_of(readings, since, going))

    # Checks.
    orphans = orphans_of(readings, sites, since)
    names = F.array(*[F.lit(n) for n in config.feeds])
    every = going.select("*", F.explode(names).alias("dataset"))
    stats = every.join(rc.load_stats(checked, ["batch_id", "dataset"], config.feeds.values()), ["batch_id", "dataset"], "left")
    stats = stats.na.fill(0).withColumn("nulls_by_column", F.coalesce("nulls_by_column", F.create_map().cast("map<string,bigint>")))
    violations = dq.staged_violations(readings, config.feeds.values())
    quarantine_rows = days.select("batch_id", "business_date").join(
        files.select("batch_id", "file_name", "file_status", "error_message"), "batch_id", "left"
    )
    dated = days.select("batch_id", F.to_date("business_date").alias("business_date"))
    ran = going.select("batch_id")
    dates = fact.select("batch_id", "reading_date")
    if stored_fact is not None:
        dates = dates.unionByName(before(stored_fact.select("batch_id", "reading_date")))
    parts = [
        filechecks.sla_checks(matched),
        filechecks.arrival_checks(matched, log),
        filechecks.file_checks(files, config),
        dq.staging_checks(stats, config, violations, orphans),
        dq.quarantine_check(quarantine_rows).join(ran, "batch_id", "left_semi"),
        dq.freshness_check(dated, dates, config.settings.freshness_days, config.settings.freshness_label_hours).join(ran, "batch_id", "left_semi"),
        recon_checks(readings, fact, going, config),
    ]
    checks = cut_lineage(finished_checks(parts, days, config))

    # Incidents, alerts, audit and report.
    last = last_number(before(stored_incidents)) if stored_incidents is not None else 0
    raised = raised_incidents(checks, config, last).withColumn("failed_by", F.col("affected_check"))
    already = last + raised.count()
    loads = dq.load_failure_incidents(status, config, already).withColumn("status", F.lit("OPEN"))
    both = raised.unionByName(loads, allowMissingColumns=True).drop("business_date")
    created = both.join(days.select("batch_id", "business_date", F.col("as_of").alias("created_at")), "batch_id").withColumns(
        {"escalated_flag": F.lit(False), "updated_at": F.col("created_at")}
    )

    # The sweep at the end of each batch hands over what has been open too long.
    sweeps = days.agg(F.sort_array(F.collect_set("as_of"))).scalar()
    swept = cut_lineage(incidents.swept(created, sweeps, config.settings))
    incident_log = swept.drop("escalated_at")
    earlier = before(stored_incidents) if stored_incidents is not None else incident_log.limit(0)
    taken = cut_lineage(incidents.swept(earlier, sweeps, config.settings).filter("escalated_at is not null"))
    due = swept.filter("escalated_at is not null").unionByName(taken, allowMissingColumns=True)
    notes = incidents.escalation_notes(due, F.col("escalated_at"), config.settings)
    by_sweep = due.groupBy(F.col("escalated_at").alias("as_of")).agg(F.count(F.lit(1)).alias("escalations"))
    first_at = days.groupBy("as_of").agg(F.min(F.struct(batch_place(F.col("batch_id")).alias("place"), "batch_id")).alias("b"))
    handed_over = by_sweep.join(first_at, "as_of").select("b.batch_id", "escalations")
    per_batch = [
        receipts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files")),
        incident_log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("incidents")),
        handed_over,
    ]
    summary = days
    for counts in per_batch:
        summary = summary.join(counts, "batch_id", "left")
    alerts = dq.union_checks([
        incidents.incident_alerts(incident_log, config.settings),
        incidents.escalation_alerts(due, F.col("escalated_at"), config.settings),
        incidents.completion_alerts(summary.na.fill(0, ["files", "incidents", "escalations"]), F.col("as_of"), config.settings),
    ])
    tasks = dq.task_audit(status).join(days.select("batch_id", F.col("as_of").alias("start_time")), "batch_id")
    strays = stray_files(delivered, days, log, config)
    every_file = cut_lineage(files.unionByName(strays, allowMissingColumns=True))
    report = report_of(every_file, tasks, checks, incident_log, config)
    return BatchResult(
        every_file, checks, readings, sites, fact, rejected, tasks, incident_log, alerts, report, taken.drop("escalated_at"), notes
    )
