"""Backfill: run batches of past dates again and bring the later batches that depend on them up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.config import Config
from meterline.functions.joins import lookup_join
from meterline.functions.times import batch_place
from meterline.operators import dq
from meterline.plans import daily
from meterline.plans.daily import BatchResult
from meterline.session import cut_lineage

# What a batch takes from earlier batches: known sites (readings accepted, references, totals) and the newest reading loaded.
RELOADED = [
    "referential_integrity_check", "freshness_check", "source_to_target_rowcount_recon", "source_to_target_aggregate_recon",
]


@dataclass(frozen=True)
class Backfill:
    """The run of the given batches, and what it changes in later ones.

    `run` is the run itself. `fact` and `checks` hold the new partitions of later
    batches (batch ids in `fact_batches` and `check_batches`, some of which may
    now have no row), `incidents` those that changed checks raise or word anew,
    `dropped` the incident_id of those whose check no longer fails, and `report`
    the reports of all dates whose numbers change, those of the run included.
    """

    run: BatchResult
    fact: DataFrame
    fact_batches: DataFrame
    checks: DataFrame
    check_batches: DataFrame
    incidents: DataFrame
    dropped: DataFrame
    report: DataFrame


def moved_sites(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sites whose first valid batch differs: site_id, was, now (null where the site is not known at all)."""
    both = before.withColumnRenamed("since", "was").join(after.withColumnRenamed("since", "now"), "site_id", "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("now")))


def readings_between(readings: DataFrame, moved: DataFrame) -> DataFrame:
    """Accepted readings of moved sites in batches where the site is known only before or only after the move.

    Only batches between the first and the last place of a move are read, which
    prunes partitions where the readings lie in folders by batch.
    """
    place = batch_place(F.col("batch_id"))
    places = moved.select(F.explode(F.array("was", "now")).alias("at"))
    ends = places.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count_if(F.col("at").isNull()).alias("open")).first()

    def at(end) -> Column:
        return F.struct(F.lit(end.before).alias("before"), F.lit(end.number).cast("long").alias("number"))

    batches = readings.select("batch_id").distinct()
    if ends.low is None:
        reach = batches.limit(0)
    else:
        # A site that was or becomes unknown matters to all batches after its first one.
        reach = batches.filter(place >= at(ends.low)) if ends.open else batches.filter((place >= at(ends.low)) & (place <= at(ends.high)))
    near = readings.filter("validation_status = 'VALID'").join(F.broadcast(reach), "batch_id", "left_semi")
    touched = lookup_join(near, moved.withColumn("_moved", F.lit(True)), ["site_id"], "inner", ["record_id"])
    # Facts need a site known by their batch, references one known before it: either may change.
    changes = [
        ~F.coalesce(F.col("was") <= place, F.lit(False)).eqNullSafe(F.coalesce(F.col("now") <= place, F.lit(False))),
        ~F.coalesce(F.col("was") < place, F.lit(False)).eqNullSafe(F.coalesce(F.col("now") < place, F.lit(False))),
    ]
    return touched.filter(changes[0] | changes[1]).select("batch_id", "dataset", changes[0].alias("fact_changes"))


def backfill(
    spark: SparkSession, folder: str, days: DataFrame, config: Config, stored: BatchResult, arrivals: DataFrame | None = None,
    log: DataFrame | None = None,
) -> Backfill:
    """Run the batches of `days` on top of the stored tables of earlier runs, and find what changes after them.

    A batch of `days` may replace a stored one or be a new one of an old date;
    batches are ordered by date and number. A later batch keeps what its own
    files gave (files, staging, checks of rows); its facts change if a site
    becomes known earlier or later, its freshness if an earlier batch's newest
    reading changes, its reference and reconciliation checks with both. Only
    batches whose rows really change are written anew. Incidents keep their
    numbers; those that a changed check raises are numbered after all others.
    """
    run = daily.run_batches(
        spark, folder, days, config, arrivals, log, stored_sites=stored.sites, stored_fact=stored.fact, stored_incidents=stored.incidents
    )
    again = F.broadcast(days.select("batch_id"))

    def kept(table: DataFrame) -> DataFrame:
        return table.join(again, "batch_id", "left_anti")

    def sites_of(table: DataFrame) -> DataFrame:
        return table.filter("validation_status = 'VALID'").select("batch_id", "site_id")

    sites = kept(stored.sites).unionByName(run.sites, allowMissingColumns=True)
    since = cut_lineage(daily.known_since(sites_of(sites)))
    moved = cut_lineage(moved_sites(daily.known_since(sites_of(stored.sites)), since))

    # Facts of later batches.
    place = batch_place(F.col("batch_id"))
    touched = cut_lineage(
        readings_between(kept(stored.readings), moved).groupBy("batch_id").agg(
            F.max(F.col("fact_changes") & (F.col("dataset") == daily.ENERGY)).alias("fact_changes")
        )
    )
    loads = stored.tasks.filter("task_id = 'load_staging_task'").select(
        "batch_id", (F.col("status") != "FAILED").alias("going"), F.col("start_time").alias("as_of")
    )
    dates = stored.checks.groupBy("batch_id").agg(F.max("business_date").alias("business_date"))
    batches = cut_lineage(kept(loads.join(dates, "batch_id", "left")))
    going = batches.filter("going").select("batch_id", "business_date")
    fact_batches = touched.filter("fact_changes").select("batch_id").join(going.select("batch_id"), "batch_id", "left_semi")
    fact_batches = cut_lineage(fact_batches)
    reloading = stored.readings.join(F.broadcast(fact_batches), "batch_id", "left_semi")
    fact = cut_lineage(daily.fact_of(reloading, since, going))

    # Checks of later batches that depend on earlier ones; only those with another result count.
    related = touched.select("batch_id").join(going, "batch_id")
    readings = stored.readings.join(F.broadcast(related.select("batch_id")), "batch_id", "left_semi")
    masters = stored.sites.join(F.broadcast(related.select("batch_id")), "batch_id", "left_semi")
    names = F.array(*[F.lit(n) for n in config.feeds])
    orphans = daily.orphans_of(readings, masters, since)
    references = dq.staging_checks(
        related.select("*", F.explode(names).alias("dataset")), config, orphans=orphans, names=["referential_integrity_check"]
    )
    untouched = kept(stored.fact).join(F.broadcast(fact_batches), "batch_id", "left_anti")
    newest = untouched.select("batch_id", "reading_date").unionByName(fact.select("batch_id", "reading_date")).unionByName(
        run.fact.select("batch_id", "reading_date")
    )
    dated = going.select("batch_id", F.to_date("business_date").alias("business_date"))
    freshness = dq.freshness_check(dated, newest, config.settings.freshness_days, config.settings.freshness_label_hours)
    totals = daily.recon_checks(
        reloading, fact, fact_batches.join(going, "batch_id"), config
    ).filter(F.col("check_name").isin(RELOADED))
    fresh = cut_lineage(daily.finished_checks([references, freshness, totals], batches, config))
    same = [c for c in fresh.columns if c in stored.checks.columns]
    equal = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("batch_id", "check_name", "dataset", "status", "actual_value", "expected_value", "error_details")]
    changed = fresh.alias("n").join(stored.checks.select(*same).alias("o"), equal, "left_anti")
    changed = cut_lineage(changed)
    check_batches = changed.select("batch_id").distinct()
    keys = ["batch_id", "check_name", "dataset"]
    replaced = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    old_checks = stored.checks.select(*same).join(F.broadcast(check_batches), "batch_id", "left_semi")
    checks = cut_lineage(old_checks.alias("o").join(changed.select(*keys).alias("n"), replaced, "left_anti").unionByName(changed))

    # Incidents of changed checks.
    affected = changed.select("batch_id", F.col("check_name").alias("affected_check")).distinct()
    raised_before = kept(stored.incidents).join(affected, ["batch_id", "affected_check"], "left_semi")
    failing = changed.filter("status = 'FAIL'").select("batch_id", F.col("check_name").alias("affected_check"))
    dropped = raised_before.join(failing, ["batch_id", "affected_check"], "left_anti").select("incident_id")
    told = kept(stored.incidents).select("batch_id", F.col("affected_check").alias("check_name"))
    last = daily.last_number(stored.incidents.select("incident_id").unionByName(run.incidents.select("incident_id")))
    raised = daily.raised_incidents(changed.join(told, ["batch_id", "check_name"], "left_anti"), config, last)
    raised = raised.join(batches.select("batch_id", "business_date", F.col("as_of").alias("created_at")), "batch_id").withColumns(
        {"escalated_flag": F.lit(False), "updated_at": F.col("created_at")}
    )
    # An incident whose check fails in another way keeps number and history and says what is wrong now.
    now = daily.raised_incidents(changed, config, 0).select("batch_id", "affected_check", "short_description", "error_message")
    reworded = raised_before.drop("short_description", "error_message").join(now, ["batch_id", "affected_check"])
    raised = cut_lineage(reworded.unionByName(raised, allowMissingColumns=True))

    # Reports of the dates in question, from logs that have a few rows per batch.
    every_check = kept(stored.checks).select(*same).join(F.broadcast(check_batches), "batch_id", "left_anti").unionByName(checks).unionByName(
        run.checks.select(*same)
    )
    incident_log = (
        kept(stored.incidents).join(dropped.unionByName(raised.select("incident_id")), "incident_id", "left_anti")
        .unionByName(raised, allowMissingColumns=True).unionByName(run.incidents, allowMissingColumns=True)
    )
    report = daily.report_of(
        kept(stored.files).unionByName(run.files, allowMissingColumns=True), kept(stored.tasks).unionByName(run.tasks), every_check,
        incident_log, config,
    )
    on = [
        batches.join(check_batches, "batch_id", "left_semi").select("business_date", "as_of"),
        days.select("business_date", "as_of"),
    ]
    asked = on[0].unionByName(on[1]).select(
        F.explode(F.array("business_date", F.date_format("as_of", "yyyy-MM-dd"))).alias("report_date")
    )
    report = report.join(asked.distinct(), "report_date", "left_semi")
    return Backfill(run, fact, fact_batches, checks, check_batches, raised, dropped, report)
