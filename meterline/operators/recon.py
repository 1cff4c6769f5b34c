"""Source-to-target reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.numbers import exact, exact_sum, half_up
from meterline.functions.times import as_date, batch_date


def side_totals(rows: DataFrame, side: str, key: str = "batch_id") -> DataFrame:
    """Row count and exact totals of one side per batch."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{side}_count"),
        F.coalesce(exact_sum("energy_kwh"), F.lit(0)).alias(f"{side}_energy"),
        F.coalesce(exact_sum("emissions_co2e"), F.lit(0)).alias(f"{side}_emissions"),
    )


def both_sides(source: DataFrame, target: DataFrame, key: str = "batch_id") -> DataFrame:
    """Source and target totals of every batch on either side; only batch-sized tables meet."""
    joined = side_totals(source, "source", key).join(side_totals(target, "target", key), key, "full_outer")
    return joined.na.fill(0)


def rowcount_recon(totals: DataFrame, key: str = "batch_id") -> DataFrame:
    diff = F.col("source_count") - F.col("target_count")
    return totals.select(
        key, "source_count", "target_count", diff.alias("diff_rows"), F.when(diff == 0, "PASS").otherwise("FAIL").alias("status")
    )


def aggregate_recon(totals: DataFrame, tolerance: float = 0.01, key: str = "batch_id") -> DataFrame:
    """Both totals must agree within the tolerance."""
    energy = F.col("source_energy") - F.col("target_energy")
    emissions = F.col("source_emissions") - F.col("target_emissions")
    limit = F.lit(str(tolerance)).cast("decimal(18,6)")
    ok = (F.abs(energy) <= limit) & (F.abs(emissions) <= limit)
    return totals.select(
        key, energy.alias("energy_diff"), emissions.alias("emissions_diff"), F.when(ok, "PASS").otherwise("FAIL").alias("status")
    )


def cross_dataset(
    rows: DataFrame, base: str, other: str, pass_pct: float = 5, warn_pct: float = 10, key: str = "batch_id",
    dataset: str = "dataset", measure: str = "emissions_co2e",
) -> DataFrame:
    """Deviation of one feed's total from another's, for batches where both delivered."""
    is_base, is_other = F.col(dataset) == base, F.col(dataset) == other
    value = exact(measure)
    totals = (
        rows.filter(is_base | is_other)
        .groupBy(key)
        .agg(
            F.count_if(is_base).alias("base_rows"),
            F.count_if(is_other).alias("other_rows"),
            F.coalesce(F.sum(F.when(is_base, value)), F.lit(0)).cast("double").alias("base_total"),
            F.coalesce(F.sum(F.when(is_other, value)), F.lit(0)).cast("double").alias("other_total"),
        )
        .filter("base_rows > 0 and other_rows > 0")
    )
    pct = F.when(
        F.col("base_total") > 0, F.abs((F.col("other_total") - F.col("base_total")) / F.col("base_total")) * 100
    ).otherwise(0.0)
    return totals.withColumn("variance_pct", pct).withColumn(
        "status",
        F.when(F.col("variance_pct") <= pass_pct, "PASS").when(F.col("variance_pct") <= warn_pct, "WARN").otherwise("FAIL"),
    )


def recon_history(totals: DataFrame, starts: DataFrame, newest: int | None = 15, tolerance: float = 0.01) -> DataFrame:
    """Reconciliation of the newest batches; the status looks at rows and energy only.

    `starts` has batch_id and started_at of every batch that ran.
    """
    line = starts.join(totals, "batch_id", "left").na.fill(0)
    energy = F.col("source_energy") - F.col("target_energy")
    ok = (F.col("source_count") == F.col("target_count")) & (F.abs(energy) <= F.lit(str(tolerance)).cast("decimal(18,6)"))

    def two(c: Column) -> Column:
        return half_up(c, 2)

    rows = line.select(
        "batch_id",
        batch_date("batch_id").alias("business_date"),
        "started_at",
        "source_count",
        "target_count",
        (F.col("source_count") - F.col("target_count")).alias("diff_rows"),
        two(F.col("source_energy")).alias("source_energy"),
        two(F.col("target_energy")).alias("target_energy"),
        two(energy).alias("energy_diff"),
        two(F.col("source_emissions")).alias("source_emissions"),
        two(F.col("target_emissions")).alias("target_emissions"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
    )
    ordered = rows.orderBy(F.col("started_at").desc(), F.col("batch_id").desc())
    return ordered if newest is None else ordered.limit(newest)


def layer_counts(
    rows: DataFrame, layer: str, loaded: str, dataset: Column, site: str = "site_id", per_load: bool = False, day: str | None = None
) -> DataFrame:
    """Rows, sites and load times of one layer per day and feed, or per single load."""
    load_date = F.to_date(loaded)
    if day is not None:
        rows = rows.filter(load_date == as_date(day))
    keys = [load_date.alias("load_date"), dataset.alias("dataset"), *([F.col(loaded).alias("_load")] if per_load else [])]
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.countDistinct(site).alias("unique_sites"),
        F.min(loaded).alias("first_load"),
        F.max(loaded).alias("last_load"),
    )
    return counted.select(F.lit(layer).alias("layer"), "load_date", "dataset", "record_count", "unique_sites", "first_load", "last_load")


def layer_recon(staging: DataFrame, fact: DataFrame, day: str | None = None, fact_name: str = "energy_emissions") -> DataFrame:
    """Counts per layer, feed and load; one day or every day."""
    staged = layer_counts(staging, "STAGING", "load_timestamp", F.col("dataset"), per_load=True, day=day)
    return staged.unionByName(layer_counts(fact, "WAREHOUSE", "loaded_at", F.lit(fact_name), day=day))


def balanced(recon: DataFrame) -> DataFrame:
    return recon.agg(
        F.count_if(F.col("status") == "PASS").alias("balanced"), F.count_if(F.col("status") != "PASS").alias("unbalanced")
    )


def file_to_fact(files: DataFrame, fact: DataFrame) -> DataFrame:
    """Fact rows loaded from each file; the fact shrinks to a row per file before the join."""
    loaded = fact.groupBy(F.col("batch_id"), F.col("source_file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("fact_rows")
    )
    return files.join(loaded, ["batch_id", "file_name"], "left").withColumn(
        "fact_rows", F.coalesce("fact_rows", F.lit(0))
    )


def partial_load(staging: DataFrame, fact: DataFrame) -> DataFrame:
    """Rows each batch has in staging and in the fact."""
    s = staging.groupBy("batch_id").agg(F.count(F.lit(1)).alias("staging_rows"))
    f = fact.groupBy("batch_id").agg(F.count(F.lit(1)).alias("fact_rows"))
    return s.join(f, "batch_id", "full_outer").na.fill(0)


def fact_by_file(fact: DataFrame) -> DataFrame:
    return fact.groupBy("batch_id", "source_file_name").agg(
        F.count(F.lit(1)).alias("fact_rows"), F.round(exact_sum("energy_kwh"), 2).cast("double").alias("total_kwh")
    )
