"""Dimension and fact loads, the daily mart, lineage edges and batch numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.joins import fits_broadcast, lookup_join, next_mark, number_rows, running_total, spread_left_join
from meterline.functions.numbers import exact, exact_sum, pad_left
from meterline.functions.times import batch_place
from meterline.session import cut_lineage

MART_COLUMNS = ["reading_date", "site_id", "region", "daily_total_kwh", "avg_intensity", "meter_count", "region_rank"]
SITE_FIELDS = ["site_name", "country", "region", "site_type", "effective_from_date"]


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest `order` values per key, by aggregation.

    The maximum of a struct is combined before the shuffle, so a key with many
    versions costs one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def dim_upsert(current: DataFrame, staged: DataFrame, fields: Sequence[str] = SITE_FIELDS) -> DataFrame:
    """Type-1 upsert by site id: the newest batch wins and absent sites stay.

    `current` has site_key, site_id, the fields and loaded_batch; `staged` has
    batch_id, site_id, row_index, validation_status and the fields. New sites
    get keys after the highest one in use. The result replaces the dimension,
    so write it to a new path.
    """
    fields = list(fields)
    valid = staged.filter(F.col("validation_status") == "VALID")
    snapshot = newest_per_key(
        valid.select(
            "site_id", *fields, F.col("batch_id").alias("loaded_batch"), batch_place(F.col("batch_id")).alias("_place"), "row_index"
        ),
        ["site_id"], ["_place", "row_index"],
    ).drop("_place", "row_index")
    kept = current.select("site_id", "site_key", *[F.col(f).alias(f"_{f}") for f in [*fields, "loaded_batch"]], "active_flag")
    both = kept.join(snapshot, "site_id", "full_outer")
    changed = F.col("loaded_batch").isNotNull()
    merged = both.select(
        "site_key",
        "site_id",
        *[F.when(changed, F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in [*fields, "loaded_batch"]],
        F.when(changed, F.lit(True)).otherwise(F.col("active_flag")).alias("active_flag"),
    )
    merged = cut_lineage(merged)
    added = number_rows(merged.filter("site_key is null").drop("site_key"), [], [F.col("site_id").asc()], "_n")
    top = merged.agg(F.coalesce(F.max("site_key"), F.lit(0))).scalar()
    added = added.select((top + F.col("_n")).cast("long").alias("site_key"), *[c for c in merged.columns if c != "site_key"])
    return merged.filter("site_key is not null").unionByName(added)


def fact_load(staged: DataFrame, dim: DataFrame, dataset: str | None = "energy_consumption") -> DataFrame:
    """Accepted readings of known sites; missing measures load as 0."""
    ready = staged.filter((F.col("validation_status") == "VALID") & F.col("site_id").isNotNull())
    if dataset is not None:
        ready = ready.filter(F.col("dataset") == dataset)
    known = lookup_join(ready, dim.select("site_id").distinct(), ["site_id"], "left_semi", ["record_id"])
    return known.select(
        "batch_id",
        "record_id",
        "site_id",
        "reading_date",
        F.coalesce(F.col("energy_kwh"), F.lit(0.0)).alias("energy_kwh"),
        F.coalesce(F.col("emissions_co2e"), F.lit(0.0)).alias("emissions_co2e"),
        "source_file_name",
        *[c for c in ("source_system",) if c in staged.columns],
    )


def scd2_start(snapshot: DataFrame, key: str, fields: Sequence[str], as_of: str) -> DataFrame:
    """The history of a first snapshot, with the day it was delivered."""
    day = F.lit(as_of).cast("date")
    return snapshot.select(
        key, *fields, day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"), F.array(day).alias("seen_on")
    )


def scd2_apply(history: DataFrame, snapshot: DataFrame, key: str, fields: Sequence[str], as_of: str) -> DataFrame:
    """Type-2 history with a snapshot of any day: close, open, insert or join versions.

    `history` has the key, fields, valid_from, valid_to and is_current, and may
    have seen_on, the days on which a version was delivered; without it a version
    counts as delivered on its first day only. `snapshot` has the key and fields,
    one row per key. Attributes are compared value by value, null-safe. Keys
    missing from the snapshot stay as they are.

    A version lasts until the day before another one is delivered. So each key
    of the snapshot is laid out as its deliveries by day, the snapshot takes the
    place of an earlier delivery of its own day, and equal neighbours become one
    version again. With seen_on, snapshots of different days give the same
    history in any order and as often as they come.
    """
    fields = list(fields)
    today = F.lit(as_of).cast("date")
    seen = F.col("seen_on") if "seen_on" in history.columns else F.array("valid_from")
    touched = history.join(snapshot.select(key), key, "left_semi")
    rest = history.join(snapshot.select(key), key, "left_anti")
    delivered = touched.select(key, *fields, F.explode(seen).alias("_day")).filter(F.col("_day") != today)
    # A key has one delivery per day, which bounds what its window and its lists hold.
    days = delivered.unionByName(snapshot.select(key, *fields, today.alias("_day")))
    by_day = Window.partitionBy(key).orderBy("_day")
    values = F.struct(*fields)
    opens = (F.row_number().over(by_day) == 1) | ~values.eqNullSafe(F.lag(values).over(by_day))
    numbered = days.withColumn("_opens", opens).withColumn("_version", F.count_if("_opens").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    versions = numbered.groupBy(key, "_version").agg(
        *[F.min_by(f, "_day").alias(f) for f in fields], F.min("_day").alias("valid_from"), F.sort_array(F.collect_list("_day")).alias("seen_on")
    )
    following = F.lead("valid_from").over(Window.partitionBy(key).orderBy("_version"))
    columns = [key, *fields, "valid_from", "valid_to", "is_current", *(["seen_on"] if "seen_on" in history.columns else [])]
    rebuilt = versions.withColumn("valid_to", F.date_sub(following, 1)).withColumn("is_current", F.col("valid_to").isNull())
    return rest.select(*columns).unionByName(rebuilt.select(*columns))


def fact_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Matched keys add the new value to the cumulative one, others are inserted."""
    both = target.select(*keys, value).unionByName(source.select(*keys, value))
    return both.groupBy(*keys).agg(exact_sum(value).alias(value))


def enrich(
    staged: DataFrame, dim: DataFrame, region_codes: dict[str, str], intensity: dict[str, float], tie: str = "record_id"
) -> DataFrame:
    """Join site attributes, standardise the region, add cumulative energy and weighted emissions."""
    attributes = dim.select("site_id", "country", "region", "site_type")
    joined = lookup_join(staged, attributes, ["site_id"], "left", [tie])
    codes = F.create_map(*[F.lit(x) for p in region_codes.items() for x in p])
    factors = F.create_map(*[F.lit(x) for p in intensity.items() for x in p])
    shaped = joined.withColumn("region_code", F.coalesce(codes[F.col("region")], F.lit("UNKNOWN"))).withColumn(
        "weighted_emissions",
        exact("emissions_co2e").cast("double") * F.coalesce(factors[F.col("site_type")], F.lit(1.0)),
    )
    order = [F.col("reading_date").asc(), F.col(tie).asc()]
    return running_total(shaped, ["site_id"], order, exact("energy_kwh"), "cumulative_energy")


def mart_daily_energy(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Daily totals per site and region, ranked within the region by total.

    The rank of a total is one more than the number of mart rows above it. Equal
    totals are counted first and the counts summed over ranges, so a region is
    never sorted in one task.
    """
    daily = fact.groupBy("reading_date", "site_id").agg(
        exact_sum("energy_kwh").alias("daily_total_kwh"),
        exact_sum("emissions_co2e").alias("_emissions"),
        F.count("emissions_co2e").alias("_measured"),
        F.count(F.lit(1)).alias("meter_count"),
    )
    placed = lookup_join(daily, dim.select("site_id", "region"), ["site_id"], "left", ["reading_date"])
    mart = cut_lineage(
        placed.select(
            "reading_date", "site_id", "region", "daily_total_kwh",
            (F.col("_emissions").cast("double") / F.col("_measured")).alias("avg_intensity"), "meter_count",
            F.coalesce("region", F.lit("")).alias("_place"),
        )
    )
    totals = mart.groupBy("_place", "daily_total_kwh").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(totals, ["_place"], [F.col("daily_total_kwh").desc()], F.col("n"), "upto")
    places = cut_lineage(ranked.withColumn("region_rank", F.col("upto") - F.col("n") + 1).drop("upto"))
    keys = ["_place", "daily_total_kwh"]
    if fits_broadcast(places):
        return mart.join(F.broadcast(places.drop("n")), keys).select(*MART_COLUMNS)
    # Many rows may share one total (idle meters at 0), so the join is spread by its row count.
    return spread_left_join(mart, places, keys, "n", ["site_id", "reading_date"]).select(*MART_COLUMNS)


def lineage_edges(
    accepted: DataFrame, file: str, position: str, transform_id: str, stage: str = "STAGING", kind: str = "STAGING_CLEANSE",
    logic: str = "types checked, formats unified, rules applied",
) -> DataFrame:
    """One edge per accepted row, numbered through the transformation, with what kind of step it is and what the step did."""
    numbered = number_rows(accepted, [], [F.col(file).asc(), F.col(position).asc()], "_n")
    return numbered.select(
        F.lit(stage).alias("stage"),
        F.col("_n").alias("edge_number"),
        F.concat_ws("-", F.lit("SRC"), F.col(file), F.col(position).cast("string")).alias("source_id"),
        F.concat(F.lit(f"STG-{transform_id}-"), (F.col("_n") - 1).cast("string")).alias("target_id"),
        F.lit(kind).alias("transformation_type"),
        F.lit(logic).alias("transformation_logic"),
    )


def lineage_trace(starts: DataFrame, stages: Sequence[DataFrame], id_column: str = "record", max_hops: int = 100) -> DataFrame:
    """Follow edges stage by stage from each start id: its path of ids and the chain of steps.

    `stages` have edge_number, source_id, target_id, and stage and
    transformation_logic for the chain. An edge applies when the path's last id
    equals its source or starts with it (the first `*` of the source is
    dropped). Edges are tried in order, so of several matches the earliest wins
    and only later ones may continue the path.

    After its first edge a path depends on that edge alone. So every edge gets
    its successor once: all sources that are a prefix of an id are found by
    equality on the prefixes of that id which have the length of some source, and
    the next edge of each source by order. A recursive query then walks from
    edge to edge, and the starts take over the path of their first edge. A path
    of more than `max_hops` edges raises an error.
    """
    spark = starts.sparkSession
    numbered = None
    for at, stage in enumerate(stages):
        texts = [F.col(c) if c in stage.columns else F.lit(None).cast("string") for c in ("stage", "transformation_logic")]
        star = F.instr("source_id", "*")
        prefix = F.when(star > 0, F.concat(F.expr("substring(source_id, 1, instr(source_id, '*') - 1)"), F.expr("substring(source_id, instr(source_id, '*') + 1)")))
        part = stage.select(
            F.lit(at).alias("stage_at"), F.col("edge_number").cast("long").alias("number"), F.coalesce(prefix, "source_id").alias("prefix"),
            F.when(star > 0, F.col("source_id")).alias("whole"), "target_id", F.concat_ws(": ", *texts).alias("step"),
        )
        numbered = part if numbered is None else numbered.unionByName(part)
    edges = cut_lineage(numbered)
    place = ["stage_at", "number"]

    # Who asks: every start, before all edges, and every edge's target, after the edge itself.
    before_all = [F.lit(-1).alias("stage_at"), F.lit(-1).cast("long").alias("number")]
    ids = starts.select(F.col(id_column).alias("id"), *before_all).distinct().unionByName(edges.select(F.col("target_id").alias("id"), *place))
    lengths = edges.agg(F.collect_set(F.length("prefix"))).scalar()
    cut = F.transform(F.filter("lengths", lambda n: n <= F.length("id")), lambda n: F.concat(F.lit("<"), F.substring("id", F.lit(1), n)))
    # An id also matches a source that it equals with the star still in it.
    keys = F.array_append(cut, F.concat(F.lit("="), F.col("id")))
    asked = ids.withColumn("lengths", lengths).select("id", *place, F.explode(keys).alias("key"))
    offered = F.array_compact(F.array(F.concat(F.lit("<"), F.col("prefix")), F.concat(F.lit("="), F.col("whole"))))
    sources = edges.select(*place, F.explode(offered).alias("key"))
    known = lookup_join(asked, sources.select("key").distinct(), ["key"], "left_semi", ["id"])
    # A target asks after its own edge, which it may match itself.
    both = known.withColumn("asks", F.lit(True)).unionByName(
        sources.select(F.lit(None).cast("string").alias("id"), *place, "key", F.lit(False).alias("asks"))
    )
    answered = next_mark(both, "key", [*place, "asks", "id"], ~F.col("asks"), "next").filter("asks and next is not null")
    following = answered.groupBy("id", *place).agg(F.min(F.struct(*[F.col(f"next.{c}") for c in place])).alias("next"))
    following = cut_lineage(following)

    # Walk from every edge that something leads to.
    entries = following.select("next.*").distinct()
    walk = edges.join(
        following.filter("stage_at >= 0").select(*place, F.col("next.stage_at").alias("next_stage"), F.col("next.number").alias("next_number")), place, "left"
    )
    walked = spark.sql(
        f"""with recursive hops(stage_at, number, to_stage, to_number, path, chain, hop) max recursion level {max_hops} as (
          select stage_at, number, stage_at, number, cast(array() as array<string>), cast(array() as array<string>), 0 from {{entries}}
          union all
          select h.stage_at, h.number, w.next_stage, w.next_number, array_append(h.path, w.target_id), array_append(h.chain, w.step), h.hop + 1
          from hops h join {{walk}} w on h.to_stage = w.stage_at and h.to_number = w.number)
        select stage_at, number, path, chain from hops where to_stage is null""",
        entries=entries, walk=cut_lineage(walk),
    )
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        walked = cut_lineage(walked)
    finally:
        spark.conf.set(limit, before)
    first = following.filter("stage_at < 0").select(F.col("id").alias(id_column), "next.*")
    taken = lookup_join(starts.select(id_column).join(first, id_column, "left"), walked, place, "left", [id_column])
    empty = F.array().cast("array<string>")
    return taken.select(
        id_column, F.concat(F.array(id_column), F.coalesce("path", empty)).alias("path"), F.coalesce("chain", empty).alias("chain")
    )


def next_batch_ids(runs: DataFrame, day: str = "business_date") -> DataFrame:
    """The id a further run of each date gets: distinct batches so far plus one."""
    counted = runs.groupBy(day).agg((F.count_distinct("batch_id") + 1).alias("n"))
    return counted.select(
        day, F.concat(F.lit("B-"), F.date_format(F.to_date(day), "yyyyMMdd"), F.lit("-"), pad_left("n", 2)).alias("next_batch_id")
    )


def replay_batch(current: DataFrame, corrected: DataFrame, business_date: str) -> DataFrame:
    """Rows of a historical date re-run as a new append-only batch.

    `corrected` holds that date's rows; earlier batches stay as they are.
    """
    done = current.filter(F.col("business_date") == business_date).agg(F.count_distinct("batch_id")).scalar()
    stamp = F.date_format(F.lit(business_date).cast("date"), "yyyyMMdd")
    batch = F.concat(F.lit("B-"), stamp, F.lit("-"), pad_left(done + 1, 2))
    again = corrected.filter(F.col("business_date") == business_date).withColumn("batch_id", batch)
    return current.unionByName(again.select(*current.columns))


def stage_summary(stages: DataFrame) -> DataFrame:
    """Totals over stage results."""
    return stages.agg(
        F.count(F.lit(1)).alias("total_stages"),
        F.coalesce(F.sum("records_read"), F.lit(0)).alias("total_processed"),
        F.coalesce(F.sum("records_rejected"), F.lit(0)).alias("total_rejected"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"),
    )
