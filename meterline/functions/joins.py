"""Joins and running totals that hold up when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.session import cut_lineage

BROADCAST_ROWS = 200_000
MAX_HOT_KEYS = 1_000
SPREAD = 4_096


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most `max_rows` + 1 rows to prove that a side may be broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread_left_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread_by: Sequence[str | Column],
    matchless: Column | None = None,
) -> DataFrame:
    """Left join `rows` to a lookup with unique keys, spreading hot keys.

    `weight` counts the rows of each key. A key heavier than a thousandth of the
    total weight is hot; there can be at most a thousand of those, so they are
    broadcast. Their rows then take a salt that the shuffled lookup never has,
    which scatters them over all reducers instead of one. The same goes for rows
    that cannot match: null keys and those for which `matchless` holds.
    """
    keys = list(keys)
    values = [c for c in lookup.columns if c not in keys and c != weight]
    total = lookup.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * MAX_HOT_KEYS > total
    hot = lookup.filter(is_hot).select(*keys, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = lookup.filter(~is_hot).select(*keys, F.lit(0).alias("_salt"), *values)
    scatter = F.col("_hot").isNotNull()
    for key in keys:
        scatter = scatter | F.col(key).isNull()
    if matchless is not None:
        scatter = scatter | matchless
    salt = F.when(scatter, F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("int") + 1).otherwise(0)
    joined = (
        rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    )
    picked = [F.coalesce(F.col(f"_hot_{v}"), F.col(v)).alias(v) for v in values]
    return joined.select(*rows.columns, *picked)


def lookup_join(
    rows: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str | Column] | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join rows to a dimension with unique keys: `left`, `inner`, `left_semi` or `left_anti`.

    Broadcast when the dimension is proven small; otherwise weigh the keys of
    the rows with a pre-aggregated count, hot keys missing from the dimension
    included, and use the spreading join.
    """
    keys = list(keys)
    if fits_broadcast(dim, max_rows):
        return rows.join(F.broadcast(dim), keys, how)
    weights = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight"))
    attributes = dim.withColumn("_found", F.lit(True))
    if how in ("left_semi", "left_anti"):
        attributes = attributes.select(*keys, "_found")
    weighed = cut_lineage(weights.join(attributes, keys, "left"))
    joined = spread_left_join(rows, weighed, keys, "_weight", spread_by or rows.columns)
    if how in ("inner", "left_semi"):
        joined = joined.filter("_found")
    elif how == "left_anti":
        joined = joined.filter(F.col("_found").isNull())
    return joined.drop("_found")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Sum of `value` from the first row of each key up to the current row.

    `order` must be total within a key. Rows are range-partitioned, so a hot key
    is cut into many ranges; each range sums its own rows and a small table of
    range totals supplies what came before.
    """
    keys = list(keys)
    placed = df.withColumn("_value", value).repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = cut_lineage(placed.withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_range", *keys).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *keys, F.sum("_total").over(earlier).alias("_before"))
    local = placed.withColumn("_local", F.sum("_value").over(within))
    same = F.col("o._range") == F.col("l._range")
    for key in keys:
        same = same & F.col(f"o.{key}").eqNullSafe(F.col(f"l.{key}"))
    # A key reaches a range from the one before only as its first key: one row per range at most.
    carried = offsets.filter("_before is not null")
    joined = local.alias("l").join(F.broadcast(carried).alias("o"), same, "left")
    total = F.col("l._local") + F.coalesce(F.col("o._before"), F.lit(0))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], total.alias(out))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1, 2, 3 … within each key, without one task holding a whole key."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out).cast("long"))


def next_mark(df: DataFrame, key: str, order: Sequence[str], mark: Column, out: str) -> DataFrame:
    """The `order` values (a struct) of the next row of the same key for which `mark` holds; null after the last.

    Rows are range-partitioned by key and order, each range looks ahead in its
    own rows, and the first marked row of each later range comes from a small
    table, so a hot key is spread over many ranges.
    """
    place = F.struct(*order)
    placed = df.withColumn("_mark", F.when(mark, place)).repartitionByRange(key, *order)
    placed = cut_lineage(placed.withColumn("_range", F.spark_partition_id()))
    # Backwards, as a frame that grows row by row: one that shrinks to the end is summed up anew for every row.
    ahead = Window.partitionBy("_range", key).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("_range", key).agg(F.min("_mark").alias("_first"))
    later = Window.partitionBy(key).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # A key lies in several ranges only if it fills them, so this has a row per range at most.
    carried = firsts.select("_range", key, F.min("_first").over(later).alias("_later")).filter("_later is not null")
    local = placed.withColumn("_next", F.min("_mark").over(ahead))
    joined = local.join(F.broadcast(carried), ["_range", key], "left")
    return joined.select(*df.columns, F.coalesce("_next", "_later").alias(out))


def mark_repeats(df: DataFrame, keys: Sequence[str], position: str, out: str, few: bool = False) -> DataFrame:
    """True on every row whose key already appeared at a lower `position`.

    Only keys that occur more than once travel to the join. `few` says that all
    rows fit one task; a window then takes the place of the join.
    """
    present = None
    for key in keys:
        ok = F.col(key).isNotNull() & (F.col(key) != "")
        present = ok if present is None else present & ok
    if few:
        first = F.min(position).over(Window.partitionBy(*keys))
        return df.withColumn(out, F.coalesce(present & (F.col(position) > first), F.lit(False)))
    firsts = (
        df.filter(present)
        .groupBy(*keys)
        .agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_weight"))
        .filter("_weight > 1")
    )
    firsts = cut_lineage(firsts)
    if fits_broadcast(firsts):
        joined = df.join(F.broadcast(firsts.drop("_weight")), list(keys), "left")
    else:
        joined = spread_left_join(df, firsts, keys, "_weight", [position], ~F.coalesce(present, F.lit(False)))
    return joined.withColumn(out, F.coalesce(F.col(position) > F.col("_first"), F.lit(False))).drop("_first")
