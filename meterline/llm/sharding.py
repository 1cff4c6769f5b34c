"""Proportional stratified interleaving: every shard gets the corpus mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.frames import bucket_count, pick, ranked
from meterline.session import cut_lineage

ROW_OVERHEAD = 16


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 17, stratum: str = "source") -> DataFrame:
    """Place every row of `docs` into `shards` shards that all match the mixture of `stratum`.

    Rows are shuffled by a seeded hash of their id and ranked within their
    stratum. The fractional rank (rank + 1/2) / size interleaves the strata in
    proportion; cutting that order into equal counts gives the shards, so shard
    sizes differ by one row at most.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law `rows`, shard,
    slot (0, 1, ... within the shard) and a null grown_shard. A null text counts
    as empty, a null stratum as the empty one, a null id sorts first; repeated
    rows each get a slot of their own; an empty table gives no rows; further
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = pick(docs, "doc_id", stratum, "text").select(
        "doc_id",
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("shuffled"),
    )
    base = cut_lineage(narrow)
    rows = base.count()
    shuffled = [F.shiftrightunsigned("shuffled", 32), F.col("shuffled"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    sizes = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_rows"))
    in_order = ranked(base, "stratum", "shuffled", shuffled, rows, "rank").join(sizes, "stratum")
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("stratum_rows"))
    cells = bucket_count(rows)
    mixed = cut_lineage(
        in_order.withColumn("fraction", fraction).withColumn("cell", F.floor(F.col("fraction") * cells))
    )
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_rows = mixed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    starts = cell_rows.select("cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    # At most MAX_BUCKETS rows of two numbers, whatever the table holds.
    placed = mixed.withColumn(
        "place", F.row_number().over(Window.partitionBy("cell").orderBy("fraction", "stratum", "rank"))
    ).join(F.broadcast(starts), "cell")
    position = placed.withColumn("position", F.col("first") + F.col("place") - 1)
    numbered = position.withColumn("shard", F.expr(f"(position * {shards}L) div {max(rows, 1)}L"))
    first_of_shard = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first_of_shard).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
