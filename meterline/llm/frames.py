"""Frame helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.session import cut_lineage

MAX_BUCKETS = 65_536
BUCKET_ROWS = 500
#: Rows of an Arrow batch that a task turns into Python objects at once.
PART_ROWS = 1_000
#: Functions that drop what an operator keeps in a worker process from task to task.
KEPT: list[Callable[[], None]] = []


def relabelled(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns c0, c1, ... and the label of the first column of each exact name."""
    labels = [f"c{i}" for i in range(len(df.columns))]
    place: dict[str, str] = {}
    for label, name in zip(labels, df.columns, strict=True):
        place.setdefault(name, label)
    return df.toDF(*labels), place


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of each exact name; other columns may repeat or differ only in case."""
    plain, place = relabelled(df)
    return plain.select(*[F.col(place[name]).alias(name) for name in names])


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, at most `PART_ROWS` at a time: a worker keeps the memory of the most Python objects it ever held."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def spared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches, in a worker that first drops what other operators kept in it and gives unused memory back."""
    for drop in KEPT:
        drop()
    pa.default_memory_pool().release_unused()
    yield from batches


def row_key(doc_id: Column, text: Column) -> Column:
    """Hash of an id and its text, by which a row is found again."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def rows_of(docs: DataFrame, keys: DataFrame, how: str, once: bool = False) -> DataFrame:
    """The rows of `docs` whose id and `row_key` are in `keys` (_id, _key): left_semi, or left_anti for the others.

    With `once`, of the rows that share both only the one with the smallest
    hash over the other columns, as JSON text, so columns of any type will do.
    Columns and their names stay as in `docs`.
    """
    plain, place = relabelled(docs)
    doc_id = F.col(place["doc_id"]).cast("long")
    own = plain.withColumn("_row", row_key(doc_id, F.col(place["text"])))
    found = own.join(keys, doc_id.eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")), how)
    if once:
        others = [c for c in plain.columns if c != place["text"]]
        order = Window.partitionBy(place["doc_id"], "_row").orderBy(F.xxhash64(F.to_json(F.struct(*others))))
        found = found.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return found.select(*plain.columns).toDF(*docs.columns)


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back; the shuffle files of the write go when it ends."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(key, before)


def bucket_count(rows: int) -> int:
    """Buckets of about `BUCKET_ROWS` rows, never more than `MAX_BUCKETS`."""
    return max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))


def high_bits_bucket(hashed: Column, buckets: int) -> Column:
    """Bucket of a 64-bit hash, monotone in its upper 32 bits."""
    return F.shiftright(F.shiftrightunsigned(hashed, 32) * F.lit(buckets).cast("long"), 32)


def ranked(df: DataFrame, key: str, hashed: str, order: list[Column], rows: int, out: str) -> DataFrame:
    """0-based rank of every row within `key`, by the hash bucket and then `order`.

    `df` is scanned twice, so it should be a written table or a plain scan;
    `key` and `hashed` must not be null. A hot key is spread over all hash
    buckets, and only the counts of at most `MAX_BUCKETS` buckets of a key meet
    in one task.
    """
    placed = df.withColumn("_bucket", high_bits_bucket(F.col(hashed), bucket_count(rows)))
    counts = placed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = placed.withColumn("_place", F.row_number().over(inside))
    joined = numbered.join(offsets, [key, "_bucket"])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_place") - 1).alias(out))
