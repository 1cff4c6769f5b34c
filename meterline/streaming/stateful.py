"""Streams that need state of their own: repeated keys as rejected rows, and feeds that miss their deadline.

Repeats are found by joins of each micro-batch with the first rows of earlier
ones, deadlines by a few numbers per feed in the state store. No key is ever
gathered, however many rows it has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from meterline.config import Config, FeedRules
from meterline.functions.joins import fits_broadcast, lookup_join, spread_left_join
from meterline.operators import filechecks as fc
from meterline.operators import rowchecks as rc
from meterline.operators.dq import union_checks
from meterline.session import cut_lineage
from meterline.sources import sinks

ACCEPTED, REJECTED, LATE = "accepted", "rejected", "late"
MILLIS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(interval: str) -> int:
    """Milliseconds of text like `2 days`."""
    number, unit = interval.split()
    return int(number) * MILLIS[unit.rstrip("s")]


@contextmanager
def state_settings(spark: SparkSession, no_data_batches: bool) -> Iterator[None]:
    """Settings a query with own state takes at its start, and those of the session afterwards."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(no_data_batches).lower(),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# ---- repeated keys ------------------------------------------------------------------------------

#: What `judged` has found out about a row, for `write_judged`.
JUDGE = "_judge"


def judged(
    readings: DataFrame, rules: FeedRules, event_time: str, keys: Sequence[str] = ("file_name", "record_id"), position: str = "row_index",
    delay: str = "2 days",
) -> DataFrame:
    """Every reading of a stream with the tests that look at it alone, for `write_judged` to say whether it is accepted, rejected or late.

    The order of tests is that of a batch: blank values, repeated keys, dates,
    ranges. A row whose key came earlier is rejected, in the same micro-batch by
    position, for as long as the watermark has not passed the first row by
    `delay`; rejected rows count as seen. Rows behind the watermark (the newest
    event time of earlier micro-batches less `delay`) are neither tested for
    repeats nor dropped: they come out as late.
    """
    rest = F.coalesce(
        rc.date_reason(readings, rules), rc.range_reason(readings, rules, "energy_kwh"), rc.range_reason(readings, rules, "emissions_co2e"),
    )
    found = F.struct(
        *[F.col(key).alias(f"_key_{n}") for n, key in enumerate(keys)], F.col(position).alias("_position"),
        F.unix_millis(event_time).alias("_at"), rc.null_reason(readings, rules).alias("_null"), rest.alias("_rest"),
    )
    return readings.select("*", found.alias(JUDGE, metadata={"keys": len(keys), "delay": millis(delay)}))


def write_judged(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write rows of `judged` with outcome and first reason under their micro-batch and outcome, until all present files are read.

    Each micro-batch leaves two things beside its checkpoint: the first row of
    each of its keys, and a mark with the newest event time so far and the
    micro-batches whose first rows still count. A key is looked up in those, so
    a micro-batch costs its own rows and one reading of the first rows that
    count; older ones are deleted. Everything lies under its micro-batch, so a
    repeated one replaces itself and sees the same watermark.
    """
    known = stream.schema[JUDGE].metadata
    keys, delay = [f"_key_{n}" for n in range(known["keys"])], known["delay"]
    names = [c for c in stream.columns if c != JUDGE]
    firsts_at, marks_at = f"{checkpoint}/judged/firsts", f"{checkpoint}/judged/marks"

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest, live = 0, []
        if epoch > 0:
            newest, live = spark.read.schema(MARK).parquet(f"{marks_at}/epoch={epoch - 1}").first()
        watermark = max(0, newest - delay)
        dead = [e.epoch for e in live if e.newest + delay < watermark]
        live = [e for e in live if e.epoch not in dead]
        keyed = F.lit(True)
        for key in keys:
            keyed = keyed & F.coalesce(F.col(key) != "", F.lit(False))
        rows = batch.select(*names, f"{JUDGE}.*").withColumns(
            {"_late": F.coalesce(F.col("_at") < watermark, F.lit(False)), "_id": F.monotonically_increasing_id()}
        )
        # A row without a time counts as one of the watermark.
        rows = rows.withColumns({"_tested": keyed & ~F.col("_late"), "_at": F.coalesce("_at", F.lit(watermark))}).persist(StorageLevel.DISK_ONLY)
        place = F.struct("_position", "_id")
        firsts = rows.filter("_tested").groupBy(*keys).agg(
            F.min(F.struct("_position", "_id", "_at")).alias("_first"), F.count(F.lit(1)).alias("_weight")
        )
        firsts = firsts.select(*keys, F.struct("_first._position", "_first._id").alias("_place"), F.col("_first._at").alias("_at"), "_weight")
        kept = T.StructType([*firsts.schema.fields, T.StructField("_known", T.BooleanType())])
        if live:
            earlier = spark.read.schema(kept).parquet(*[f"{firsts_at}/epoch={e.epoch}" for e in live])
            counting = earlier.filter(~F.col("_known") & (F.col("_at") + delay >= watermark)).select(*keys)
            asked = cut_lineage(firsts)
            asking = F.broadcast(asked.select(*keys)) if fits_broadcast(asked) else asked.select(*keys)
            # A key gets another first row only when the one before no longer counts, so it is found once at most.
            repeated = cut_lineage(counting.join(asking, keys, "left_semi").withColumn("_known", F.lit(True)))
            firsts = lookup_join(asked, repeated, keys).withColumn("_known", F.coalesce("_known", F.lit(False)))
        else:
            firsts = firsts.withColumn("_known", F.lit(False))
        firsts.write.mode("overwrite").parquet(f"{firsts_at}/epoch={epoch}")
        firsts = spark.read.schema(kept).parquet(f"{firsts_at}/epoch={epoch}")

        # Only keys with something to reject travel to the join.
        several = firsts.filter("_weight > 1 or _known").select(*keys, "_place", "_known", "_weight")
        if fits_broadcast(several):
            found = rows.join(F.broadcast(several.drop("_weight")), keys, "left")
        else:
            found = spread_left_join(rows, several, keys, "_weight", ["_id"], ~F.col("_tested"))
        is_repeat = F.col("_tested") & F.coalesce(F.col("_known") | (place != F.col("_place")), F.lit(False))
        reason = F.coalesce("_null", F.when(is_repeat, rc.DUPLICATE), "_rest")
        outcome = F.when(F.col("_late"), LATE).when(reason.isNotNull(), REJECTED).otherwise(ACCEPTED)
        said = found.select(
            *names, outcome.alias("outcome"), F.when(~F.col("_late"), reason).alias("rejection_reason"), F.lit(epoch).alias("epoch")
        )
        sinks.write_batches(said, out, ("epoch", "outcome"))

        latest = rows.agg(F.max("_at")).first()[0]
        last = firsts.filter("not _known").agg(F.max("_at")).first()[0]
        live = [(e.epoch, e.newest) for e in live] + ([(epoch, last)] if last is not None else [])
        mark = spark.range(1).select(
            F.lit(max(newest, latest or 0)).cast("long").alias("newest"),
            F.from_json(F.lit(json.dumps([{"epoch": e, "newest": at} for e, at in live])), "array<struct<epoch: long, newest: long>>").alias("live"),
        )
        mark.write.mode("overwrite").parquet(f"{marks_at}/epoch={epoch}")
        rows.unpersist()
        remove(spark, [f"{firsts_at}/epoch={e}" for e in dead])

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MARK = "newest long, live array<struct<epoch: long, newest: long>>"


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of state that no later micro-batch, nor a repeated one, reads."""
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        path = path_of(folder)
        path.getFileSystem(conf).delete(path, True)


# ---- deadlines ----------------------------------------------------------------------------------

EXPECTED = "batch_id string, business_date string, dataset string, source_system string, expected_arrival string, sla_hours double"


class Deadline(StatefulProcessor):
    """One expected file: reported when it arrives, or when the watermark passes its deadline without it."""

    FIELDS = [f.split()[0] for f in EXPECTED.split(", ")]

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", f"{EXPECTED}, deadline long")
        self.file = handle.getValueState("file", "received long, told boolean")

    def said(self, name: str, feed, received: int | None) -> Row:
        return Row(expected_name=name, **dict(zip([*self.FIELDS, "deadline"], feed, strict=True)), received=received)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        feed = self.feed.get() if self.feed.exists() else None
        received, told = self.file.get() if self.file.exists() else (None, False)
        arrived = received
        for row in rows:
            if row["received"] is not None:
                arrived = row["received"] if arrived is None else min(arrived, row["received"])
            elif feed is None:
                feed = tuple(row[f] for f in [*self.FIELDS, "deadline"])
                self.feed.update(feed)
                # Timers count milliseconds; the watermark must have passed the deadline itself.
                self.handle.registerTimer(feed[-1] // 1_000 + 1)
        if received is None and arrived is not None:
            received = arrived
        if feed is not None and received is not None and not told:
            told = True
            yield self.said(key[0], feed, received)
        if received is not None:
            self.file.update((received, told))
            if feed is None:
                self.handle.registerTimer(received // 1_000 + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        feed = self.feed.get() if self.feed.exists() else None
        if feed is None or expiredTimerInfo.getExpiryTimeInMs() >= feed[-1] // 1_000 + self.keep:
            self.feed.clear()
            self.file.clear()
            return
        self.handle.registerTimer(feed[-1] // 1_000 + self.keep)
        if not self.file.exists():
            yield self.said(key[0], feed, None)

    def close(self) -> None:
        pass


def feed_sensor(days: DataFrame, files: DataFrame, config: Config, delay: str = "0 seconds", keep: str = "7 days") -> DataFrame:
    """Expected feeds as they arrive or miss their deadline, from two streams.

    `days` (batch_id, business_date, as_of) says which feeds are due and, by
    `as_of`, how far time has come; `files` has file_name and received_at. Each
    expected feed comes out once when its first file arrives (received_at set)
    and once, with a null received_at, if the watermark passes its deadline
    before. A feed can so be missing first and late afterwards. What happened
    more than `delay` before the newest time of earlier micro-batches is
    ignored; a feed is forgotten `keep` after its deadline.
    """
    due = fc.expected_feeds(days, config)
    expected = due.select(
        "expected_name", *Deadline.FIELDS, F.unix_micros("deadline").alias("deadline"), F.lit(None).cast("long").alias("received"), F.col("as_of").alias("at")
    )
    nothing = {f.split()[0]: f.split()[1] for f in EXPECTED.split(", ")}
    arrived = files.select(
        F.col("file_name").alias("expected_name"), *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()],
        F.lit(None).cast("long").alias("deadline"), F.unix_micros("received_at").alias("received"), F.col("received_at").alias("at"),
    )
    seen = (
        expected.unionByName(arrived)
        .withWatermark("at", delay)
        .groupBy("expected_name")
        .transformWithState(Deadline(millis(keep)), f"expected_name string, {EXPECTED}, deadline long, received long", "Append", "EventTime")
    )
    return seen.withColumns({"deadline": F.timestamp_micros("deadline"), "received_at": F.timestamp_micros("received")}).drop("received")


def write_sensor_checks(sensed: DataFrame, log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the SLA check of each arrival and the arrival check of each missing feed, under their micro-batch."""

    def save(batch: DataFrame, epoch: int) -> None:
        checks = union_checks([fc.sla_checks(batch), fc.arrival_checks(batch, log)])
        sinks.write_batches(checks.withColumn("epoch", F.lit(epoch)), out, ("epoch",))

    with state_settings(sensed.sparkSession, no_data_batches=True):
        writer = sensed.writeStream.outputMode("append").foreachBatch(save)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
