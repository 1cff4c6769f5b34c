"""Feed files and readings as Structured Streaming jobs.

Every sink is keyed by the micro-batch, so a retried micro-batch replaces its
own output.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.config import FeedRules
from meterline.functions.numbers import sql_round
from meterline.operators import rowchecks as rc
from meterline.sources import landing, sinks


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Noted:
    """A DataFrame whose calls are noted in `steps`, each made on the result of the one before."""

    def __init__(self, df, steps: list):
        self.df, self.steps, self.at = df, steps, len(steps)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def __getattr__(self, name: str):
        def call(*args, **options):
            if self.at != len(self.steps):
                raise RuntimeError(f"{name} is not called on the last result")
            done = getattr(self.df, name)(*args, **options)
            self.steps.append((name, args, options))
            return Noted(done, self.steps)

        return call


class Recipe:
    """A chain of DataFrame calls whose columns are built once, for micro-batches of one schema.

    Building some hundred columns takes longer than a small micro-batch; they
    name their inputs, so those built for the first one do for all.
    """

    def __init__(self, make):
        self.make, self.steps = make, None

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.steps is None:
            steps: list = []
            made = self.make(Noted(df, steps)).df
            self.steps = steps
            return made
        for name, args, options in self.steps:
            df = getattr(df, name)(*args, **options)
        return df


def landing_stream(
    spark: SparkSession, folder: str, rules: Iterable[FeedRules], dataset: Column, out: str, checkpoint: str, columns: list[str],
    name: Column | None = None, glob: str = "*.csv", files_per_batch: int = 1000,
) -> StreamingQuery:
    """Validate newly landed feed files and stage them under their micro-batch.

    A file always arrives in one micro-batch, so the repeated-key test of a file
    sees all its rows, exactly as in a batch run. What a micro-batch costs besides
    its rows counts as often as there are micro-batches, so one of few lines is
    staged by a single job.
    """
    rules = list(rules)
    lines = landing.text_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder, glob)

    def tested(rows: DataFrame, few: bool) -> DataFrame:
        feed = landing.feed_columns(rows, columns).withColumn("dataset", dataset).withColumn("batch_id", F.lit(""))
        return rc.stage_readings(rc.validate_rows(feed, rules, few=few), rules)

    small = Recipe(lambda batch: tested(landing.index_few(batch, name), True))

    def stage(batch: DataFrame, epoch: int) -> None:
        staged = small(batch) if landing.are_few(batch) else tested(landing.index_records(batch, name)[0], False)
        sinks.write_batches(staged.withColumn("batch_id", F.lit(f"M-{epoch:08d}")), out)

    return _run(lines.writeStream.foreachBatch(stage), checkpoint)


def plain_reason(df: DataFrame, rules: FeedRules) -> Column:
    """First reason of the tests that look at one row only."""
    return F.coalesce(
        rc.null_reason(df, rules), rc.date_reason(df, rules), rc.range_reason(df, rules, "energy_kwh"),
        rc.range_reason(df, rules, "emissions_co2e"),
    )


def deduplicated(readings: DataFrame, rules: FeedRules, event_time: str, keys: list[str], delay: str = "2 days") -> DataFrame:
    """Accepted readings with one row per key; state older than the delay is dropped.

    `readings` is a stream of feed columns with an event-time column.
    """
    valid = readings.filter(plain_reason(readings, rules).isNull())
    return valid.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def rejected_readings(readings: DataFrame, rules: FeedRules) -> DataFrame:
    """Readings that fail a test which looks at one row only, with the first reason; the other half of `deduplicated`."""
    return readings.withColumn("rejection_reason", plain_reason(readings, rules)).filter("rejection_reason is not null")


def rolling_quality(readings: DataFrame, rules: FeedRules, event_time: str, delay: str = "1 day") -> DataFrame:
    """Valid and total readings per feed and day, updated as readings arrive.

    Days older than the watermark are final; readings later than that are dropped.
    """
    marked = readings.withColumn("ok", plain_reason(readings, rules).isNull())
    counts = (
        marked.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 day"), "dataset")
        .agg(F.count(F.lit(1)).alias("total_records"), F.count_if("ok").alias("valid_records"))
    )
    return counts.select(
        F.to_date("window.start").alias("load_date"), "dataset", "total_records", "valid_records",
        sql_round(F.lit(100.0) * F.col("valid_records") / F.col("total_records")).alias("quality_score"),
    )


def count_quality(
    readings: DataFrame, rules: FeedRules, event_time: str, out: str, checkpoint: str, keep: list[str], delay: str = "1 day"
) -> StreamingQuery:
    """Valid and total readings per feed and day under `counts`, readings behind the watermark under `late`.

    The watermark of a micro-batch is the newest event time of the earlier ones
    less `delay`, as in `rolling_quality`, but what lies behind it is kept: late
    rows come out with their `keep` columns instead of vanishing, so counted and
    late rows add up to all that was read. Counts are combined before they are
    written and added up by `counted_quality`. Everything is written under its
    micro-batch, so a repeated one replaces itself and sees the same watermark.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = f"{out}/marks"
        known = None
        if epoch > 0:
            earlier = spark.read.schema("newest timestamp, epoch long").parquet(marks).filter(F.col("epoch") < epoch)
            known = earlier.agg((F.max("newest") - F.expr(f"interval {delay}")).alias("mark")).first().mark
        late = F.col(event_time) < F.lit(known) if known is not None else F.lit(False)
        rows = batch.withColumns(
            {"_ok": plain_reason(batch, rules).isNull(), "_late": F.coalesce(late, F.lit(False)), "epoch": F.lit(epoch).cast("long")}
        ).persist()
        counts = rows.filter("not _late").groupBy(F.to_date(event_time).alias("load_date"), "dataset", "epoch").agg(
            F.count(F.lit(1)).alias("total_records"), F.count_if("_ok").alias("valid_records")
        )
        sinks.write_batches(counts, f"{out}/counts", ("epoch",))
        sinks.write_batches(rows.filter("_late").select(*keep, "epoch"), f"{out}/late", ("epoch",))
        sinks.write_batches(rows.groupBy("epoch").agg(F.max(event_time).alias("newest")), marks, ("epoch",))
        rows.unpersist()

    return _run(readings.writeStream.foreachBatch(save), checkpoint)


def counted_quality(spark: SparkSession, out: str) -> DataFrame:
    """Quality per feed and day over all micro-batches that `count_quality` has written."""
    counts = spark.read.schema("load_date date, dataset string, total_records long, valid_records long, epoch long").parquet(f"{out}/counts")
    totals = counts.groupBy("load_date", "dataset").agg(*[F.sum(c).alias(c) for c in ("total_records", "valid_records")])
    return totals.withColumn("quality_score", sql_round(F.lit(100.0) * F.col("valid_records") / F.col("total_records")))


def write_updates(stream: DataFrame, out: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write each micro-batch's rows under its epoch."""

    def save(batch: DataFrame, epoch: int) -> None:
        sinks.write_batches(batch.withColumn("epoch", F.lit(epoch)), out, ("epoch",))

    return _run(stream.writeStream.outputMode(mode).foreachBatch(save), checkpoint)


def latest_updates(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last written version of every key."""
    rest = [c for c in written.columns if c not in keys and c != "epoch"]
    best = written.groupBy(*keys).agg(F.max(F.struct("epoch", *rest)).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])
