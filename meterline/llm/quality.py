"""Hierarchical empirical Bayes quality: a document classifier combined with host and path posteriors.

A logistic classifier over text measures gives each document evidence. Grouped
sums of its probabilities give every host a posterior mean, shrunk towards the
global rate, and every path one shrunk towards its host; the prior strengths are
estimated from how much hosts and paths differ. The posterior odds of a document
are its own odds times the odds of its path, without its own share, over the
global odds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import parts, pick, row_key, rows_of, spared, written

#: Labelled documents for the first guess, from which the steps over all of them start.
LABELLED = 20_000
#: Bins of one step of a search for an order statistic, and so many values are sorted on the driver.
BINS, SORTED = 1_024, 10_000
EDGE = 1e-4
CLEAN_LOSS = 0.002
MAX_STRENGTH = 1e6
MEASURES = (
    "words",
    "word_bytes",
    "symbols",
    "marks",
    "bars",
    "capitals",
    "digits",
    "distinct_words",
    "distinct_pairs",
    "same_next",
    "same_lines",
    "long_words",
)


def measures(text: bytes) -> list[float]:
    """Bounded measures of a whole UTF-8 text, in the order of `MEASURES`."""
    words = text.split()
    n = max(1, len(words))
    solid = max(1, sum(map(len, words)))
    lines = [line for line in text.split(b"\n") if line.strip()]
    following = words[1:]
    kept = lambda drop: len(text.translate(None, drop))
    size = len(text)
    capitals = size - kept(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [
        min(1.0, np.log1p(len(words)) / 8),
        min(1.0, solid / n / 20),
        min(1.0, (size - kept(b"#*$%&<>{}~^=\\")) / n),
        min(1.0, (size - kept(b"!?")) / n),
        min(1.0, (size - kept(b"|")) / n),
        capitals / solid,
        (size - kept(b"0123456789")) / solid,
        len(set(words)) / n,
        len(set(zip(words, following, strict=False))) / max(1, n - 1),
        sum(map(bytes.__eq__, words, following)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(word) > 30 for word in words) / n,
    ]


def measured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, a hash `row` of id and text, host, path and the measures as an array."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "host", "path"]
        for batch in parts(spared(batches)):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.array([measures(text) for text in texts], np.float64).reshape(-1, len(MEASURES))
            lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(MEASURES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], names=[*names, "x"])

    text = F.coalesce("text", F.lit(""))
    narrow = pick(docs, "doc_id", "text", host, path).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id"), text).alias("row"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        text.alias("text"),
    )
    return narrow.mapInArrow(run, "doc_id long, row long, host string, path string, x array<double>")


class Classifier(NamedTuple):
    """Logistic regression on standardised measures and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def odds(self, x: Column) -> Column:
        """Log odds of good quality, as a sum of products over the array of measures."""
        total = F.lit(float(self.weights[-1]))
        k = len(self.mean) // 2
        for i in range(k):
            value = F.element_at(x, i + 1)
            total = total + (value - float(self.mean[i])) * float(self.weights[i] / self.scale[i])
            total = total + (value * value - float(self.mean[k + i])) * float(self.weights[k + i] / self.scale[k + i])
        return total


def fit_classifier(x: np.ndarray, good: np.ndarray, ridge: float = 0.1) -> Classifier:
    """Newton steps on the ridge-regularised log loss; without both classes the odds are those of a fair coin."""
    wide = np.concatenate([x, x * x], axis=1)
    if not len(good) or good.min() == good.max():
        return Classifier(np.zeros(2 * len(MEASURES)), np.ones(2 * len(MEASURES)), np.zeros(2 * len(MEASURES) + 1))
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-3
    design = np.concatenate([(wide - mean) / scale, np.ones((len(wide), 1))], axis=1)
    beta = np.zeros(design.shape[1])
    penalty = ridge * np.eye(len(beta))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (p - good) + penalty @ beta)
        beta -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, beta)


def table_sums(train: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The arrays that `sums` makes of the measures and labels of a batch, added up over all rows; zeros without a row."""
    width = len(MEASURES)
    shape = sums(np.zeros((0, width)), np.zeros(0)).shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            total += sums(x, batch.column("good").to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    rows = train.select("x", "good").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(int(np.prod(shape)))
    for row in rows:
        total[row["i"]] = row["v"]
    return total.reshape(shape)


def fit_on_all(train: DataFrame, start: Classifier, ridge: float = 0.1) -> Classifier:
    """The classifier of `fit_classifier` for all rows of `train` (x, good), from a first guess; tasks add up the Newton steps."""

    def moments(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        wide = np.concatenate([x, x * x], axis=1)
        return np.stack([wide.sum(axis=0), (wide - start.mean).sum(axis=0), ((wide - start.mean) ** 2).sum(axis=0), np.full(wide.shape[1], len(x))])

    total, shifted, squares, rows = table_sums(train, moments)
    n = rows[0]
    mean, scale = total / n, np.sqrt(np.maximum(squares / n - (shifted / n) ** 2, 0)) + 1e-3
    # The same odds in the scale of all rows.
    slopes = start.weights[:-1] / start.scale
    beta = np.append(slopes * scale, start.weights[-1] + (slopes * (mean - start.mean)).sum())
    penalty = ridge * np.eye(len(beta))
    for _ in range(60):

        def step_sums(x: np.ndarray, good: np.ndarray, beta: np.ndarray = beta) -> np.ndarray:
            wide = np.concatenate([x, x * x], axis=1)
            design = np.concatenate([(wide - mean) / scale, np.ones((len(wide), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            return np.column_stack([(design * (p * (1 - p))[:, None]).T @ design, design.T @ (p - good)])

        found = table_sums(train, step_sums)
        step = np.linalg.solve(found[:, :-1] + penalty, found[:, -1] + penalty @ beta)
        beta = beta - step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, beta)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def strength(groups: DataFrame, around: Column) -> float:
    """Prior strength from the spread of group means around what they shrink to, by moments.

    `groups` has n and s, the sum of the probabilities; the spread beyond what
    the size of the groups explains is the variance of the prior.
    """
    within = around * (1 - around)
    row = groups.filter("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - around, 2)),
        F.sum(within),
        F.sum(F.col("n")),
        F.sum(F.col("n") * within),
    ).first()
    if row[2] is None or not row[2]:
        return 1.0
    between = max((row[0] - row[1]) / row[2], 1e-9)
    return float(min(max(row[3] / row[2] / between - 1, 1.0), MAX_STRENGTH))


def quality_posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", labelled: int = LABELLED) -> DataFrame:
    """doc_id, row, host, path, held_out, evidence, doc_p, host_p, path_p, score and kept of every row.

    The classifier learns from all labelled documents outside a held-out quarter
    (crc32 of the id modulo 4 is 2); about `labelled` of them, those with the
    smallest hashes, give the first guess. A document is kept if its score is at
    least the level that rejects `CLEAN_LOSS` of all good training documents, and
    never above one half. Null hosts and paths are the empty one, a null text
    counts as empty, null ids and repeated rows are kept as they are, an empty
    table gives no rows; without labels of both kinds all documents are kept.
    """
    base = written(measured(docs, host, path))
    known = pick(labels, "doc_id", "quality").filter("quality in (0, 1)").filter(remainder(F.col("doc_id")) != 2)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    known = written(known)
    share = min(1.0, labelled / max(1, known.count()))
    train = written(base.select("doc_id", "x").join(known, "doc_id"))
    drawn = train.filter(F.shiftrightunsigned(F.xxhash64(F.lit(13), "doc_id"), 32) < int(share * 2**32))
    sample = drawn.select("doc_id", "x", "good").orderBy("doc_id", "x").collect()
    x = np.array([row["x"] for row in sample], np.float64).reshape(-1, len(MEASURES))
    model = fit_classifier(x, np.array([row["good"] for row in sample], np.float64))
    both = train.select("good").distinct().count() == 2
    if both:
        model = fit_on_all(train, model)
    evidence = model.odds(F.col("x"))
    limited = F.least(F.greatest(evidence, F.lit(-30.0)), F.lit(30.0))
    doc_p = F.least(F.greatest(1 / (1 + F.exp(-limited)), F.lit(EDGE)), F.lit(1 - EDGE))
    judged = base.withColumn("evidence", evidence).withColumn("doc_p", doc_p)

    paths = written(judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    everything = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = everything[1] / everything[0] if everything[0] else 0.5
    rate = min(max(rate, EDGE), 1 - EDGE)
    host_strength = strength(hosts, F.lit(rate))
    host_p = (F.col("s") + host_strength * rate) / (F.col("n") + host_strength)
    placed = paths.join(hosts.select("host", host_p.alias("host_p")), "host")
    path_strength = strength(placed, F.col("host_p"))
    placed = placed.withColumn("path_strength", F.lit(path_strength))

    rest = (F.col("path_strength") * F.col("host_p") + F.col("s") - F.col("doc_p")) / (F.col("path_strength") + F.col("n") - 1)
    rest = F.least(F.greatest(rest, F.lit(EDGE)), F.lit(1 - EDGE))
    odds = lambda p: F.log(p / (1 - p))
    score = 1 / (1 + F.exp(-(odds(F.col("doc_p")) + odds(F.col("path_p")) - float(np.log(rate / (1 - rate))))))
    scored = (
        judged.join(placed, ["host", "path"])
        .withColumn("path_p", rest)
        .withColumn("score", score)
        .withColumn("held_out", remainder(F.col("doc_id")) == 2)
        .select("doc_id", "row", "host", "path", "held_out", "evidence", "doc_p", "host_p", "path_p", "score")
    )
    level = keep_level(scored, known) if both else 0.0
    return scored.withColumn("kept", F.col("score") >= level)


def nth_smallest(scores: DataFrame, rank: int) -> float:
    """The score (between 0 and 1) that `rank` others precede, by counts in ever narrower bins."""
    low, high = 0.0, 1.0
    while True:
        inside = scores.filter(F.col("score").between(low, high))
        place = F.least(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for row in counts.orderBy("bin").collect():
            if rank < row["n"]:
                break
            rank -= row["n"]
        low, high = row["low"], row["high"]
        if low == high:
            return low
        if row["n"] <= SORTED:
            return sorted(found["score"] for found in scores.filter(F.col("score").between(low, high)).collect())[rank]


def keep_level(scored: DataFrame, known: DataFrame) -> float:
    """The score below which `CLEAN_LOSS` of all good training documents lie, at most one half."""
    scores = written(scored.join(known.filter("good = 1"), "doc_id").select("score"))
    rows = scores.count()
    if not rows:
        return 0.0
    place = (rows - 1) * CLEAN_LOSS
    below = nth_smallest(scores, int(place))
    above = nth_smallest(scores, min(rows - 1, int(place) + 1))
    return min(0.5, below + (above - below) * (place - int(place)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The posteriors of every document without the helper column."""
    return quality_posteriors(docs, labels).drop("row")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, columns as in `docs`; equal rows share their verdict."""
    kept = quality_posteriors(docs, labels).filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_key")).count()
    return rows_of(docs, kept, "left_semi")
