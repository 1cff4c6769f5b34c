"""Removal of word runs that occurred earlier, by suffix automata over reference shards.

Each window of `WINDOW` words picks an anchor, the smallest hash among its
shingles of `SHINGLE` words; equal windows pick equal anchors, so only windows
around an anchor that occurs twice can repeat. Neighbouring windows with one
anchor form a segment. Equal segments are merged before any shuffle of text; the
remaining segments of one anchor belong to one reference shard, whose suffix
automaton is built in document order while the segments stream through it: a
matching statistic of `WINDOW` or more marks a window that occurred before. One
automaton of a shard is as large as its segments, so shards travel to the tasks
by a shuffle; a broadcast of all would grow with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import pick, written

WINDOW = 20
SHINGLE = 6
HOT_SEGMENTS = 2_000
SHARD_SEGMENTS = 2_000
CACHE_WORDS = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NO_ID = -(2**63)

_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, remembered for the life of the worker."""
    cache = _hashes
    if len(cache) > CACHE_WORDS:
        cache.clear()
    try:
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for word in words:
            if word not in cache:
                cache[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def segments_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each segment of a text."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = word_hashes(words)
    n = len(words) - SHINGLE + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(rolled, WINDOW - SHINGLE + 1).argmin(axis=1)
    place = least + np.arange(len(least))
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return rolled[place[first]], first, np.diff(first, append=len(place))


class SuffixAutomaton:
    """Suffix automaton of word sequences added one after the other, with matching statistics."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: Iterable) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            known = nexts[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._clone(last, word, known)
                continue
            state, length_here = len(nexts), length[last] + 1
            nexts.append({})
            length.append(length_here)
            link.append(0)
            at = last
            while at != -1 and word not in nexts[at]:
                nexts[at][word] = state
                at = link[at]
            if at != -1:
                target = nexts[at][word]
                link[state] = target if length[target] == length[at] + 1 else self._clone(at, word, target)
            last = state

    def _clone(self, at: int, word, target: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[target]))
        length.append(length[at] + 1)
        link.append(link[target])
        link[target] = copy
        while at != -1 and nexts[at].get(word) == target:
            nexts[at][word] = copy
            at = link[at]
        return copy

    def matches(self, words: list, least: int) -> list[int]:
        """Ends (exclusive) of the runs of `least` words that the automaton holds."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        ends = []
        for i, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                matched += 1
            if matched >= least:
                ends.append(i)
                while link[state] >= 0 and length[link[state]] >= least:
                    state = link[state]
                matched = min(matched, length[state])
        return ends


def text_key(docs: DataFrame) -> DataFrame:
    """Text as bytes with the order of its document: the id (null first), then a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return pick(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("s"), text.cast("binary").alias("text")
    )


def _seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            counts, shas, anchors, twice = [], [], [], []
            for text in part.column("text").to_pylist():
                words = text.split()
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                found, often = np.unique(segments_of(words)[0].view(np.int64), return_counts=True)
                anchors.append(found)
                twice.append(found[often > 1])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (anchors, twice)]
            columns = [part.column("d"), part.column("s"), pa.array(counts, pa.int64()), pa.array(shas, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "s", "n_words", "sha", "anchors", "twice"])


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the segments whose anchor occurs twice in the corpus."""
    kind = pa.list_(pa.int64())
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            rows = []
            for d, s, text, repeated in zip(*(part.column(c).to_pylist() for c in ("d", "s", "text", "repeated")), strict=True):
                anchors, first, count = segments_of(text.split())
                kept = np.isin(anchors.view(np.int64), np.array(repeated, np.int64))
                if kept.any():
                    rows.append((d, s, text, anchors.view(np.int64)[kept], first[kept], count[kept]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), kind, kind, kind]
            names = ["d", "s", "text", "anchors", "first", "count"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["d", "s", "text", "anchors", "first", "count"]
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            out: list[tuple] = []
            for d, s, text, anchors, first, count in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                words = text.split()
                for anchor, start, n in zip(anchors, first, count, strict=True):
                    content = b" ".join(words[start : start + n + WINDOW - 1])
                    out.append((anchor, xxhash.xxh3_128_digest(content), d, s, start, n, content))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["anchor", "hash", "d", "s", "start", "n", "content"],
            )


def _stream(shard: pa.Table) -> pa.Table:
    """First windows of each segment of a shard, as bits from its first window on."""
    ordered = shard.sort_by([("d", "ascending"), ("s", "ascending"), ("start", "ascending")])
    automaton = SuffixAutomaton()
    names: dict[bytes, int] = {}
    bits = []
    for content, n in zip(ordered.column("content").to_pylist(), ordered.column("n").to_pylist(), strict=True):
        words = [names.setdefault(word, len(names)) for word in content.split(b" ")]
        fresh = (1 << n) - 1
        for end in automaton.matches(words, WINDOW):
            fresh &= ~(1 << (end - WINDOW))
        bits.append(fresh)
        automaton.add(words)
    return pa.table({"d": ordered.column("d"), "s": ordered.column("s"), "start": ordered.column("start"), "bits": pa.array(bits, pa.int64())})


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments, one by one, with a hash of their content."""
    for batch in batches:
        out: list[tuple] = []
        for content, n, d, s, start in zip(*(batch.column(c).to_pylist() for c in ("content", "n", "d", "s", "start")), strict=True):
            words = content.split(b" ")
            for j in range(n):
                out.append((xxhash.xxh3_128_digest(b" ".join(words[j : j + WINDOW])), d, s, start + j))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hash", "d", "s", "start"])


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that stay: those that no window covers that is a candidate and not the first of its kind."""
    names = ["d", "s", "text", "first", "count", "fresh"]
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            rows = []
            for d, s, text, first, count, fresh in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                words = text.split()
                stale = np.zeros(len(words) + 1, np.int64)
                for start, n in zip(first, count, strict=True):
                    stale[start : start + n] = 1
                for mark in fresh or ():
                    bits, at = mark["bits"], mark["start"]
                    while bits:
                        if bits & 1:
                            stale[at] = 0
                        bits, at = bits >> 1, at + 1
                edges = np.zeros(len(words) + WINDOW + 1, np.int64)
                edges[: len(stale)] += stale
                edges[WINDOW : WINDOW + len(stale)] -= stale
                covered = np.cumsum(edges)[: len(words)] > 0
                stays = b" ".join([word for word, gone in zip(words, covered.tolist(), strict=True) if not gone])
                rows.append((d, s, int(covered.sum()), hashlib.sha256(stays).hexdigest(), stays))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["d", "s", "n_removed", "kept_sha256", "kept"]
            )


def first_windows(candidates: DataFrame, hot_segments: int = HOT_SEGMENTS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Windows (d, s, start, bits) of the candidates that no earlier one equals.

    Equal segments are merged with partial aggregation, keeping the first. An
    anchor with one segment needs no automaton; the windows of an anchor with
    over `hot_segments` different segments are merged one by one, so that no
    anchor fills a shard.
    """
    schema = "anchor long, hash binary, d long, s long, start long, n long, content binary"
    segments = candidates.mapInArrow(_segments, schema)
    merged = segments.groupBy("anchor", "hash").agg(F.min(F.struct("d", "s", "start", "n")).alias("at"), F.first("content").alias("content"))
    merged = written(merged.select("anchor", "at.*", "content"))
    crowds = written(merged.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")))
    sized = merged.join(crowds, "anchor")
    all_bits = F.expr("shiftleft(1L, cast(n as int)) - 1")
    alone = sized.filter("crowd = 1").select("d", "s", "start", all_bits.alias("bits"))
    hot = sized.filter(F.col("crowd") > hot_segments).select("content", "n", "d", "s", "start")
    windows = hot.mapInArrow(_windows, "hash binary, d long, s long, start long")
    first = windows.groupBy("hash").agg(F.min(F.struct("d", "s", "start")).alias("at"))
    first = first.select("at.*", F.lit(1).cast("long").alias("bits"))
    some = sized.filter((F.col("crowd") > 1) & (F.col("crowd") <= hot_segments))
    shards = max(1, some.count() // shard_segments)
    dealt = some.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    streamed = dealt.select("shard", "d", "s", "start", "n", "content").groupBy("shard").applyInArrow(_stream, "d long, s long, start long, bits long")
    return alone.unionByName(first).unionByName(streamed)


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of every text, and the counts.

    The first frame has d, s, n_removed, kept_sha256 and kept (the words that
    stay, joined by a space) for each row whose text shares an anchor and is no copy;
    the second d, s, n_words, n_removed, kept_sha256 for every row of `docs`.
    """
    keyed = text_key(docs)
    seen = written(keyed.mapInArrow(_seen, "d long, s long, n_words long, sha binary, anchors array<long>, twice array<long>"))
    originals = seen.groupBy("sha").agg(F.min(F.struct("d", "s")).alias("o")).select("sha", F.col("o.d").alias("od"), F.col("o.s").alias("os"))
    originals = written(originals)
    own = seen.filter(F.size("anchors") > 0).join(
        originals.select(F.col("od").alias("d"), F.col("os").alias("s"), F.lit(True).alias("original")), ["d", "s"], "left_semi"
    )
    own = own.dropDuplicates(["d", "s"])
    each = own.select("d", "s", "twice", F.explode("anchors").alias("anchor"))
    anchors = written(each.select("d", "s", "anchor", F.array_contains("twice", F.col("anchor")).alias("twice")))
    counts = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    repeated = written(counts.filter("n > 1 or twice").select("anchor"))
    shared = anchors.join(repeated, "anchor", "left_semi")
    # Many texts may share an id or have none: a list belongs to one text.
    lists = written(shared.groupBy("d", "s").agg(F.collect_list("anchor").alias("repeated")))
    schema = "d long, s long, text binary, anchors array<long>, first array<long>, count array<long>"
    candidates = written(keyed.join(lists, ["d", "s"]).mapInArrow(_candidates, schema))
    fresh = first_windows(candidates).groupBy("d", "s").agg(F.collect_list(F.struct("start", "bits")).alias("fresh"))
    judged = candidates.select("d", "s", "text", "first", "count").join(fresh, ["d", "s"], "left")
    kept = judged.mapInArrow(_kept, "d long, s long, n_removed long, kept_sha256 string, kept binary")
    changed = written(kept.select("d", "s", "n_removed", "kept_sha256")).dropDuplicates(["d", "s"])
    counts = seen.select("d", "s", "n_words", "sha").join(originals, "sha").join(changed, ["d", "s"], "left")
    copy = (F.col("n_words") >= WINDOW) & ((F.col("d") != F.col("od")) | (F.col("s") != F.col("os")))
    report = counts.select(
        "d",
        "s",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
    return kept, report


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    A word goes when a window of 20 words covers it whose sequence also starts
    earlier. A null text has no words; a null id sorts before all others; rows
    of one id and equal text are one document and get equal results, rows of one
    id and different texts are ordered by a hash of the text; an empty table
    gives no rows; further columns are ignored.
    """
    _, report = remove_repeats(docs)
    doc_id = F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id")
    return report.select(doc_id, "n_words", "n_removed", "kept_sha256")
