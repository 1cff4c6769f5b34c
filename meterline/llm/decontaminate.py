"""Benchmark decontamination: latent semantic retrieval of passages, order and answer checks.

Windows of every text are compared with the benchmark items by their cosine in a
latent space. Around those close to an item the longest common subsequence of
words decides, and for paraphrases whether the answer of the item occurs.

What the cosine misses comes by a second, exact path. A copy misses few words of
its item, so it holds several of any set of its words that is larger than what
it may miss. The words that fewest documents hold are such a set: wherever enough
of them lie close together, the same checks decide. The column `latent` says what
the cosine found.

The vocabulary of the space is that of the benchmark, weighted by inverse document frequencies counted
over all documents. A randomised SVD of the TF-IDF passages of all documents
gives the space: tasks sketch their passages, a grouped sum adds the sketches
word by word, and the driver factorises what has one row per benchmark word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import parts, pick, row_key, rows_of, spared, written

RANK = 64
PASSAGE = 48
LENGTH_STEP = 1.5
LONGEST = 96
LEAST_WEIGHT = 0.1
COSINE = 0.4
COPY = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
BLOCK_WORDS = 200_000
BATCH_WORDS = 100_000
#: Rows of word vectors that a sketch adds up at once, so that they stay in a core's cache.
SUM_ROWS = 8_192
#: Items of fewer words are found by what a copy or their answer keeps, longer ones by what any paraphrase keeps.
SHORT = 15
#: Word lists of at most so many words fit a 64-bit lane.
LANES = 63
#: Rows of one step of work: hits of telling words, regions, cosines, windows.
HITS, REGIONS, COSINES, WINDOWS = 2_000_000, 200_000, 4_000_000, 4_096
#: Slots for each key of the table of places, and the factor that spreads keys over them.
SLOTS, SPREAD = 8, np.uint64(0x9E3779B97F4A7C15)
#: Pairs of a list and a word up to which the places stand in a plain table (16 MB).
PLAIN_PLACES = 2_000_000
ENDS = ".,;:!?\"'()[]"
MARKS = frozenset(ENDS)
SENTENCE = re.compile(r"[.!?]\s+")


def plain(word: str) -> str:
    return word.lower().strip(ENDS)


class Item(NamedTuple):
    item_id: int | None
    words: list[str]
    answer: list[str]


def item_of(item_id: int | None, text: str) -> Item:
    """Words of an item; its answer is its last sentence, at least three words and at most half of it."""
    words = [plain(word) for word in text.split()]
    last = [plain(word) for word in SENTENCE.split(text.strip())[-1].split()]
    n = max(3, min(len(last), len(words) // 2))
    return Item(item_id, words, words[-n:])


class Vocabulary:
    """Numbers of words: those of the benchmark first, one number after them for all others."""

    def __init__(self, words: list[str]):
        self.known = {word: i for i, word in enumerate(words)}
        self.size = len(words)

    def of(self, text: str) -> np.ndarray:
        """Numbers of the words of a text; only those that start or end with a mark are looked up a second time."""
        tokens = text.lower().split()
        found = list(map(self.known.get, tokens))
        for i, number in enumerate(found):
            if number is None:
                token = tokens[i]
                marked = token[-1] in MARKS or token[0] in MARKS
                found[i] = self.known.get(token.strip(ENDS), self.size) if marked else self.size
        return np.fromiter(found, np.int64, len(found))


def numbered(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, row and the word numbers of every text as little-endian bytes, written once for all passes."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = number_type(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in parts(spared(batches)):
            ids = [vocabulary.of(text).astype(kind).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.binary())], names=["doc_id", "row", "ids"])

    return written(docs.mapInArrow(run, "doc_id long, row long, ids binary"))


def number_type(words: list[str]) -> str:
    return "<u2" if len(words) < 1 << 16 else "<u4"


def batches_of(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """doc_id, row, lengths and all word numbers of some documents at a time, about `BATCH_WORDS` words."""
    ids, keys, texts, held = [], [], [], 0
    columns = (batch.column(c).to_pylist() for c in ("doc_id", "row", "ids"))
    for doc_id, key, packed in zip(*columns, strict=True):
        ids.append(doc_id)
        keys.append(key)
        texts.append(packed)
        held += len(packed)
        if held >= BATCH_WORDS * int(kind[-1]):
            yield ids, keys, np.array([len(t) // int(kind[-1]) for t in texts]), np.frombuffer(b"".join(texts), kind).astype(np.int64)
            ids, keys, texts, held = [], [], [], 0
    if ids:
        yield ids, keys, np.array([len(t) // int(kind[-1]) for t in texts]), np.frombuffer(b"".join(texts), kind).astype(np.int64)


def document_frequencies(ids: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """Documents that hold each benchmark word, and the number of documents."""
    size, kind = len(words) + 1, number_type(words)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, _, lengths, number in batches_of(batch, kind):
                total[-1] += len(lengths)
                pairs = np.sort(np.repeat(np.arange(len(lengths)), lengths) * size + number)
                fresh = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))] % size
                total[:-1] += np.bincount(fresh, minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["word", "n"])

    counts = ids.select("doc_id", "row", "ids").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for row in counts:
        df[row[0]] = row[1]
    return df[: len(words)], int(df[-1])


def stable_order(values: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers from 0 up to `below`; numbers of 16 bits are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")


def run_sums(vectors: np.ndarray, taken: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the vectors `taken` over the runs that begin at `starts`, some thousand rows at a time."""
    cuts = np.append(starts, len(taken))
    sums = np.empty((len(starts), vectors.shape[1]), vectors.dtype)
    rows = np.empty((SUM_ROWS, vectors.shape[1]), vectors.dtype)
    run = 0
    while run < len(starts):
        end = max(run + 1, int(np.searchsorted(cuts, cuts[run] + SUM_ROWS, side="right")) - 1)
        part = taken[cuts[run] : cuts[end]]
        held = rows[: len(part)] if len(part) <= SUM_ROWS else None
        np.add.reduceat(vectors.take(part, axis=0, out=held, mode="clip"), cuts[run:end] - cuts[run], axis=0, out=sums[run:end])
        run = end
    return sums


def passage_sketch(ids: DataFrame, words: list[str], weights: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A^T A directions for the TF-IDF matrix A of all passages, one row per benchmark word."""
    weights = weights.astype(np.float32)
    shared = ids.sparkSession.sparkContext.broadcast((weights, (directions * weights[:, None]).astype(np.float32)))
    width, kind = directions.shape[1], number_type(words)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, scaled = shared.value
        sums = np.zeros((len(weights), width))
        for batch in batches:
            for _, _, lengths, number in batches_of(batch, kind):
                passages = -(-lengths // PASSAGE)
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                passage = place // PASSAGE + np.repeat(np.cumsum(passages) - passages, lengths)
                known = np.flatnonzero(number < len(weights))
                if not len(known):
                    continue
                number, passage = number[known], passage[known]
                turns = np.diff(passage, prepend=-1) > 0
                projected = run_sums(scaled, number, np.flatnonzero(turns))
                order = stable_order(number, len(weights))
                owner, number = (np.cumsum(turns) - 1)[order], number[order]
                start = np.flatnonzero(np.diff(number, prepend=-1))
                sums[number[start]] += run_sums(projected, owner, start) * weights[number[start], None]
        held = np.flatnonzero(sums.any(axis=1))
        columns = [pa.array(held), *[pa.array(sums[held, k]) for k in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=["word", *[f"y{k}" for k in range(width)]])

    schema = "word long, " + ", ".join(f"y{k} double" for k in range(width))
    total = ids.mapInArrow(sketch, schema).groupBy("word").agg(*[F.sum(f"y{k}").alias(f"y{k}") for k in range(width)])
    out = np.zeros((len(words), width))
    for row in total.collect():
        out[row[0]] = row[1:]
    return out


def latent_space(sketch: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Leading right singular vectors over their singular values, from one sketch (Nystroem), as word rows."""
    core = directions.T @ sketch
    core = (core + core.T) / 2 + 1e-6 * max(np.trace(core), 1e-9) * np.eye(core.shape[0])
    left = np.linalg.solve(np.linalg.cholesky(core), sketch.T).T
    vectors, values, _ = np.linalg.svd(left, full_matrices=False)
    return vectors / np.maximum(values, 1e-3 * max(values[0], 1e-9))


def places_of(words: list) -> dict:
    """Bits of the places at which each word stands."""
    places: dict = {}
    for i, word in enumerate(words):
        places[word] = places.get(word, 0) | (1 << i)
    return places


def length_in_order(places: dict, n: int, right: list) -> int:
    """Length of the longest common subsequence of the n words in `places` and `right`, bit-parallel over the former."""
    full = (1 << n) - 1
    state = full
    for word in right:
        match = places.get(word)
        if match is not None:
            update = state & match
            state = ((state + update) | (state - update)) & full
    return n - state.bit_count()


def common_length(left: list, right: list) -> int:
    """Length of the longest common subsequence."""
    return length_in_order(places_of(left), len(left), right)


class Orders:
    """Longest common subsequences of many word lists with many regions, bit-parallel in both the words and the pairs."""

    def __init__(self, lists: list[list[int]], size: int):
        self.places = [places_of(words) for words in lists]
        self.lengths = np.array([len(words) for words in lists], np.int64)
        self.size = size
        short = [(i * size + word, bits) for i, places in enumerate(self.places) if len(lists[i]) <= LANES for word, bits in places.items()]
        short.sort()
        self.keys = np.array([key for key, _ in short] + [np.iinfo(np.int64).max], np.int64)
        self.bits = np.array([bits for _, bits in short] + [0], np.uint64)
        self.plain = None
        if len(lists) * size <= PLAIN_PLACES:
            self.plain = np.zeros(len(lists) * size, np.uint64)
            self.plain[self.keys[:-1]] = self.bits[:-1]
        # A table by hash with one key a slot; keys that share a slot with another are found in order.
        self.shift = np.uint64(64 - (SLOTS * len(self.keys)).bit_length())
        slots = self.slot(self.keys)
        self.slots = np.full(1 << int(64 - self.shift), len(self.keys) - 1)
        self.slots[slots] = np.arange(len(self.keys))
        self.shared = np.bincount(slots, minlength=len(self.slots)) > 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def places_at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are held, and their bits."""
        if self.plain is not None:
            bits = self.plain[key]
            hit = bits != 0
            return hit, bits[hit]
        slot = self.slot(key)
        at = self.slots[slot]
        crowded = np.flatnonzero(self.shared[slot])
        at[crowded] = np.searchsorted(self.keys, key[crowded])
        hit = self.keys[at] == key
        return hit, self.bits[at[hit]]

    def in_order(self, owner: np.ndarray, left: np.ndarray, right: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of list `owner` and the words from left to right, for every triple."""
        out = np.zeros(len(owner), np.int64)
        n = self.lengths[owner]
        for k in np.flatnonzero(n > LANES).tolist():
            out[k] = length_in_order(self.places[owner[k]], int(n[k]), number[left[k] : right[k]].tolist())
        lanes = np.flatnonzero(n <= LANES)
        # The longest regions first, so that those still open are the front of every array.
        lanes = lanes[np.argsort(left[lanes] - right[lanes], kind="stable")]
        base, start, span = owner[lanes] * self.size, left[lanes], right[lanes] - left[lanes]
        full = (np.uint64(1) << n[lanes].astype(np.uint64)) - np.uint64(1)
        state = full.copy()
        for offset in range(int(span.max(initial=0))):
            open_ = np.searchsorted(-span, -offset, side="left")
            word = number[start[:open_] + offset]
            some = np.flatnonzero(word < self.size)
            key = base[some] + word[some]
            hit, match = self.places_at(key)
            some = some[hit]
            now = state[some]
            update = now & match
            state[some] = ((now + update) | (now - update)) & full[some]
        out[lanes] = n[lanes] - np.bitwise_count(state)
        return out


class Index(NamedTuple):
    """What the tasks need to search: bounded by the words of one block of items."""

    items: list[Item]
    words: list[str]
    weights: np.ndarray
    latent: np.ndarray
    df: np.ndarray


def telling_words(numbers: list[int], df: np.ndarray, share: float) -> tuple[set[int], int]:
    """Words that fewest documents hold, and at how many of their places at least a text agrees that keeps `share` of all."""
    n = len(numbers)
    missing = n - int(np.ceil(share * n - 1e-9))
    kept = max(1, n // 5)
    return set(sorted(numbers, key=lambda word: (df[word], word))[: missing + kept]), kept


def window_length(n: int) -> int:
    """Power of `LENGTH_STEP` next to an item's length, at most `LONGEST`."""
    return min(LONGEST, max(1, round(LENGTH_STEP ** round(np.log(n) / np.log(LENGTH_STEP)))))


class Searcher:
    """Finds and checks candidates in batches of documents."""

    def __init__(self, index: Index):
        self.index = index
        self.size = len(index.words)
        place = {word: i for i, word in enumerate(index.words)}
        numbers = [[place[word] for word in item.words] for item in index.items]
        answers = [[place[word] for word in item.answer] for item in index.items]
        self.lengths = np.array([len(words) for words in numbers])
        self.vectors = np.zeros((self.size + 1, index.latent.shape[1]), np.float32)
        self.vectors[:-1] = index.latent * index.weights[:, None]
        self.items, self.answers = Orders(numbers, self.size), Orders(answers, self.size)
        self.directions = np.array([self.direction(words) for words in numbers])
        self.queries = self.latent_queries(numbers)
        self.probes(numbers, answers)

    def direction(self, number) -> np.ndarray:
        latent = self.vectors[number].sum(axis=0)
        return latent / (np.linalg.norm(latent) + 1e-9)

    def latent_queries(self, numbers: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By window length the directions of items, long ones in overlapping parts, and the items they belong to."""
        found: dict[int, tuple[list, list]] = {}
        for i, words in enumerate(numbers):
            rows, owners = found.setdefault(window_length(len(words)), ([], []))
            for at in range(0, max(1, len(words) - LONGEST // 2), LONGEST // 2):
                rows.append(self.direction(words[at : at + LONGEST]))
                owners.append(i)
        return {length: (np.array(rows, np.float32), np.array(owners)) for length, (rows, owners) in found.items()}

    def probes(self, numbers: list[list[int]], answers: list[list[int]]) -> None:
        """Words by which the exact path finds an item.

        Longer items have one probe for all they can be found by. In short ones
        it would name common words, so a copy has a probe and a paraphrase one
        for the answer it must hold.
        """
        told, owner = [], []
        for i, words in enumerate(numbers):
            if len(words) >= SHORT:
                parts = [telling_words(words, self.index.df, PARAPHRASE)]
            else:
                parts = [telling_words(words, self.index.df, COPY), telling_words(answers[i], self.index.df, ANSWER)]
            told += parts
            owner += [i] * len(parts)
        self.probe_item = np.array(owner, np.int64)
        self.least = np.array([kept for _, kept in told])
        self.first_probe = np.searchsorted(self.probe_item, np.arange(len(numbers)))
        self.last_probe = np.searchsorted(self.probe_item, np.arange(len(numbers)), side="right") - 1
        word = np.array([w for words, _ in told for w in words], np.int64)
        probe = np.repeat(np.arange(len(told)), [len(words) for words, _ in told])
        self.keys = np.sort(word * len(told) + probe)
        self.key_probe = self.keys % len(told)
        self.first_key = np.searchsorted(self.keys, np.arange(self.size + 2) * len(told))
        self.held = np.diff(self.first_key)

    def hits(self, number: np.ndarray, telling: np.ndarray, low_probe: int, high_probe: int) -> tuple[np.ndarray, np.ndarray]:
        """Probe and place of every telling word, for the probes from low to high."""
        word = number[telling]
        low, high = self.first_key[word], self.first_key[word + 1]
        if high_probe - low_probe < len(self.least):
            base = word * len(self.least)
            low, high = np.searchsorted(self.keys, base + low_probe), np.searchsorted(self.keys, base + high_probe)
        times = high - low
        at = np.repeat(telling, times)
        return self.key_probe[np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(at))], at

    def runs(self, lengths: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, item, first and last window of all places that hold enough telling words, some millions of hits at a time.

        A window starts at a multiple of a quarter of the item; the region around
        it has half the item's length before it and after it. Any passage of at
        most 7/4 of the item's length lies in a region; one that keeps enough of
        the item holds `least` telling words within twice the item's length.
        """
        starts, document = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
        probes = len(self.least)
        telling = np.flatnonzero(self.held[number])
        parts = min(probes, 1 + int(self.held[number].sum()) // HITS)
        cuts = np.linspace(0, probes, parts + 1).astype(np.int64)
        for low_probe, high_probe in zip(cuts[:-1], cuts[1:], strict=True):
            probe, at = self.hits(number, telling, low_probe, high_probe)
            order = stable_order(probe, probes)
            probe, at = probe[order], at[order]
            doc = document[at]
            n = self.lengths[self.probe_item[probe]]
            first = np.arange(len(at))
            last = first + self.least[probe] - 1
            first, last = first[last < len(at)], last[last < len(at)]
            near = (probe[first] == probe[last]) & (doc[first] == doc[last]) & (at[last] - at[first] < 2 * n[first])
            first, last = first[near], last[near]
            doc, probe, n = doc[first], probe[first], n[first]
            step = np.maximum(1, n // 4)
            low = np.maximum(0, at[last] - starts[doc] - 2 * n + 1 + n // 2) // step
            high = (at[first] - starts[doc] + n // 2) // step
            # Runs of one probe come in order, so a window that the run before them has is left out.
            same = np.flatnonzero((np.diff(probe) == 0) & (np.diff(doc) == 0)) + 1
            low[same] = np.maximum(low[same], high[same - 1] + 1)
            some = low <= high
            yield doc[some], self.probe_item[probe[some]], low[some], high[some]

    def telling_places(self, number: np.ndarray) -> np.ndarray:
        """Probe and place of every telling word, as sorted numbers."""
        probe, at = self.hits(number, np.flatnonzero(self.held[number]), 0, len(self.least))
        return np.sort(probe * (len(number) + 1) + at)

    def holds_enough(self, near: np.ndarray, words: int, item: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the words from left to right hold as many telling words of a probe of the item as any copy or paraphrase does."""
        able = np.zeros(len(item), bool)
        two = self.first_probe != self.last_probe
        # Item by item, since places that are looked up in ascending order are found faster.
        order = stable_order(item, len(self.lengths))
        for probes, some in ((self.first_probe, order), (self.last_probe, order[two[item[order]]])):
            probe = probes[item[some]]
            base = probe * (words + 1)
            able[some] |= np.searchsorted(near, base + right[some]) - np.searchsorted(near, base + left[some]) >= self.least[probe]
        return able

    def exact_regions(self, lengths: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, item, first word and end of all regions that can hold a paraphrase or copy.

        The words of all regions of a run are checked at once before they are told apart.
        """
        starts = np.cumsum(lengths) - lengths
        for found in self.runs(lengths, number):
            for at in range(0, len(found[0]), REGIONS):
                doc, item, low, high = (column[at : at + REGIONS] for column in found)
                n = self.lengths[item]
                step = np.maximum(1, n // 4)
                left, right = np.maximum(0, low * step - n // 2), np.minimum(lengths[doc], high * step + n + n // 2)
                able = self.items.in_order(item, starts[doc] + left, starts[doc] + right, number) >= PARAPHRASE * n - 1e-9
                doc, item, low, high, n, step = (column[able] for column in (doc, item, low, high, n, step))
                count = high - low + 1
                first = (np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())) * np.repeat(step, count)
                doc, item, n = np.repeat(doc, count), np.repeat(item, count), np.repeat(n, count)
                yield doc, item, np.maximum(0, first - n // 2), np.minimum(lengths[doc], first + n + n // 2)

    def window_sums(self, lengths: np.ndarray, number: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, first word and sum of word vectors of all windows of one length, about `most` windows at a time.

        Windows start at a quarter of their length apart, so they are sums of
        whole steps and the head of one more; every step is added up once, from
        the words of its own document only. Windows that reach beyond the end
        of a text have the words up to it.
        """
        step = max(1, length // 4)
        whole, head = divmod(length, step)
        windows = np.maximum(1, -(-(lengths - length) // step) + 1) * (lengths > 0)
        starts, total = np.cumsum(lengths) - lengths, np.cumsum(windows)
        for low in range(0, int(windows.sum()), most):
            high = min(low + most, int(total[-1]))
            docs = np.arange(np.searchsorted(total, low, side="right"), np.searchsorted(total, high - 1, side="right") + 1)
            # The windows of each document in this part, and the steps that they are made of.
            skipped = np.maximum(0, low - (total[docs] - windows[docs]))
            taken = np.minimum(high, total[docs]) - np.maximum(low, total[docs] - windows[docs])
            steps = taken + whole * (taken > 0)
            doc = np.repeat(docs, steps)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps)
            first = (nth + np.repeat(skipped, steps)) * step
            at, left = starts[doc] + first, lengths[doc] - first
            sums = np.zeros((len(doc), self.vectors.shape[1]), np.float32)
            word_sums = np.empty_like(sums)
            for offset in range(step):
                if offset == head:
                    latent = sums[whole:].copy()
                # The last vector, of a word that no item has, is zero.
                word = np.where(offset < left, number.take(at + offset, mode="clip"), self.size)
                sums += self.vectors.take(word, axis=0, out=word_sums, mode="clip")
            for k in range(whole):
                latent += sums[k : len(sums) - whole + k]
            kept = np.flatnonzero(nth[: len(latent)] < np.repeat(taken, steps)[: len(latent)])
            yield doc[kept], first[kept], latent[kept]

    def latent_regions(self, lengths: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, item, first word and end around all windows whose cosine with an item reaches `COSINE`."""
        starts = np.cumsum(lengths) - lengths
        near = self.telling_places(number)
        held: list[tuple[np.ndarray, ...]] = []
        for length, (queries, owners) in self.queries.items():
            for d, f, latent in self.window_sums(lengths, number, length, min(WINDOWS, max(256, COSINES // len(owners)))):
                latent /= np.sqrt(np.einsum("ij,ij->i", latent, latent))[:, None] + np.float32(1e-9)
                row, query = np.divmod(np.flatnonzero(latent @ queries.T >= COSINE), len(owners))
                d, f, item = d[row], f[row], owners[query]
                n = self.lengths[item]
                left, right = np.maximum(0, f - n // 2), np.minimum(lengths[d], f + np.maximum(length, n) + n // 2)
                able = self.holds_enough(near, len(number), item, starts[d] + left, starts[d] + right)
                held.append((d[able], item[able], left[able], right[able]))
                if sum(len(part[0]) for part in held) >= REGIONS:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def leaks(self, lengths: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, int, int, float, float, bool, bool]]:
        """Document, item, first word, end, cosine, share of the item in order, whether its answer occurs and whether the cosine found it."""
        if not len(number):
            return
        starts = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], tuple] = {}
        latent = set()
        for way in (self.latent_regions, self.exact_regions):
            for regions in way(lengths, number):
                for at in range(0, len(regions[0]), REGIONS):
                    doc, item, left, right = (column[at : at + REGIONS] for column in regions)
                    share = self.items.in_order(item, starts[doc] + left, starts[doc] + right, number) / self.lengths[item]
                    doc, item, left, right, share = (column[share >= PARAPHRASE] for column in (doc, item, left, right, share))
                    answer = self.answers.in_order(item, starts[doc] + left, starts[doc] + right, number) >= ANSWER * self.answers.lengths[item]
                    taken = np.flatnonzero((share >= COPY) | answer)
                    for d, i, l, r, in_order, full in zip(*(c[taken].tolist() for c in (doc, item, left, right, share, answer)), strict=True):
                        if way == self.latent_regions:
                            latent.add((d, i))
                        if (in_order, -l) > best.get((d, i), (-1.0, 0))[:2]:
                            best[d, i] = (in_order, -l, r, full)
        for (d, i), (in_order, left, right, answer) in sorted(best.items()):
            yield d, i, -left, right, self.cosine(number[starts[d] - left : starts[d] + right], i), in_order, answer, (d, i) in latent

    def cosine(self, region: np.ndarray, i: int) -> float:
        """Best cosine of an item and the windows of its length in a region."""
        n = int(self.lengths[i])
        return max(float(self.direction(region[at : at + n]) @ self.directions[i]) for at in range(0, max(1, len(region) - n + 1), max(1, n // 4)))


def item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Items in blocks of about `BLOCK_WORDS` words; the driver holds one block at a time. Items without words are left out."""
    items = pick(benchmark, "item_id", "text").filter("text is not null")
    weight = items.agg(F.sum(F.size(F.split("text", r"\s+"))), F.count(F.lit(1))).first()
    blocks = max(1, -(-int(weight[0] or 0) // BLOCK_WORDS))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        made = [item for item in (item_of(row[0], row[1]) for row in rows) if item.words]
        if made:
            yield made


def build_index(ids: DataFrame, items: list[Item], words: list[str], rank: int = RANK, seed: int = 29) -> Index:
    """Weights and latent space of a block of items from all documents.

    A word that no document has weighs most, one that most documents have `LEAST_WEIGHT`.
    """
    df, rows = document_frequencies(ids, words)
    weights = np.maximum(np.log((rows + 1) / (df + 1)), LEAST_WEIGHT)
    directions = np.random.default_rng(seed).normal(size=(len(words), min(rank, len(words))))
    sketch = passage_sketch(ids, words, weights, directions)
    return Index(items, words, weights, latent_space(sketch, directions), df)


LEAKS = "doc_id long, row long, item_id long, first_word long, end_word long, cosine double, in_order double, answer boolean, latent boolean"


def leaked_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it.

    doc_id, a hash `row` of id and text, item_id, the words searched (first_word to end_word), the latent cosine, the
    share of the item's words that occur in order, whether its answer occurs, and whether the cosine search found it.
    A copy has at least `COPY` of the item in order; a paraphrase at least
    `PARAPHRASE` and the answer, both within 7/4 of the item's length. Null texts and empty ones hold nothing, items
    without words are never found; null ids and repeated rows are reported like
    others; empty tables give no rows; further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), text).alias("row"), text.alias("text")
    )
    found = None
    for items in item_blocks(benchmark):
        words = sorted({word for item in items for word in item.words})
        ids = numbered(narrow, words)
        part = search(ids, build_index(ids, items, words))
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], LEAKS) if found is None else found


def search(ids: DataFrame, index: Index) -> DataFrame:
    shared = ids.sparkSession.sparkContext.broadcast(index)
    kind = number_type(index.words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        names = ["doc_id", "row", "item_id", "first_word", "end_word", "cosine", "in_order", "answer", "latent"]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
        for batch in batches:
            rows = []
            for doc_ids, keys, lengths, number in batches_of(batch, kind):
                for d, i, *found in searcher.leaks(lengths, number):
                    rows.append((doc_ids[d], keys[d], searcher.index.items[i].item_id, *found))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return ids.mapInArrow(run, LEAKS)


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaked_items(docs, benchmark).drop("row")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found."""
    leaks = written(leaked_items(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("row").alias("_key")).distinct())
    return rows_of(docs, leaks, "left_anti")
