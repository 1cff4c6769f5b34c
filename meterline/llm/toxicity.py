"""Toxicity of whole texts: a bidirectional GRU with attention pooling over overlapping windows, trained in numpy.

A word enters as the sum of a hashed word vector and the scaled sum of its
hashed character trigrams. The network reads windows of `WINDOW` words every
`STRIDE` words; a document scores as its worst window, put through a logistic
curve fitted on the training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import pick

WINDOW = 64
STRIDE = 48
HIDDEN = 8
SIZE = 16
WORD_ROWS = 1 << 14
CHAR_ROWS = 1 << 13
TRAIN_DOCS = 3_000
TOXIC_WINDOWS = 24
CLEAN_WINDOWS = 6
CACHE_WORDS = 200_000
SCORE_BATCH = 2_048
STRIP = ".,;:!?\"'()[]"


class Model(NamedTuple):
    words: np.ndarray  # WORD_ROWS x SIZE
    chars: np.ndarray  # CHAR_ROWS x SIZE
    inputs: np.ndarray  # 2 x SIZE x 3 HIDDEN
    input_bias: np.ndarray  # 2 x 3 HIDDEN
    recurrent: np.ndarray  # 2 x HIDDEN x 3 HIDDEN
    attention: np.ndarray  # 2 HIDDEN
    output: np.ndarray  # 2 HIDDEN
    bias: np.ndarray  # 1
    curve: np.ndarray  # slope and shift of the final logistic


class Vocabulary:
    """Table rows of distinct words, flat: one for the lower-cased word, one for each of its byte trigrams with end marks."""

    def __init__(self, words: Iterable[str]):
        plain = [word.lower().strip(STRIP).encode() or b"_" for word in words]
        self.word = np.fromiter(map(zlib.crc32, plain), np.int64, len(plain)) & (WORD_ROWS - 1)
        self.counts = np.fromiter(map(len, plain), np.int64, len(plain))
        self.starts = np.cumsum(self.counts) - self.counts
        marked = np.frombuffer(b"".join([b"<" + word + b">" for word in plain]), np.uint8).astype(np.int64)
        if len(marked):
            first = np.repeat(2 * np.arange(len(plain)), self.counts) + np.arange(self.counts.sum())
            mixed = (marked[first] | marked[first + 1] << 8 | marked[first + 2] << 16) * 0x9E3779B1
            self.grams = (mixed >> 15) & (CHAR_ROWS - 1)
        else:
            self.grams = np.zeros(0, np.int64)

    def of(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, trigram rows, starts and scale of some types."""
        counts = self.counts[types]
        starts = np.cumsum(counts) - counts
        flat = np.repeat(self.starts[types] - starts, counts) + np.arange(counts.sum())
        return self.word[types], self.grams[flat], starts, 1 / np.sqrt(counts)


def embed(model: Model, rows) -> np.ndarray:
    word, grams, starts, scale = rows
    return model.words[word] + np.add.reduceat(model.chars[grams], starts, axis=0) * scale[:, None]


def projected(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Input parts of all gates, types x 2 x 3 HIDDEN; the row added last leaves the state as it is (padding)."""
    gates = np.einsum("td,ndk->tnk", vectors, model.inputs) + model.input_bias
    still = np.zeros((1, 2, 3 * HIDDEN), np.float32)
    still[:, :, :HIDDEN] = 30
    return np.concatenate([gates, still]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(model: Model, gates: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States, time x windows x 2 HIDDEN; `gates` is time x windows x 2 x 3 HIDDEN, the second direction read backwards."""
    steps, n = gates.shape[:2]
    state = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((steps, n, 2 * HIDDEN), np.float32)
    for t in range(steps):
        x = np.stack([gates[t, :, 0], gates[steps - 1 - t, :, 1]])
        own = state @ model.recurrent
        zr = sigmoid(x[:, :, : 2 * HIDDEN] + own[:, :, : 2 * HIDDEN])
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        new = np.tanh(x[:, :, 2 * HIDDEN :] + r * own[:, :, 2 * HIDDEN :])
        if kept is not None:
            kept.append((state, z, r, new, own[:, :, 2 * HIDDEN :]))
        state = new + z * (state - new)
        states[t, :, :HIDDEN] = state[0]
        states[steps - 1 - t, :, HIDDEN:] = state[1]
    return states


def pool(model: Model, states: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the windows, attention weights and pooled states; `filled` marks real words, time x windows."""
    scores = np.where(filled, states @ model.attention, -1e9)
    weights = np.exp(scores - scores.max(axis=0))
    weights /= weights.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weights, states)
    return pooled @ model.output + model.bias[0], weights, pooled


def window_starts(n: int) -> range:
    """First words of the windows that cover n words, each overlapping the one before."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


def new_model(rng: np.random.Generator) -> Model:
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Model(
        normal(WORD_ROWS, SIZE, scale=0.05),
        normal(CHAR_ROWS, SIZE, scale=0.1),
        normal(2, SIZE, 3 * HIDDEN, scale=SIZE**-0.5),
        np.zeros((2, 3 * HIDDEN), np.float32),
        normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        normal(2 * HIDDEN, scale=0.3),
        normal(2 * HIDDEN, scale=0.3),
        np.zeros(1, np.float32),
        np.array([1.0, 0.0], np.float32),
    )


def gradients(model: Model, vocabulary: Vocabulary, batch: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[list, np.ndarray]:
    """Gradient of the weighted log loss of a batch (windows x time, -1 for padding) and the logits."""
    types, index = np.unique(batch, return_inverse=True)
    index = index.reshape(batch.shape).T
    padded = int(types[0] == -1)
    rows = vocabulary.of(types[padded:])
    vectors = embed(model, rows)
    table = projected(model, vectors)
    index = np.where(index < padded, len(table) - 1, index - padded)
    filled = index < len(table) - 1
    kept: list = []
    states = run_gru(model, table[index], kept)
    logits, weights, pooled = pool(model, states, filled)
    d_logit = (sigmoid(logits) - target) * weight / len(target)
    d_pooled = d_logit[:, None] * model.output
    spread = np.einsum("tnh,nh->tn", states, d_pooled)
    d_score = weights * (spread - (weights * spread).sum(axis=0))
    d_states = weights[:, :, None] * d_pooled + d_score[:, :, None] * model.attention
    steps, n = index.shape
    d_gates = np.zeros((steps, n, 2, 3 * HIDDEN), np.float32)
    d_recurrent = np.zeros_like(model.recurrent)
    back = np.transpose(model.recurrent, (0, 2, 1))
    d_state = np.zeros((2, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, new, own = kept[t]
        d_state = d_state + np.stack([d_states[t, :, :HIDDEN], d_states[steps - 1 - t, :, HIDDEN:]])
        d_new = d_state * (1 - z) * (1 - new * new)
        d_z = d_state * (before - new) * z * (1 - z)
        d_r = d_new * own * r * (1 - r)
        through = np.concatenate([d_z, d_r, d_new * r], axis=2)
        d_recurrent += np.transpose(before, (0, 2, 1)) @ through
        d_state = d_state * z + through @ back
        d_x = np.concatenate([d_z, d_r, d_new], axis=2)
        d_gates[t, :, 0] = d_x[0]
        d_gates[steps - 1 - t, :, 1] = d_x[1]
    d_table = np.zeros((len(table), 6 * HIDDEN), np.float32)
    order = np.argsort(index, axis=None, kind="stable")
    found, first = np.unique(index.ravel()[order], return_index=True)
    d_table[found] = np.add.reduceat(d_gates.reshape(-1, 6 * HIDDEN)[order], first, axis=0)
    d_table = d_table[:-1].reshape(-1, 2, 3 * HIDDEN)
    d_vectors = np.einsum("tnk,ndk->td", d_table, model.inputs)
    word, grams, _, scale = rows
    d_words, d_chars = np.zeros_like(model.words), np.zeros_like(model.chars)
    np.add.at(d_words, word, d_vectors)
    np.add.at(d_chars, grams, np.repeat(d_vectors * scale[:, None], vocabulary.counts[types[padded:]], axis=0))
    grads = [
        d_words,
        d_chars,
        np.einsum("td,tnk->ndk", vectors, d_table),
        d_table.sum(axis=0),
        d_recurrent,
        np.einsum("tn,tnh->h", d_score, states),
        d_logit @ pooled,
        np.array([d_logit.sum()]),
    ]
    return grads, logits


def train(texts: list[list[list[str]]], toxic: np.ndarray, epochs: int = 5, batch: int = 256, seed: int = 3) -> Model:
    """Fit on documents given as windows of words with one label each.

    The first two epochs give every window the label of its document; in the
    later ones a toxic document counts only the windows that score highest in
    it, since most windows of a toxic text are clean. Classes weigh the same.
    """
    rng = np.random.default_rng(seed)
    model = new_model(rng)
    if not len(toxic) or toxic.min() == toxic.max():
        return model._replace(output=np.zeros_like(model.output), curve=np.array([0.0, -3.0 if not toxic.any() else 3.0]))
    names = sorted({word for windows in texts for window in windows for word in window})
    at = {word: i for i, word in enumerate(names)}
    vocabulary = Vocabulary(names)
    owner = np.concatenate([np.full(len(windows), i) for i, windows in enumerate(texts)])
    grid = np.full((len(owner), WINDOW), -1, np.int64)
    for k, window in enumerate(w for windows in texts for w in windows):
        grid[k, : len(window)] = [at[word] for word in window]
    label = toxic[owner].astype(np.float32)
    weight = np.ones(len(owner), np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model[:-1]]
    step = 0
    logits = np.zeros(len(owner), np.float32)
    for epoch in range(epochs):
        if epoch >= 2:
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, owner, logits)
            weight = np.where((label == 0) | (logits >= np.minimum(best[owner], 1.0)), 1, 0).astype(np.float32)
        balance = np.where(label == 1, weight[label == 0].sum() / max(1, weight[label == 1].sum()), 1).astype(np.float32)
        used = rng.permutation(np.flatnonzero(weight))
        rate = 0.01 * (1 - epoch / (epochs + 1))
        for first in range(0, len(used), batch):
            some = used[first : first + batch]
            grads, found = gradients(model, vocabulary, grid[some], label[some], (weight * np.minimum(balance, 5))[some])
            logits[some] = found
            step += 1
            for k, (grad, (mean, square)) in enumerate(zip(grads, moments, strict=True)):
                mean *= 0.9
                mean += 0.1 * grad
                square *= 0.99
                square += 0.01 * grad * grad
                change = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
                np.subtract(model[k], change, out=model[k])
    for first in range(0, len(grid), SCORE_BATCH):
        part = grid[first : first + SCORE_BATCH]
        types, index = np.unique(part, return_inverse=True)
        padded = int(types[0] == -1)
        table = projected(model, embed(model, vocabulary.of(types[padded:])))
        index = index.reshape(part.shape).T
        index = np.where(index < padded, len(table) - 1, index - padded)
        logits[first : first + SCORE_BATCH] = pool(model, run_gru(model, table[index]), index < len(table) - 1)[0]
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, owner, logits)
    return model._replace(curve=logistic_curve(worst, toxic))


def logistic_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slope and shift of the logistic regression of y on x, by Newton steps."""
    design = np.stack([x, np.ones_like(x)], axis=1).astype(np.float64)
    beta = np.array([0.5, 0.0])
    for _ in range(50):
        p = sigmoid(design @ beta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (p - y) + ridge * beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Scorer:
    """Scores whole texts; keeps the projected inputs of the words seen, up to `CACHE_WORDS`."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = projected(self.model, np.zeros((0, SIZE), np.float32))
        self.used = 1

    def learn(self, words: list[str]) -> None:
        gates = projected(self.model, embed(self.model, (v := Vocabulary(words)).of(np.arange(len(v.counts)))))[:-1]
        first = self.used
        self.used += len(words)
        if self.used > len(self.table):
            grown = np.empty((2 * self.used, 2, 3 * HIDDEN), np.float32)
            grown[:first] = self.table[:first]
            self.table = grown
        self.table[first : self.used] = gates
        self.rows.update(zip(words, range(first, self.used), strict=True))

    def logits(self, texts: list[str]) -> np.ndarray:
        """Highest window logit of each text; a text without words takes the bias alone."""
        split = [text.split() for text in texts]
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        new = {word for words in split for word in words if word not in self.rows}
        if new:
            self.learn(list(new))
        worst = np.full(len(texts), -np.inf, np.float32)
        get = self.rows.__getitem__
        grids, owners = [], []
        for i, words in enumerate(split):
            if not words:
                worst[i] = self.model.bias[0]
                continue
            ids = np.fromiter(map(get, words), np.int64, len(words))
            starts = window_starts(len(ids))
            ids = np.concatenate([ids, np.zeros(starts[-1] + WINDOW - len(ids), np.int64)]) if starts[-1] + WINDOW > len(ids) else ids
            grids.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[:: STRIDE][: len(starts)])
            owners.append(np.full(len(starts), i))
        if grids:
            grid, owner = np.concatenate(grids), np.concatenate(owners)
            for first in range(0, len(grid), SCORE_BATCH):
                index = np.ascontiguousarray(grid[first : first + SCORE_BATCH].T)
                found = pool(self.model, run_gru(self.model, self.table[index]), index > 0)[0]
                np.maximum.at(worst, owner[first : first + SCORE_BATCH], found)
        return worst


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; an absent id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def training_windows(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, toxic and windows of about `per_class` labelled documents of each class outside the held-out quarter.

    Those with the smallest hashes of their id; at most `TOXIC_WINDOWS` or
    `CLEAN_WINDOWS` windows of each, evenly spaced.
    """
    known = pick(labels, "doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").filter(remainder(F.col("doc_id")) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {row[0]: row[1] for row in known.groupBy("toxic").count().collect()}
    share = F.create_map(*[F.lit(x) for pair in ((k, min(1.0, per_class / sizes.get(k, 1))) for k in (0, 1)) for x in pair])
    drawn = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 32) < F.element_at(share, F.col("toxic")) * 2.0**32)
    narrow = pick(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                words = text.split()
                starts = list(window_starts(len(words)))
                most = TOXIC_WINDOWS if label else CLEAN_WINDOWS
                chosen = starts if len(starts) <= most else [starts[k * len(starts) // most] for k in range(most)]
                if chosen:
                    rows.append((doc_id, label, [" ".join(words[s : s + WINDOW]) for s in chosen]))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "toxic", "windows"]
            )

    return narrow.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(
        cut, "doc_id long, toxic int, windows array<string>"
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> Model:
    """Train on the driver; what it collects is bounded by `per_class` and the windows of a document."""
    drawn = training_windows(docs, labels, per_class).collect()
    drawn.sort(key=lambda row: (row["doc_id"], row["windows"]))
    texts = [[window.split() for window in row["windows"]] for row in drawn]
    return train(texts, np.array([row["toxic"] for row in drawn], np.float64))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and held_out of every row; null and empty texts score, too, from the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        slope, shift = scorer.model.curve
        for batch in batches:
            for part in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
                worst = scorer.logits(part.column("text").to_pylist()).astype(np.float64)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(sigmoid(slope * worst + shift))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

    narrow = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (remainder(F.col("doc_id")) == 2).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return narrow.mapInArrow(score, "doc_id long, held_out boolean, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from a model trained on the labels.

    Null ids are kept (and never held out by a label), repeated rows score
    alike, empty tables give no rows; without labels of both classes the score is
    a constant. Further columns are ignored.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
