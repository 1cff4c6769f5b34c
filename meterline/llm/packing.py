"""Best-fit decreasing packing of documents into token windows.

Pieces of equal length are interchangeable for the packing, so it is computed
from the counts of the lengths 1 to capacity: whole runs of windows with the
same room are filled at once, and a segment tree indexed by remaining capacity
finds the tightest open ones. The result is a list of steps that tells every
piece its window by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import parts, pick, ranked
from meterline.llm.tokens import encoder
from meterline.session import cut_lineage

CAPACITY = 4_096


class Step(NamedTuple):
    """Pieces of `length` with ranks from `rank` on: `per_window` into each window from `window` on, from `offset` on."""

    length: int
    rank: int
    count: int
    window: int
    per_window: int
    offset: int


class RoomTree:
    """Segment tree over remaining capacities; knows the smallest open one at or above a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.any = np.zeros(2 * self.leaves, bool)

    def set(self, room: int, value: bool) -> None:
        node = room + self.leaves
        self.any[node] = value
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        node = length + self.leaves
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Steps that pack `counts[n]` pieces of each length n, and the number of windows.

    A piece goes to the open window with the least room that holds it, else to
    a new one; equal pieces keep filling the window they opened while they fit,
    which is what best fit does with them.
    """
    tree = RoomTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}

    def open_run(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.set(room, True)

    steps: list[Step] = []
    windows = 0
    for length in range(capacity, 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, windows
                n = -(-left // (capacity // length))
                windows += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            fit = room // length
            full = min(n, left // fit)
            if full:
                steps.append(Step(length, rank, full * fit, first, fit, capacity - room))
                open_run(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
                first, n = first + full, n - full
            if n and left and left < fit:
                steps.append(Step(length, rank, left, first, left, capacity - room))
                open_run(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            if n:
                open_run(room, first, n)
    return steps, windows


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Full windows and the rest of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, False)
        end = np.array([end_id], np.uint32)
        for batch in parts(batches):
            rows = []
            ids = coder.encode(batch.column("text").to_pylist())
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                run = np.concatenate([np.frombuffer(packed, coder.dtype).astype("<u4"), end])
                for start in range(0, len(run), capacity):
                    piece = run[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(run)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    narrow = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return narrow.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY
) -> DataFrame:
    """Pack every document, cut into full windows and a rest, into sequences of at most `capacity` tokens.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    and offset. A null text counts as empty: its end id alone is one piece. Null
    and repeated ids keep all their pieces, an empty table gives none. The
    driver sees one count per length; the steps it broadcasts are bounded by
    the capacity, not by the documents.
    """
    pieces = cut_lineage(pieces_of(docs, tokenizer, end_id, capacity).withColumn("_hash", F.xxhash64("doc_id", "start", "ids_crc32")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row[0]] = row[1]
    steps, _ = best_fit_decreasing(counts, capacity)
    order = [F.shiftrightunsigned("_hash", 32), F.col("_hash"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    in_order = ranked(pieces, "length", "_hash", order, int(counts.sum()), "rank")
    table = np.array(steps, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        starts = (steps[:, 0] << 48) + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            step = steps[np.searchsorted(starts, (length << 48) + rank, side="right") - 1]
            nth = rank - step[:, 1]
            window, offset = step[:, 3] + nth // step[:, 4], step[:, 5] + nth % step[:, 4] * length
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(window), pa.array(offset)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return in_order.drop("_hash").mapInArrow(place, schema)
