"""SimHash near-duplicates found through vantage-point trees over Hamming distance.

A tree over a bounded sample cuts the space of fingerprints into shards: a
vantage point and a radius send a fingerprint inside or outside, and one inside
that the triangle bound cannot keep away from the outside goes to both. Every
pair within the link distance so meets in a shard, where a tree of its own
prunes the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.components import connected
from meterline.llm.frames import pick, row_key, rows_of
from meterline.session import cut_lineage

SEED = 42
LINK_BITS = 2
SAMPLE = 20_000
SHARD_ROWS = 4_000
BLOCK = 256
STAR_KEYS = 4_000_000
SHINGLE_BLOCK = 65_536
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats counted; zero without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    if len(words) < size:
        first, last = np.array([0]), np.array([len(joined)])
    else:
        first, last = starts[: len(words) - size + 1], (starts + lengths)[size - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), SHINGLE_BLOCK):
        cuts = zip(first[at : at + SHINGLE_BLOCK].tolist(), last[at : at + SHINGLE_BLOCK].tolist(), strict=True)
        hashes = map(xxhash.xxh64_intdigest, [joined[s:e] for s, e in cuts], repeat(SEED))
        octets = np.fromiter(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ BITS
    set_bits = (2 * ones > len(first)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash `row` of id and text, and the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.fromiter((fingerprint(text) for text in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found)], names=["doc_id", "row", "fp"])

    narrow = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    narrow = narrow.withColumn("row", row_key(F.col("doc_id"), F.col("text"))).select("doc_id", "row", "text")
    return narrow.mapInArrow(run, "doc_id long, row long, fp long")


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_split(points: np.ndarray, rng: np.random.Generator, reach: int, tries: int = 6) -> tuple[np.uint64, int, float]:
    """Vantage point and radius with the fewest copies for how evenly they split, and that share of copies."""
    best = (points[0], -1, 1.0)
    worth = np.inf
    look = points if len(points) <= 2_000 else rng.choice(points, 2_000, replace=False)
    for vantage in rng.choice(points, tries):
        held = np.bincount(distance(look, vantage), minlength=65) / len(look)
        inside = np.cumsum(held)
        for radius in range(64):
            share = inside[radius]
            if 0.05 < share < 0.95:
                copies = held[max(0, radius - reach + 1) : radius + 1].sum()
                cost = (copies + 0.02) / min(share, 1 - share)
                if cost < worth:
                    worth, best = cost, (vantage, radius, float(copies))
    return best


class Node(NamedTuple):
    vantage: np.uint64
    radius: int
    inside: Node | int
    outside: Node | int


def vantage_tree(sample: np.ndarray, rows_each: float, reach: int = LINK_BITS, shard_rows: int = SHARD_ROWS, seed: int = 5):
    """Tree whose leaves are shard numbers; a split that would copy over 60 % of the rows is not made."""
    rng = np.random.default_rng(seed)
    shards = iter(range(1 << 40))

    def build(points: np.ndarray) -> Node | int:
        if len(points) * rows_each <= shard_rows or len(points) < 8:
            return next(shards)
        vantage, radius, copies = best_split(points, rng, reach)
        if radius < 0 or copies > 0.6:
            return next(shards)
        far = distance(points, vantage) > radius
        return Node(vantage, radius, build(points[~far]), build(points[far]))

    return build(sample)


def route(tree, points: np.ndarray, reach: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Shard and index of the points, several times for those that the triangle bound leaves on both sides."""
    shards, owners = [], []
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, Node):
            shards.append(np.full(len(at), node, np.int64))
            owners.append(at)
            continue
        far = distance(points[at], node.vantage).astype(np.int64)
        todo.append((node.inside, at[far <= node.radius]))
        todo.append((node.outside, at[far > node.radius - reach]))
    if not shards:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(shards), np.concatenate(owners)


def star_links(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all points within two bits of each other, in space and time linear in the points.

    Two points differ in at most two bits exactly when their sets of the point
    itself and its 64 one-bit neighbours share a member; owners of one member
    are chained. Members are taken in passes of bounded size. For dense groups,
    where no vantage point separates.
    """
    passes = 1
    while len(points) * 65 / passes > STAR_KEYS:
        passes *= 2
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for number in range(passes):
        members, owners = [], []
        for flip in flips:
            key = points ^ flip
            mixed = key ^ (key >> np.uint64(32))
            mine = np.flatnonzero(((mixed ^ (mixed >> np.uint64(16))) & np.uint64(passes - 1)) == number)
            members.append(key[mine])
            owners.append(mine)
        key, owner = np.concatenate(members), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        yield owner[same], owner[same + 1]


def close_links(points: np.ndarray, reach: int = LINK_BITS, seed: int = 9) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect all distinct points within `reach` bits, by a vantage-point tree down to small blocks."""
    rng = np.random.default_rng(seed)
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            near = np.bitwise_count(points[at][:, None] ^ points[at][None, :]) <= reach
            i, j = np.nonzero(np.triu(near, 1))
            yield at[i], at[j]
            continue
        vantage, radius, copies = best_split(points[at], rng, reach)
        if radius < 0 or copies > 0.6:
            if reach == LINK_BITS:
                for i, j in star_links(points[at]):
                    yield at[i], at[j]
            else:
                for k in range(0, len(at), BLOCK):
                    i, j = np.nonzero(np.bitwise_count(points[at][k : k + BLOCK, None] ^ points[at][None, :]) <= reach)
                    yield at[i + k], at[j]
            continue
        far = distance(points[at], vantage).astype(np.int64)
        todo += [at[far <= radius], at[far > radius - reach]]


def roots_of(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n indices."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = root[root]
                if (further == root).all():
                    break
                root = further
    return root


def near_links(points: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within `LINK_BITS` bits.

    A shard returns each linked fingerprint with the smallest one it reaches
    there, so the links grow with the fingerprints, not with the pairs.
    """
    total = points.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = points.filter(F.shiftrightunsigned(F.xxhash64("fp"), 32) < int(share * 2**32)).toPandas()
    sample = drawn["fp"].to_numpy(np.int64).view(np.uint64)
    tree = vantage_tree(np.sort(sample), total / max(1, len(sample)))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy()
            shard, at = route(tree, own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[at])], names=["shard", "fp"])

    def link(group: pa.Table) -> pa.Table:
        own = np.unique(group.column("fp").to_numpy())
        root = roots_of(len(own), close_links(own.view(np.uint64)))
        linked = np.flatnonzero(root != np.arange(len(own)))
        return pa.table({"a": own[linked], "b": own[root[linked]]})

    return points.mapInArrow(spread, "shard long, fp long").groupBy("shard").applyInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, row, fp, root and component_id of every document.

    Fingerprints link at two or fewer differing bits; `root` names the component
    by a fingerprint, component_id is the smallest doc_id in it. A null text
    counts as empty; texts without a word share fingerprint zero and are linked
    like any other. Null ids do not count for the smallest (a component of null
    ids only has a null one), repeated rows get equal results, an empty table
    gives none. Further columns are ignored.
    """
    hashed = cut_lineage(fingerprints(docs))
    points = cut_lineage(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = cut_lineage(connected(near_links(points.select("fp"))))
    placed = points.join(roots, points.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    return hashed.join(named, "fp").select("doc_id", "row", "fp", "root", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in 16 hex digits and component_id of every document."""
    found = simhash_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The row of each component with the smallest id (null last), and of equal rows one; columns as in `docs`."""
    found = simhash_components(docs)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_id"), F.col("k.row").alias("_key")).distinct()
    return rows_of(docs, kept, "left_semi", once=True)
