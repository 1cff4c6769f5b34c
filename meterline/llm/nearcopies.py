"""Near copies of whole documents: SimHash groups, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8.

Texts that similar differ in about ten of 64 SimHash bits, and distances to any
vantage point spread less than that, so triangle bounds prune nothing at such a
radius. The vantage-point trees therefore find what lies within two bits. For
the rest every set is listed under its rarest shingles, so many that two similar
sets must share one of these, and sets under one shingle are compared unless
they are in one group already or a lower bound on their difference rules it out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.components import connected
from meterline.llm.frames import pick, row_key, rows_of, spared, written
from meterline.llm.simhash import BITS, SEED, near_links

SHINGLE = 5
#: Jaccard similarity as a fraction.
SIMILAR = (4, 5)
#: Bands of minima, no longer used by the search: two texts of similarity 0.8 agree in all six of one of 21 with probability 0.998 only.
BANDS, MINIMA = 21, 6
BLOCK = 2_048
_drawn = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * MINIMA), dtype=np.uint64)
FACTORS, SHIFTS = _drawn[0] * np.uint64(2) + np.uint64(1), _drawn[1]
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Documents drawn and shingles kept for the order of shingles; any order gives the same links, this one short lists.
ORDER_ROWS, ORDER_SHINGLES = 10_000, 200_000
#: Sets under one shingle that each of them is compared with first.
HEADS = 3
#: Sets of a list that meet in one task, and words of parity bits held at once.
TILE, HELD = 4_096, 2_000_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a UTF-8 text in lower case, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    cuts = zip(starts[: len(words) - size + 1].tolist(), (starts + lengths)[size - 1 :].tolist(), strict=True)
    return np.fromiter(map(xxhash.xxh64_intdigest, (joined[s:e] for s, e in cuts), repeat(SEED)), np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """SimHash as a signed long: the bits set in over half of the hashes."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def rarest(distinct: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many of the rarest shingles of a set that two sets of similarity `SIMILAR` share one of them."""
    n, (part, whole) = len(distinct), SIMILAR
    wanted = n - -(-part * n // whole) + 1
    at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
    weight = np.where(known[at] == distinct, counts[at], 0) if len(known) else np.zeros(n, np.int64)
    found = distinct[weight == 0][:wanted]
    return found if len(found) == wanted else distinct[np.lexsort((distinct, weight))[:wanted]]


def parities(distinct: np.ndarray) -> bytes:
    """Parities of the shingles in twice to four times as many buckets, a power of two."""
    size = 1 << max(8, (2 * len(distinct)).bit_length())
    return np.packbits((np.bincount((distinct & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """One key per band from the smallest hashed shingles."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), BLOCK):
        least = np.minimum(least, (distinct[at : at + BLOCK, None] * FACTORS + SHIFTS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in least.reshape(BANDS, MINIMA).T:
        key = (key ^ column) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_name(distinct: np.ndarray) -> int:
    """64-bit name of a set of shingles."""
    return int(np.array(xxhash.xxh64_intdigest(distinct.tobytes(), SEED), np.uint64).view(np.int64))


def id_and_text(docs: DataFrame) -> DataFrame:
    narrow = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.withColumn("row", row_key(F.col("doc_id"), F.col("text")))


def sketches(narrow: DataFrame) -> DataFrame:
    """doc_id, row, SimHash fp, the name `node` of the set of shingles, its size and its parities."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spared(batches):
            fps, nodes, sizes, bits = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = shingle_hashes(text.as_py())
                distinct = np.unique(hashes)
                fps.append(majority_bits(hashes))
                nodes.append(set_name(distinct))
                sizes.append(len(distinct))
                bits.append(parities(distinct))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(fps, pa.int64()), pa.array(nodes, pa.int64())]
            columns += [pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fp", "node", "n", "bits"])

    return narrow.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, fp long, node long, n long, bits binary")


def shingle_order(narrow: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come often in about `ORDER_ROWS` documents, sorted, and in how many of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spared(batches):
            for text in batch.column("text").cast(pa.binary()):
                distinct = np.unique(shingle_hashes(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64))], names=["token"])

    share = min(1.0, ORDER_ROWS / max(1, rows))
    drawn = narrow.filter(F.shiftrightunsigned(F.xxhash64(F.lit(7), "row"), 32) < int(share * 2**32)).select("text")
    counted = drawn.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    often = written(counted.orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES)).toPandas()
    known, counts = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], counts[order]


def listed(narrow: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Every set under each of its rarest shingles: token, node, n. Rows may repeat."""
    shared = narrow.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spared(batches):
            seen = set()
            for text in batch.column("text").cast(pa.binary()):
                distinct = np.unique(shingle_hashes(text.as_py()))
                node = set_name(distinct)
                if node in seen or not len(distinct):
                    continue
                seen.add(node)
                tokens = rarest(distinct, *shared.value).view(np.int64)
                columns = [pa.array(tokens), pa.array(np.full(len(tokens), node)), pa.array(np.full(len(tokens), len(distinct)))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "n"])

    return narrow.select("text").mapInArrow(run, "token long, node long, n long")


def shingle_sets(narrow: DataFrame) -> DataFrame:
    """node and its distinct shingles, once each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spared(batches):
            for text in batch.column("text").cast(pa.binary()):
                distinct = np.unique(shingle_hashes(text.as_py()))
                shingles = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(distinct.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_name(distinct)], pa.int64()), shingles], names=["node", "shingles"])

    return narrow.select("text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def similar_pairs(pairs: DataFrame, nodes: DataFrame, narrow: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; `nodes` names a row of `narrow` for each set."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = written(nodes.join(wanted, "node", "left_semi").select("row").distinct())
    sets = written(shingle_sets(narrow.join(rows, "row", "left_semi")))
    own = pairs.join(sets.select(F.col("node").alias("a"), "shingles"), "a")
    both = own.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("others")), "b")
    shared = F.size(F.array_intersect("shingles", "others"))
    part, whole = SIMILAR
    return written(both.filter(shared * (part + whole) >= (F.size("shingles") + F.size("others")) * part).select("a", "b"))


def folded(bits: list[bytes], words: int) -> np.ndarray:
    """Rows of parities of one size as 64-bit words, folded to so many."""
    rows = np.frombuffer(b"".join(bits), "<u8").reshape(len(bits), -1)
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def close_pairs(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices and parity distances of all pairs of different groups that may be similar.

    Sets differ in at least as many shingles as their parities do, so a pair
    that is left out is not similar.
    """
    part, whole = SIMILAR
    sides = []
    for table in (left, right):
        bits = table.column("bits").to_pylist()
        sides.append((table.column("n").to_numpy(), table.column("root").to_numpy(), bits, np.array([len(b) // 8 for b in bits])))
    (n, root, bits, words), (other_n, other_root, other_bits, other_words) = sides
    for w in np.unique(words).tolist():
        mine = np.flatnonzero(words == w)
        # Sizes of similar sets differ by a quarter at most, so their words by a factor of two.
        for v in (w // 2, w, 2 * w):
            theirs = np.flatnonzero(other_words == v)
            if not len(theirs):
                continue
            a, b = folded([bits[i] for i in mine], min(v, w)), folded([other_bits[i] for i in theirs], min(v, w))
            step = max(1, HELD // b.size)
            for at in range(0, len(mine), step):
                i, j = mine[at : at + step, None], theirs[None, :]
                apart = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                able = apart * (part + whole) <= (n[i] + other_n[j]) * (whole - part)
                able &= (root[i] != other_root[j]) & (np.minimum(n[i], other_n[j]) * whole >= np.maximum(n[i], other_n[j]) * part)
                x, y = np.nonzero(able)
                yield mine[at + x], theirs[y], apart[x, y]


def apart_pairs(lists: DataFrame, roots: DataFrame, nodes: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of different groups that share a list and may be similar: all, or for each set and list the closest one.

    The sets outside the largest group of a list meet all sets of the list, in tiles of bounded size.
    """
    placed = written(lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    most = groups.groupBy("token").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("held")).filter("held > most.n")
    most = most.select("token", F.col("most.root").alias("main"), "held", (F.col("held") - F.col("most.n")).alias("few"))
    met = placed.join(most, "token").join(nodes.select("node", "bits"), "node")
    chunks = lambda column: F.ceil(F.col(column) / TILE)
    own = lambda column: F.pmod(F.xxhash64("node"), chunks(column))
    every_chunk = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), chunks(column) - 1))
    rows = ("token", "node", "n", "root", "bits")
    left = met.filter("root != main").select(*rows, own("few").alias("i"), F.lit(True).alias("first"), "held")
    left = left.select(*rows, "i", every_chunk("held").alias("j"), "first")
    right = met.select(*rows, own("held").alias("j"), F.lit(False).alias("first"), "few")
    right = right.select(*rows, every_chunk("few").alias("i"), "j", "first")

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("first").to_numpy()
        left, right = group.take(np.flatnonzero(side)), group.take(np.flatnonzero(~side))
        found = [(np.zeros(0, np.int64),) * 3, *close_pairs(left, right)]
        i, j, apart = (np.concatenate(column) for column in zip(*found, strict=True))
        if not every:
            order = np.lexsort((j, apart, i))
            i, j = i[order], j[order]
            closest = np.flatnonzero(np.diff(i, prepend=-1))
            i, j = i[closest], j[closest]
        a, b = left.column("node").to_numpy()[i], right.column("node").to_numpy()[j]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return written(left.unionByName(right).groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def able_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that their sizes and parities do not rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    part, whole = SIMILAR
    near = pairs.filter(F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spared(batches):
            able = []
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)
            for (n, m), a, b in zip(sizes, batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True):
                words = min(len(a), len(b)) // 8
                apart = int(np.bitwise_count(folded([a], words) ^ folded([b], words)).sum())
                able.append(apart * (part + whole) <= (n + m) * (whole - part))
            yield batch.select(["a", "b"]).filter(pa.array(able, pa.bool_()))

    return written(near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long"))


def similar_links(nodes: DataFrame, narrow: DataFrame, known: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`known` links (a, b) and links that join all similar sets with them.

    Similar sets share a list. Each set of a list is first compared with a few
    of them, the same in most lists of a group, then with the closest one of
    another group, and at last with all of another group that may be similar. So
    comparisons grow with the sets of a list where these are copies.
    """
    postings = written(listed(narrow, order))
    held = written(postings.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("token"))
    shared = written(postings.join(held, "token", "left_semi").distinct())
    named = shared.groupBy("token").agg(F.bit_xor(F.xxhash64("node")).alias("name"), F.count(F.lit(1)).alias("held"))
    # Lists of the same sets count once.
    single = written(named.groupBy("name", "held").agg(F.min("token").alias("token")))
    lists = written(shared.join(single.select("token", "held"), "token"))

    drawn = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node")) for k in range(HEADS)]
    heads = lists.groupBy("token").agg(F.array(*drawn).alias("heads"))
    pairs = lists.join(heads, "token").select("node", F.explode("heads.node").alias("head")).filter("node != head")
    pairs = written(pairs.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct())
    links = known.unionByName(similar_pairs(able_pairs(pairs, nodes), nodes, narrow))
    more = written(lists.filter("held > 2").select("token", "node", "n"))
    for every in (False, True):
        links = links.unionByName(similar_pairs(apart_pairs(more, connected(links), nodes, every), nodes, narrow))
    return links


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text) and root, the name of its group, of every document.

    Documents are in one group if a chain of links joins them: equal sets of
    five-word shingles, SimHash fingerprints of these within two bits, or a
    Jaccard similarity of at least 0.8. A null text counts as empty; texts
    without a word are one group; shorter texts are one shingle. Repeated rows
    get equal results, an empty table gives none, further columns are ignored.
    """
    narrow = id_and_text(docs)
    sketched = written(sketches(narrow))
    order = shingle_order(narrow, sketched.count())
    nodes = written(sketched.groupBy("node").agg(F.min("fp").alias("fp"), F.max("n").alias("n"), F.min("row").alias("row"), F.first("bits").alias("bits")))
    points = written(nodes.groupBy("fp").agg(F.min("node").alias("lead")))
    a, b = (points.select(F.col("fp").alias(side), F.col("lead").alias(f"lead_{side}")) for side in ("a", "b"))
    close = near_links(points.select("fp")).join(a, "a").join(b, "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    equal = nodes.join(points, "fp").filter("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    roots = connected(similar_links(nodes, narrow, written(close.unionByName(equal)), order))
    return sketched.join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The row of each group with the smallest id (null last), and of equal rows one; columns as in `docs`."""
    kept = near_copy_groups(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_id"), F.col("k.row").alias("_key")).distinct()
    return rows_of(docs, kept, "left_semi", once=True)
