"""Whitening of embeddings: leading eigenvectors by spectrum slicing of the covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import pick

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Entries whose long would leave +-2^62 cannot be shifted and summed as longs.
LARGEST = 2.0**62
BATCH_ROWS = 2_048
EPS = np.finfo(float).eps
#: Pivot threshold of Bunch and Kaufman, which bounds the growth of the factors.
PIVOT = (1 + np.sqrt(17)) / 8


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """Negative, zero and positive eigenvalues of a symmetric matrix, by the signs of D in P A Pᵀ = L D Lᵀ.

    D has pivots of order one and two (Bunch and Kaufman), so indefinite matrices
    are factorised without growth; a column that is zero below rounding counts as zero.
    """
    a = np.array(matrix, dtype=float)
    n = len(a)
    tiny = EPS * EPS * max(1.0, np.abs(a).max(initial=0.0))
    negative = zero = positive = 0
    k = 0
    while k < n:
        below = np.abs(a[k + 1 :, k])
        lead = below.max(initial=0.0)
        pivot, size = k, 1
        if max(abs(a[k, k]), lead) <= tiny:
            zero += 1
            k += 1
            continue
        if abs(a[k, k]) < PIVOT * lead:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0.0
            widest = row.max()
            if abs(a[k, k]) * widest >= PIVOT * lead * lead:
                pivot = k
            elif abs(a[r, r]) >= PIVOT * widest:
                pivot = r
            else:
                pivot, size = r, 2
        swap = k + size - 1
        if pivot != swap:
            a[[swap, pivot], k:] = a[[pivot, swap], k:]
            a[k:, [swap, pivot]] = a[k:, [pivot, swap]]
        rest = slice(k + size, n)
        if size == 1:
            d = a[k, k]
            negative, positive = negative + (d < 0), positive + (d > 0)
            column = a[rest, k].copy()
            a[rest, rest] -= np.outer(column, column / d)
        else:
            block = a[k : k + 2, k : k + 2].copy()
            # A pivot of order two is indefinite: one eigenvalue of each sign.
            negative, positive = negative + 1, positive + 1
            columns = a[rest, k : k + 2].copy()
            a[rest, rest] -= columns @ np.linalg.solve(block, columns.T)
        k += size
    return negative, zero, positive


def at_least(matrix: np.ndarray, value: float) -> int:
    """How many eigenvalues of `matrix` lie above `value`."""
    return inertia(matrix - value * np.eye(len(matrix)))[2]


def shifted_solve(matrix: np.ndarray, shift: float, right: np.ndarray, scale: float) -> np.ndarray:
    """Solve with the shifted matrix; a shift that hits an eigenvalue exactly moves by one rounding."""
    for step in (0.0, EPS * scale, 4 * EPS * scale, 64 * EPS * scale):
        try:
            found = np.linalg.solve(matrix - (shift + step) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("no shift near an eigenvalue could be solved")


def rayleigh(matrix: np.ndarray, start: np.ndarray, shift: float, scale: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from two inverse iterations at `shift`: converges cubically on a symmetric matrix."""
    v = start / np.linalg.norm(start)
    for _ in range(2):
        v = shifted_solve(matrix, shift, v, scale)
        v /= np.linalg.norm(v)
    value = float(v @ matrix @ v)
    best = np.inf
    for _ in range(12):
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if residual >= best / 2 and residual <= 64 * EPS * scale:
            break
        best = min(best, residual)
        v = shifted_solve(matrix, value, v, scale)
        v /= np.linalg.norm(v)
        value = float(v @ matrix @ v)
    return value, v


def cluster(matrix: np.ndarray, middle: float, size: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of `size` eigenvalues that no interval separates: inverse iteration on a block, then Rayleigh and Ritz."""
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(matrix), size)))[0]
    for _ in range(6):
        block = np.linalg.qr(shifted_solve(matrix, middle, block, scale))[0]
    values, turn = np.linalg.eigh(block.T @ matrix @ block)
    return values[::-1], (block @ turn)[:, ::-1]


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues above rounding, falling, and their unit vectors as columns.

    Counts of eigenvalues above trial shifts bisect the spectrum until an
    interval holds one eigenvalue. Rayleigh quotient iteration then finds it; a
    result outside its interval sends the bisection on. At the end the counts
    just above and just below each value must give its number.
    """
    size = len(matrix)
    trace = float(np.trace(matrix))
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    floor = size * EPS * scale
    if size == 0 or not trace > 0:
        return np.zeros(0), np.zeros((size, 0))
    wanted = min(wanted, at_least(matrix, floor))
    close = 32 * size * EPS * scale
    counts = {floor: at_least(matrix, floor), scale * (1 + 4 * EPS) + floor: 0}
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < wanted:
        k = len(values)
        # The narrowest known interval that holds the eigenvalue number k + 1.
        low = max(x for x, above in counts.items() if above > k)
        high = min(x for x, above in counts.items() if above <= k)
        inside = counts[low] - counts[high]
        if high - low <= close and inside > 1:
            found, columns = cluster(matrix, (low + high) / 2, inside, scale, k)
            values.extend(found)
            vectors.extend(columns.T)
            continue
        if inside == 1 and high - low <= max(close, 2.0**-6 * high):
            value, vector = rayleigh(matrix, np.random.default_rng(k).standard_normal(size), (low + high) / 2, scale)
            if low - close <= value <= high + close:
                values.append(value)
                vectors.append(vector)
                continue
            if high - low <= close:
                raise ArithmeticError("the iteration left the interval of its eigenvalue")
        middle = (low + high) / 2
        counts[middle] = at_least(matrix, middle)
    certify(matrix, values, close)
    # Vectors of values that almost meet are known to rounding over their gap; making them orthogonal moves them no further.
    axes, upper = np.linalg.qr(np.stack(vectors[:wanted], axis=1))
    return np.array(values[:wanted]), axes * np.sign(np.diag(upper))


def certify(matrix: np.ndarray, values: list[float], close: float) -> None:
    """Values that lie further apart than rounding must have as many eigenvalues above them as their number says."""
    for number, value in enumerate(values, 1):
        above, here = at_least(matrix, value + close), at_least(matrix, value - close)
        if not above < number <= here:
            raise ArithmeticError(f"eigenvalue {number} is not certified: {above} above, {here} from there up")


@dataclass(frozen=True)
class Moments:
    """Count, exact sums of the shifted longs, their covariance, and its leading eigenpairs."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def usable(batch: pa.RecordBatch, length: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """Ids and shifted longs of the rows that hold only finite entries (and have `length` of them)."""
    lists = batch.column("embedding").cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    entries = flat.to_numpy(zero_copy_only=False).astype(float)
    valid = np.asarray(lists.is_valid())
    lengths = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    fine = np.isfinite(entries) & (np.abs(entries) < LARGEST / SCALE)
    if flat.null_count:
        fine &= np.asarray(flat.is_valid())
    bad = np.concatenate([[0], np.cumsum(~fine)])
    keep = valid & (bad[starts[1:]] == bad[starts[:-1]])
    keep &= lengths == length if length is not None else lengths > 0
    rows = np.flatnonzero(keep)
    ids = batch.column("vec_id").take(pa.array(rows))
    if length is None:
        return ids, lengths[rows]
    at = starts[rows][:, None] + np.arange(length)[None, :]
    return ids, np.floor(SCALE * entries[at]).astype(np.int64) + SHIFT


def fitted(embeddings: DataFrame, components: int = COMPONENTS) -> Moments | None:
    """Moments of all usable rows; None if there are none.

    Each pass brings the driver numbers of one vector or one matrix only: sums
    are reduced in the tasks, then by Spark.
    """
    rows = pick(embeddings, "vec_id", "embedding")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for length, n in zip(*np.unique(usable(batch)[1], return_counts=True), strict=True):
                counts[int(length)] = counts.get(int(length), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    lengths = rows.mapInArrow(seen, "length long, n long").groupBy("length").agg(F.sum("n").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if common is None:
        return None
    length, n = common.length, common.n

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * length
        for batch in batches:
            high, low = np.divmod(usable(batch, length)[1], 1 << 31)
            both = zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)
            total = [t + (h << 31) + x for t, (h, x) in zip(total, both, strict=True)]
        text = pa.array([str(t) for t in total], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), text], ["i", "total"])

    exact = rows.mapInArrow(summed, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = tuple(int(r.total) for r in exact.orderBy("i").collect())
    centre = np.array([s // n for s in sums], dtype=np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((length, length))
        for batch in batches:
            x = usable(batch, length)[1]
            for start in range(0, len(x), BATCH_ROWS):
                z = (x[start : start + BATCH_ROWS] - centre).astype(float)
                products += z.T @ z
        i, j = np.triu_indices(length)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(products[i, j])], ["i", "j", "p"]
        )

    # Centred on a whole number, so products and their sums stay exact below 2^53 and do not depend on the order of rows.
    products = rows.mapInArrow(spread, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    entries = products.toArrow()
    i, j, p = (entries.column(c).to_numpy() for c in ("i", "j", "p"))
    square = np.zeros((length, length))
    square[i, j] = square[j, i] = p
    rest = np.array([(s - int(c) * n) / n for s, c in zip(sums, centre, strict=True)])
    covariance = square / n - np.outer(rest, rest)
    values, vectors = leading_pairs(covariance, components)
    return Moments(n, sums, covariance, values, vectors)


def whitened_frame(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector along the leading components of all of them.

    An entry c becomes the long floor(1024 c) + 100000; x is a vector of those, S
    their sums and n their count. Returns one row per vector and component:
    vec_id, component (1 is the largest variance), n, deviation (sum of (n x - S)²
    over dimensions, decimal(38,0); null beyond 38 digits), whitened ((x - S/n)
    on the component, over the root of its variance), explained (its share of
    the trace) and identity_error (largest entry of the covariance of `whitened`
    minus the identity; the same in all rows).

    Rows are left out whose vector is null or empty or has an entry that is null,
    not finite or beyond 2^52, or another length than most vectors (of equally
    common lengths the longer counts). Components without variance have no
    rows, so equal vectors alone give none; nor does an empty table. A null
    vec_id is kept, repeated rows count each, further columns are ignored.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fitted(embeddings, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    rows = pick(embeddings, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    n, length, kept = model.n, len(model.sums), len(model.values)
    sums = np.array(model.sums, dtype=object)
    centre = np.array([s // n for s in model.sums], dtype=np.int64)
    rest = np.array([(s - int(c) * n) / n for s, c in zip(model.sums, centre, strict=True)])
    remainders = np.array([s - int(c) * n for s, c in zip(model.sums, centre, strict=True)], dtype=np.int64)
    axes = model.vectors / np.sqrt(model.values)

    def coordinates(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(float) - rest) @ axes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            y = coordinates(usable(batch, length)[1])
            products += y.T @ y
            total += y.sum(axis=0)
        flat = np.concatenate([products.ravel(), total])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "p"])

    sums_of = rows.mapInArrow(spread, "i int, p double").groupBy("i").agg(F.sum("p").alias("p"))
    flat = np.array([r.p for r in sums_of.orderBy("i").collect()]) / n
    # The coordinates are centred already; what rounding left of their means is taken off.
    covariance = flat[:-kept].reshape(kept, kept) - np.outer(flat[-kept:], flat[-kept:])
    error = float(np.abs(covariance - np.eye(kept)).max())
    explained = model.values / np.trace(model.covariance)

    def deviations(x: np.ndarray) -> list[int]:
        z = x - centre
        largest = max(int(np.abs(z).max(initial=0)), 1) * n + n
        if largest * largest * length < 1 << 63:
            d = z * n - remainders
            return (d * d).sum(axis=1).tolist()
        return [sum(d * d for d in (n * row - sums)) for row in x.astype(object)]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, length)
            if not len(x):
                continue
            exact = [str(d) if d < 10**38 else None for d in deviations(x)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(exact, pa.string()), pa.array(list(coordinates(x)), pa.list_(pa.float64()))],
                ["vec_id", "deviation", "coordinates"],
            )

    found = rows.mapInArrow(out, "vec_id long, deviation string, coordinates array<double>")
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return found.select(
        "vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("coordinates").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whitening_report(embeddings: DataFrame) -> DataFrame:
    """`whitened_frame` with the deviation as a long: null where 64 bits do not hold it."""
    return whitened_frame(embeddings).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
