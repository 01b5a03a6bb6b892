"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Entries become integers, so n * sum(x x') - S S' is an integer matrix, n * n
times the covariance. Tasks sum it exactly. Its characteristic polynomial
is found modulo many primes (Hessenberg reduction, one prime a row of a
Spark frame) and put together by Chinese remainders. All its roots are real,
so sign variations count roots exactly; intervals are halved until they
hold one root, which is then narrowed by signs. Each component is the null
space of matrix minus root, by inverse iteration in long fixed-point numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 32
#: Roots nearer to each other than 2**-CLUSTER_BITS of their size count as one repeated root.
CLUSTER_BITS = 100
#: Bits to which roots are narrowed, relative to their size, and of fractions in the elimination.
ROOT_BITS, FRACTION_BITS = 180, 224
#: Rows multiplied at once: with entries below 2**20 every sum stays below 2**53.
ROWS = 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Fit of one width: sums of floor(SCALE * entry), unit components as columns, their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def usable(embedding: Column) -> Column:
    """Not null, and no component null, non-finite or of 2**55 or more."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 55)))
    return F.coalesce(fine, F.lit(False))


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, width, y): floor(SCALE * entry) of the usable vectors; x is y + SHIFT."""
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    return embeddings.where(usable(doubles)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("width"),
        F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("y"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers, exact."""
    if not len(y) or max(-int(y.min()), int(y.max())) < 1 << 20:
        doubles = y.astype(float)
        return (doubles.T @ doubles).astype(np.int64).astype(object)
    whole = y.astype(object)
    return whole.T @ whole


def _task_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, v): at 0 the rows, then the sums of entries, then the upper triangle of the products."""
    n, sums, squares = 0, np.zeros(width, object), np.zeros((width, width), object)
    for batch in batches:
        y = _matrix(batch.column(0), width)
        n += len(y)
        for at in range(0, len(y), ROWS):
            part = y[at : at + ROWS]
            sums = sums + part.astype(object).sum(axis=0)
            squares = squares + _products(part)
    if n:
        values = [n, *sums, *squares[np.triu_indices(width)]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38))], ["k", "v"]
        )


def exact_sums(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, products) of the vectors of a width; sums beyond 38 digits raise."""
    rows = (
        vectors.where(F.col("width") == width).select("y")
        .mapInArrow(lambda it: _task_sums(it, width), "k int, v decimal(38,0)")
        .groupBy("k").agg(F.sum("v").alias("v")).collect()
    )
    held = {r["k"]: r["v"] for r in rows}
    if None in held.values():
        raise OverflowError("sums of products beyond 38 digits")
    values = [int(held[k]) for k in range(len(held))]
    squares = np.zeros((width, width), object)
    squares[np.triu_indices(width)] = values[1 + width :]
    lower = np.tril_indices(width, -1)
    squares[lower] = squares.T[lower]
    return values[0], values[1 : 1 + width], squares


def _is_prime(p: int) -> bool:
    """Miller's test with bases that decide every number below 2**32."""
    if p % 2 == 0:
        return p == 2
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, p)
        if base % p and x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes below 2**31, enough for every coefficient: with roots of sum t the k-th is at most C(d, k) (t / d)**k."""
    d, trace = len(matrix), int(np.trace(matrix))
    most = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    out, product, p = [], 1, (1 << 31) + 1
    while product <= 2 * most + 1:
        p -= 2
        if _is_prime(p):
            out.append(p)
            product *= p
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(x - matrix) modulo a prime below 2**31."""
    d = len(matrix)
    h = (matrix % p).astype(np.int64)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if i := int(below[0]):
            h[[m, m + i]] = h[[m + i, m]]
            h[:, [m, m + i]] = h[:, [m + i, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    # determinants of the leading blocks, by expansion along the last column
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = -h[k - 1, k - 1] * minors[k - 1] % p
        row[1:] += minors[k - 1, :-1]
        weight = np.zeros(k, np.int64)
        run = 1
        for j in range(k - 1, 0, -1):
            run = run * int(h[j, j - 1]) % p
            weight[j - 1] = run * int(h[j - 1, k - 1]) % p
        row -= (weight[:, None] * minors[:k] % p).sum(axis=0)
        minors[k] = row % p
    return minors[d]


def _modulo(batches: Iterator[pa.RecordBatch], matrix) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        primes = batch.column(0).to_pylist()
        found = [polynomial_modulo(matrix.value, p).tolist() for p in primes]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])


def _tasks(spark: SparkSession, items: int) -> int:
    return min(items, max(1, spark.sparkContext.defaultParallelism))


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - matrix), constant first; matrix integer with roots of at least 0."""
    shared = spark.sparkContext.broadcast(matrix)
    primes = spark.createDataFrame([(p,) for p in primes_for(matrix)], "p long")
    rows = (
        primes.repartition(_tasks(spark, 64))
        .mapInArrow(lambda it: _modulo(it, shared), "p long, c array<long>").collect()
    )
    product = math.prod(r["p"] for r in rows)
    weights = [(product // r["p"]) * pow(product // r["p"], -1, r["p"]) for r in rows]
    out = []
    for k in range(len(matrix) + 1):
        c = sum(w * r["c"][k] for w, r in zip(weights, rows)) % product
        out.append(c - product if 2 * c > product else c)
    return out


def _variations(c: list[int]) -> int:
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _shifted(c: list[int]) -> list[int]:
    """Coefficients of c(x + 1)."""
    left, out = c[::-1], []
    while left:
        left = list(accumulate(left))
        out.append(left.pop())
    return out


def _zeros(c: list[int]) -> int:
    return next(k for k, x in enumerate(c) if x)


def isolated_roots(c: list[int], most: int) -> list[tuple[Fraction, Fraction, int, int]]:
    """(low, high, roots, roots above) of the largest positive roots, largest first.

    ``c`` has real roots of at least 0 only, so its sign variations are the
    number of its positive roots. Intervals are halved until they hold one
    root inside or are narrower than 2**-CLUSTER_BITS of it; low equals
    high where a halving point is a root. Stops when ``most`` roots are found.
    """
    c = c[_zeros(c) :]
    d = len(c) - 1
    out: list[tuple[Fraction, Fraction, int, int]] = []
    size = (-c[-2]).bit_length() if d else 0  # 2**size is above the sum of all roots
    stack: list[tuple] = [(0, size, [x << size * k for k, x in enumerate(c)], 0)]
    while stack and sum(r[2] for r in out) < most:
        k, s, here, above = stack.pop()
        if here is None:  # a halving point k that is a root, s times
            out.append((k, k, s, above))
            continue
        low, high = k * Fraction(2) ** s, (k + 1) * Fraction(2) ** s
        inside = _variations(here) - above
        if inside == 1 or inside and k.bit_length() > CLUSTER_BITS:
            out.append((low, high, inside, above))
        elif inside:
            left = [x << d - i for i, x in enumerate(here)]
            middle = _shifted(left)
            beyond, at = _variations(middle), _zeros(middle)
            stack.append((2 * k, s - 1, left, beyond + at))
            if at:
                stack.append(((low + high) / 2, at, None, beyond))
            stack.append((2 * k + 1, s - 1, middle, above))
    return out


def narrowed(c: list[int], low: Fraction, high: Fraction, above: int, bits: int = ROOT_BITS) -> Fraction:
    """The single root between low and high, to 2**-bits of its size; the sign right of it is that of (-1)**above."""
    if low == high:
        return low
    while (high - low) * (1 << bits) > high:
        middle = (low + high) / 2
        value, scale = 0, 1
        for x in reversed(c):  # numerator of c(middle)
            value = value * middle.numerator + x * scale
            scale *= middle.denominator
        if not value:
            return middle
        low, high = (low, middle) if (value > 0) == (above % 2 == 0) else (middle, high)
    return (low + high) / 2


def null_vectors(matrix: np.ndarray, root: Fraction, count: int, bits: int = FRACTION_BITS) -> np.ndarray:
    """``count`` orthonormal columns that span the space of a root of that multiplicity, as doubles."""
    d = len(matrix)
    a = matrix.astype(object) * (1 << bits)
    a[np.diag_indices(d)] -= (root.numerator << bits) // root.denominator
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, best]] = a[[best, k]]
        order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1
        a[k + 1 :, k] = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k : k + 1] * a[k, k + 1 :]) >> bits
    rng = np.random.default_rng(d)
    vectors = [np.array([int(v) << bits for v in rng.integers(-1000, 1000, d)], object) for _ in range(count)]
    for _ in range(2):
        done: list[np.ndarray] = []
        for v in vectors:
            b = v[order]
            for k in range(d):
                b[k + 1 :] -= (a[k + 1 :, k] * b[k]) >> bits
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] << bits) // a[k, k]
                b[:k] -= (a[:k, k] * b[k]) >> bits
            b = _unit(b, bits)
            for _ in range(2):
                for other in done:
                    b = b - ((other * ((b @ other) >> bits)) >> bits)
                b = _unit(b, bits)
            done.append(b)
        vectors = done
    return np.array([[float(Fraction(int(x), 1 << bits)) for x in v] for v in vectors]).T


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    """A vector at length one, in fixed point."""
    length = max(math.isqrt(int(v @ v)), 1)
    return np.array([(int(x) << bits) // length for x in v], object)


def _spaces(batches: Iterator[pa.RecordBatch], matrix) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for root, count in zip(batch.column("root").to_pylist(), batch.column("roots").to_pylist()):
            found.append(null_vectors(matrix.value, Fraction(root), count).T.ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.list_(pa.float64()))], ["k", "v"])


def fit(vectors: DataFrame, width: int, most: int = MOST_COMPONENTS) -> Whitening:
    """Components of positive variance of the vectors of a width, at most ``most``, by falling variance."""
    spark = vectors.sparkSession
    n, sums, squares = exact_sums(vectors, width)
    s = np.array(sums, object)
    matrix = n * squares - np.outer(s, s)
    trace = int(np.trace(matrix))
    if not trace:
        none = np.zeros(0)
        return Whitening(n, sums, np.zeros((width, 0)), none, none)
    c = characteristic_polynomial(spark, matrix)
    roots = [
        (narrowed(c, low, high, above) if count == 1 else (low + high) / 2, count)
        for low, high, count, above in isolated_roots(c, most)
    ]
    shared = spark.sparkContext.broadcast(matrix)
    frame = spark.createDataFrame([(k, str(r), count) for k, (r, count) in enumerate(roots)], "k int, root string, roots int")
    rows = (
        frame.repartition(_tasks(spark, len(roots)))
        .mapInArrow(lambda it: _spaces(it, shared), "k int, v array<double>").collect()
    )
    parts = [np.array(r["v"]).reshape(-1, width) for r in sorted(rows, key=lambda r: r["k"])]
    components = np.concatenate(parts)[:most].T
    largest = np.abs(components).argmax(axis=0)
    components *= np.sign(components[largest, np.arange(components.shape[1])])
    values = [r for r, count in roots for _ in range(count)][:most]
    return Whitening(
        n, sums, components, np.array([float(r / n**2) for r in values]), np.array([float(r / trace) for r in values])
    )


def _projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Centred rows on the components, over the deviations."""
    mean = np.array([float(Fraction(s, model.n)) for s in model.sums])
    return (y - mean) @ model.components / np.sqrt(model.variances)


def _moments(batches: Iterator[pa.RecordBatch], shared, mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (k, v) of a task: sums of whitened values, or of their products once centred on ``mean``."""
    model = shared.value
    total = 0.0
    for batch in batches:
        w = _projected(_matrix(batch.column(0), len(model.sums)), model)
        total = total + (w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean)).ravel())
    if np.ndim(total):
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "v"])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened covariance minus the identity, from the whitened values themselves."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def total(mean: np.ndarray | None) -> np.ndarray:
        rows = (
            vectors.where(F.col("width") == len(model.sums)).select("y")
            .mapInArrow(lambda it: _moments(it, shared, mean), "k int, v double")
            .groupBy("k").agg(F.sum("v").alias("v")).collect()
        )
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])

    mean = total(None) / model.n
    covariance = total(mean).reshape(len(mean), len(mean)) / model.n
    return float(np.abs(covariance - np.eye(len(mean))).max())


def _deviations(y: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums of (n x - S)**2, exact; None beyond a long."""
    most = max(-int(y.min()), int(y.max())) * model.n + max(map(abs, model.sums)) if y.size else 0
    if most * most * len(model.sums) < 1 << 63:
        off = model.n * y - np.array(model.sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = model.n * y.astype(object) - np.array(model.sums, object)
    return [int(x) if x < 1 << 63 else None for x in (off * off).sum(axis=1)]


def _whitened(batches: Iterator[pa.RecordBatch], shared, error: float) -> Iterator[pa.RecordBatch]:
    model = shared.value
    found = len(model.variances)
    for batch in batches:
        y = _matrix(batch.column(1), len(model.sums))
        each = np.repeat(np.arange(len(y)), found)
        deviation = pa.array(_deviations(y, model), pa.int64()).take(pa.array(each))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(each), model.n)), deviation, pa.array(_projected(y, model).ravel()),
                pa.array(np.tile(model.explained, len(y))), pa.array(np.full(len(each), error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whitened(embeddings: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows without vector, with null or non-finite entries, or with entries of
    2**55 or more have no components. All others have one width; where they
    differ, the most frequent width (the smaller of equals) is fitted and
    the others have none. Components of no variance do not exist, so
    vectors that are all equal, or a single one, give no rows, as does an
    empty table. Rows with null or repeated vec_id are vectors of their own.
    Equal variances share their space; its basis is fixed but arbitrary.
    ``deviation`` is null where it exceeds a long. Columns other than vec_id
    and embedding are not read.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    widths = vectors.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").head(1)
    if not widths or not widths[0]["width"]:
        return spark.createDataFrame([], SCHEMA)
    width = widths[0]["width"]
    model = fit(vectors, width, most)
    if not len(model.variances):
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(vectors, model)
    shared = spark.sparkContext.broadcast(model)
    return (
        vectors.where(F.col("width") == width).select("vec_id", "y").mapInArrow(lambda it: _whitened(it, shared, error), SCHEMA)
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
