"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so n times the sum of outer products minus the outer
product of the sums is exact: M = n^2 V for the covariance V. Its characteristic
polynomial is found modulo many 31-bit primes, each by a Hessenberg reduction in
a task of its own, and put together by Chinese remaindering. All its roots are
real, so the sign changes of its Taylor shift by a count the roots above a
exactly; bisection isolates each wanted root to 60 digits whatever
its multiplicity. Inverse iteration in the same precision finds the null space
there: unit eigenvectors, orthogonal also where an eigenvalue repeats.

Only sums by pairs of dimensions, residues and components reach the driver: sizes
that depend on the number of dimensions, not on the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tramorisk.llm.store import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
DIGITS = 60
LIMB_BITS = 32
LIMBS = 7
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``table`` with ``_x``: floor(64 c) + 1000000 for each entry c; rows whose vector is null, empty or holds null or non-finite entries go.

    Entries beyond 2^62 are held there.
    """
    edge = float(1 << 62)
    entries = table[vector].cast("array<double>")
    whole = lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c * SCALE))) + OFFSET
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.filter(table[vector].isNotNull() & fine & (F.size(table[vector]) > 0)).withColumn("_x", F.transform(entries, whole))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as an int64 matrix of x - 1000000, which has the same covariance."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) - OFFSET


def _exact_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of outer products as Python ints; by floating point where every partial sum is below 2^53."""
    top = int(np.abs(x).max(initial=0))
    if top * top * max(len(x), 1) < 1 << 53:
        y = x.astype(np.float64)
        return y.sum(0).astype(np.int64).astype(object), (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.sum(0), y.T @ y


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Exact n, sums and sums of products of x - 1000000 over the rows of ``fit``.

    A task adds up its rows and sends one row for each pair of dimensions, as
    32-bit limbs whose sums fit a long for 2^31 tasks.
    """
    upper = [(i, j) for i in range(dims) for j in range(i, dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in filter(len, batches):
            x = _matrix(batch.column(0))
            a, b = _exact_moments(x)
            n, first, second = n + len(x), first + a, second + b
        values = [n, *first, *[second[i, j] for i, j in upper]]
        limbs = [[int(v) >> LIMB_BITS * k & (1 << LIMB_BITS) - 1 if k < LIMBS - 1 else int(v) >> LIMB_BITS * k for v in values] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *[pa.array(c, pa.int64()) for c in limbs]], names=["at", *[f"l{k}" for k in range(LIMBS)]])

    parts = fit.select("_x").mapInArrow(run, "at int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    summed = parts.groupBy("at").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    values = {r["at"]: sum(r[f"l{k}"] << LIMB_BITS * k for k in range(LIMBS)) for r in summed}
    second = [[0] * dims for _ in range(dims)]
    for at, (i, j) in enumerate(upper, 1 + dims):
        second[i][j] = second[j][i] = values[at]
    return values[0], [values[1 + i] for i in range(dims)], second


def scatter(n: int, first: list[int], second: list[list[int]]) -> list[list[int]]:
    """n^2 times the covariance."""
    return [[n * second[i][j] - first[i] * first[j] for j in range(len(first))] for i in range(len(first))]


def primes_below(limit: int, count: int) -> list[int]:
    found, p = [], limit - 1 | 1
    while len(found) < count:
        p -= 2
        if all(_passes(p, a) for a in (2, 3, 5, 7)):
            found.append(p)
    return found


def _passes(p: int, base: int) -> bool:
    """Miller-Rabin round; with the bases 2, 3, 5 and 7 it is a proof below 3.2e9."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, p)
    return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - m) modulo p, constant first: similarity to Hessenberg form, then its recurrence."""
    h, d = m.copy(), len(m)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1] % p) % p
        for i in np.flatnonzero(factors):
            h[:, k + 1] = (h[:, k + 1] + factors[i] * h[:, k + 2 + i]) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        new = (new - h[k - 1, k - 1] * polys[k - 1]) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            new = (new - int(h[k - i - 1, k - 1]) * chain % p * polys[k - i - 1]) % p
        polys[k] = new
    return polys[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t - m) for a symmetric non-negative definite m, constant first; one residue task for each prime."""
    d = len(m)
    mean = -(-sum(m[i][i] for i in range(d)) // d)
    bits = max((math.comb(d, k) * mean ** k).bit_length() for k in range(d + 1)) + 2  # Maclaurin: no coefficient is larger
    primes = primes_below(1 << 31, bits // 30 + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [polynomial_mod(np.array([[v % p for v in row] for row in m], np.int64), p) for p in map(int, frame["p"])]
            yield pd.DataFrame({"p": frame["p"], "residues": [list(map(int, r)) for r in found]})

    jobs = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    coefficients, modulus = [0] * (d + 1), 1
    for row in sorted(jobs.mapInPandas(run, "p long, residues array<long>").collect()):
        p, lift = row["p"], pow(modulus, -1, row["p"])
        coefficients = [c + modulus * ((r - c) * lift % p) for c, r in zip(coefficients, row["residues"], strict=True)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in coefficients]


def roots_above(poly: list[int], a: int, scale: int) -> int:
    """Number of roots above a / 2^scale, each as often as it occurs; all roots must be real (Descartes' rule is then exact)."""
    d = len(poly) - 1
    c = [v << scale * (d - i) for i, v in enumerate(poly)]  # roots times 2^scale
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(s != t for s, t in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int, scale: int) -> int:
    """Sign of the polynomial at a / 2^scale."""
    value = 0
    for i, c in enumerate(reversed(poly)):
        value = value * a + (c << scale * i)
    return (value > 0) - (value < 0)


def isolate(poly: list[int], rank: int, digits: int = DIGITS) -> tuple[int, int, int, int]:
    """(low, scale, above, through) of the root of this rank (1: largest); all roots must be real and positive, the polynomial monic.

    The root lies in (low, low + 1] / 2^scale, below 10^-digits of it in
    width; ``above`` roots are higher and the roots to number ``through`` lie in
    the interval as well. Counting isolates a root; once it is alone, signs do.
    """
    d = len(poly) - 1
    high = abs(poly[-2]).bit_length()  # the roots add up to less than 2^high
    low, top, scale, above, through = 0, 1 << high, 0, 0, d
    while low.bit_length() <= digits * 10 // 3 and scale < (d + 1) * high + 4 * digits or top - low > 1:
        if top - low == 1:
            low, top, scale = 2 * low, 2 * top, scale + 1
        middle = (low + top) // 2
        if through - above == 1:
            count = rank if _sign(poly, middle, scale) == (-1) ** rank else above
        else:
            count = roots_above(poly, middle, scale)
        low, top, above, through = (middle, top, above, count) if count >= rank else (low, middle, count, through)
    return low, scale, above, through


def _solve(m: list[list[int]], shift: Decimal, rhs: np.ndarray) -> np.ndarray:
    """(m - shift) y = rhs by elimination with row pivots; a pivot that vanishes becomes the smallest that counts."""
    d = len(m)
    a = np.array([[Decimal(v) for v in row] for row in m], object)
    a[range(d), range(d)] -= shift
    a, y = np.concatenate([a, rhs], 1), None
    tiny = max(abs(v) for v in a[:, :d].flat) * Decimal(10) ** (-2 * DIGITS) or Decimal(1)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        factors = a[k + 1:, k] / a[k, k]
        a[k + 1:, k:] -= factors[:, None] * a[k, k:]
    y = np.empty((d, rhs.shape[1]), object)
    for k in range(d - 1, -1, -1):
        y[k] = (a[k, d:] - (a[k, k + 1:d] @ y[k + 1:] if k + 1 < d else 0)) / a[k, k]
    return y


def null_space(m: list[list[int]], root: Decimal, width: int, steps: int = 2) -> np.ndarray:
    """``width`` orthonormal eigenvectors (columns) at ``root``, by inverse iteration from fixed vectors."""
    d = len(m)
    basis = np.array([[Decimal(1 + (i + 1) * (k + 3) * (i + 2 * k + 7) % 101) for k in range(width)] for i in range(d)], object)
    for _ in range(steps):
        basis = _solve(m, root, basis)
        for k in range(width):
            for j in [*range(k), *range(k)]:
                basis[:, k] -= basis[:, j] * (basis[:, j] @ basis[:, k])
            basis[:, k] /= (basis[:, k] @ basis[:, k]).sqrt()
    return basis


def components(spark: SparkSession, m: list[list[int]], most: int = COMPONENTS) -> list[tuple[float, float, list[float]]]:
    """(eigenvalue, share of the trace, unit eigenvector) by falling eigenvalue, at most ``most`` and only positive ones; a task for each."""
    poly = characteristic_polynomial(spark, m)
    zeros = next(i for i, c in enumerate(poly) if c)
    wanted = min(most, len(m) - zeros)
    trace = sum(m[i][i] for i in range(len(m)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rank in map(int, frame["rank"]):
                low, scale, above, through = isolate(poly[zeros:], rank)
                with localcontext(Context(prec=3 * DIGITS, Emax=10 ** 9, Emin=-10 ** 9)):
                    root = Decimal(2 * low + 1) / Decimal(1 << scale + 1)
                    vector = null_space(m, root, min(through, wanted) - above)[:, rank - above - 1]
                    yield pd.DataFrame({"rank": [rank], "value": [float(root)], "share": [float(root / trace)], "vector": [[float(v) for v in vector]]})

    if not wanted:
        return []
    jobs = spark.range(1, wanted + 1).select(F.col("id").alias("rank")).repartition(wanted, "rank")
    found = jobs.mapInPandas(run, "rank long, value double, share double, vector array<double>").collect()
    return [(r["value"], r["share"], r["vector"]) for r in sorted(found, key=lambda r: r["rank"])]


def _pair_sums(fit: DataFrame, score: Callable[[np.ndarray], np.ndarray], width: int, centre: np.ndarray | None) -> np.ndarray:
    """Sums of the scored rows, or with ``centre`` the sums of products of the centred ones; a task sends one row for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width if centre is None else width * width)
        for batch in filter(len, batches):
            w = score(_matrix(batch.column(0)))
            total += w.sum(0) if centre is None else ((w - centre).T @ (w - centre)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "v"])

    found = fit.select("_x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(found)])


class Whitening:
    """Exact moments of a fit list and its components; small, whatever the number of vectors."""

    def __init__(self, fit: DataFrame, dims: int, most: int = COMPONENTS) -> None:
        spark = fit.sparkSession
        self.n, self.first, second = moments(fit, dims)
        found = components(spark, scatter(self.n, self.first, second), most)
        self.explained = [share for _, share, _ in found]
        self.weights = np.array([[v * self.n / math.sqrt(value) for v in vector] for value, _, vector in found]).reshape(-1, dims).T
        self.identity_error = 0.0
        if found:
            k, scored = len(found), self.scored
            mean = _pair_sums(fit, scored, k, None) / self.n
            self.identity_error = float(np.abs(_pair_sums(fit, scored, k, mean).reshape(k, k) / self.n - np.eye(k)).max())

    def _deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as int64 where its squares add up within a long, else as Python ints."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.first))
        kind = np.int64 if top * top * x.shape[1] < 1 << 63 else object
        return x.astype(kind) * self.n - np.array(self.first, kind)

    def scored(self, x: np.ndarray) -> np.ndarray:
        return self._deviations(x).astype(np.float64) / self.n @ self.weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        return [int(v) if v < 1 << 63 else None for v in (self._deviations(x) ** 2).sum(1)]


def whiten(table: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: the other columns of ``table`` with ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors of another length than most have (ties: the shorter length) are
    dropped like null and non-finite ones. Components are those of positive
    variance, at most ``most``: a table of less than two distinct vectors gives
    no rows. A deviation beyond a long is null. Columns named like a result are
    replaced.
    """
    carried = [c for c in table.columns if c not in (*RESULT, vector)]
    packed = table.select(F.struct(*[table[c] for c in carried], F.lit(0).alias("_mark_")).alias("row"), table[vector].alias("vector"))
    rows = integer_vectors(packed, "vector").select("row", "_x")
    common = rows.groupBy(F.size("_x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 1
    rows = rows.filter(F.size("_x") == dims)
    fit = stored(rows.select("_x").distinct())
    model = Whitening(fit, dims, most) if common else None
    k = len(model.explained) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = _matrix(batch.column(1))
            scores = pa.ListArray.from_arrays(pa.array(range(0, k * len(x) + 1, k), pa.int32()), pa.array(model.scored(x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(x), pa.int64()), scores], names=["row", "deviation", "scores"])

    schema = StructType([rows.schema["row"], StructField("deviation", LongType()), StructField("scores", ArrayType(DoubleType()))])
    scored = rows.mapInArrow(run, schema) if k else table.sparkSession.createDataFrame([], schema)
    flat = scored.select("row", "deviation", F.posexplode("scores").alias("at", "value"))
    shares = F.array(*[F.lit(e) for e in (model.explained if k else [0.0])])
    return flat.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
                       "deviation", F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
                       F.lit(model.identity_error if model else 0.0).alias("identity_error"))
