"""Whitening of embeddings by an exact spectrum.

Entries become integers, so the covariance of the distinct vectors is a matrix of
integers up to a known factor, summed in Spark without rounding. Its characteristic
polynomial is found modulo many primes, one task's work each (reduction to Hessenberg
form, then a recurrence), and put together by Chinese remainders. All its roots are
real, so the sign changes of the shifted polynomial count the roots above a number
exactly; bisection by that count isolates the largest ones. Inverse iteration in many
digits finds their null spaces.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.shared import stored

SCALE, COMPONENTS = 256, 4
#: Entries from here on, in units of the scale, have no place in a long; they count as not finite.
LARGEST = float(1 << 62)
#: A float product of that many rows of limbs of that many bits is exact.
LIMB_BITS, LIMB_ROWS = 20, 1 << 13
#: Bits of an eigenvalue; digits of a component while it is found.
ROOT_BITS, DIGITS = 100, 70

PARTIAL = "i int, j int, high decimal(38,0), low decimal(38,0)"


def scaled(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``row``, a struct of all columns, and ``x``, the entries times ``scale``, rounded down.

    Rows whose vector is null, empty or holds null, non-finite or unbounded entries
    are left out, and so are vectors of another length than most have.
    """
    value = lambda c: c.cast("double") * F.lit(float(scale))
    fits = lambda c: F.coalesce(F.abs(value(c)) < F.lit(LARGEST), F.lit(False))
    good = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{vector}`").alias("x")).filter(
        (F.size("x") > 0) & F.forall("x", lambda c: fits(c) & ~F.isnan(c.cast("double"))))
    good = good.withColumn("x", F.transform("x", lambda c: F.floor(value(c)).cast("bigint")))
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return good.filter(F.size("x") == (most["d"] if most else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _rows(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Whole numbers of any size as two decimals each."""
    keys, mask = list(totals), (1 << 64) - 1
    number = lambda v: pa.array([decimal.Decimal(int(n)) for n in v], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
        number(totals[k] >> 64 for k in keys), number(totals[k] & mask for k in keys)], ["i", "j", "high", "low"])


def _summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of partial rows, one per pair of dimensions."""
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r["i"], r["j"]): (int(r["high"]) << 64) + int(r["low"]) for r in sums.collect()}


def _count_and_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, 0, 0
    for batch in batches:
        x = _matrix(batch.column("x"))
        if len(x):
            n += len(x)
            high = high + (x >> 31).sum(axis=0).astype(object)
            low = low + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
    if n:
        yield _rows({(-1, -1): n} | {(i, -1): int(v) for i, v in enumerate((high << 31) + low)})


def _products(y: np.ndarray) -> np.ndarray:
    """The exact y' y of a matrix of longs, as Python integers."""
    limbs, rest = [], y
    while True:
        if np.abs(rest).max(initial=0) < 1 << (LIMB_BITS - 1):
            limbs.append(rest.astype(np.float64))
            break
        limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rest = rest >> LIMB_BITS
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            total += (left.T @ right).astype(np.int64).astype(object) << (LIMB_BITS * (a + b))
    return total


def _scatter(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of products of the entries less ``centre``."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _matrix(batch.column("x")) - np.array(centre, np.int64)
            for at in range(0, len(y), LIMB_ROWS):
                made = _products(y[at:at + LIMB_ROWS])
                total = made if total is None else total + made
        if total is not None:
            yield _rows({(i, j): int(total[i, j]) for i in range(len(total)) for j in range(i + 1)})

    return _summed(fit.mapInArrow(part, PARTIAL))


# -- the characteristic polynomial ---------------------------------------------


def _is_prime(n: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3,215,031,751
        power = pow(base, odd, n)
        if power not in (1, n - 1) and all((power := power * power % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31, as many as make a product of more than ``bits`` bits."""
    found, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime, the leading 1 first.

    Similar row and column steps bring the matrix to Hessenberg form, whose leading
    blocks give the polynomial one degree after the other.
    """
    h, d = matrix.astype(np.int64) % p, len(matrix)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1:, k])
        if not len(pivots):
            continue
        at = k + 1 + int(pivots[0])
        if at != k + 1:
            h[[at, k + 1]] = h[[k + 1, at]]
            h[:, [at, k + 1]] = h[:, [k + 1, at]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1] % p) % p
        # the sum of d products below 2^31 is taken in parts that a long holds
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    blocks = np.zeros((d + 1, d + 1), np.int64)  # blocks[k]: coefficients of the k-th block, lowest degree first
    blocks[0, 0] = 1
    for k in range(d):
        row = np.zeros(d + 1, np.int64)
        row[1:] = blocks[k, :-1]
        weight, below = np.empty(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weight[i] = int(h[i, k]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        blocks[k + 1] = (row - (weight[:, None] * blocks[:k + 1] % p).sum(axis=0)) % p
    return [int(c) for c in blocks[d][::-1]]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(x - matrix) of a positive semidefinite matrix of integers, the leading 1 first.

    No coefficient exceeds (1 + trace / d)^d, so primes are taken until their
    product passes twice that; each prime is a row that Spark deals out. What comes
    back is bounded by the dimension.
    """
    d = len(matrix)
    mean = sum(matrix[i][i] for i in range(d)) // d + 2
    moduli = primes(d * mean.bit_length() + 2)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array(matrix, object)
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "c": [polynomial_mod(whole % int(p), int(p)) for p in batch["p"]]})

    tasks = min(len(moduli), 2 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(tasks, "p").mapInPandas(part, "p bigint, c array<bigint>")
    found = {r["p"]: r["c"] for r in rows.collect()}
    values, product = [0] * (d + 1), 1
    for p in moduli:
        inverse = pow(product, -1, p)
        values = [v + product * ((c - v) * inverse % p) for v, c in zip(values, found[p])]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


# -- roots and components --------------------------------------------------------


def _above(coefficients: list[int], at: int) -> int:
    """Roots greater than ``at`` of a polynomial that has real roots only.

    The sign changes of the polynomial shifted by ``at`` count its positive roots,
    each as often as it occurs.
    """
    shifted = list(coefficients)
    for end in range(len(shifted) - 1, 0, -1):
        for i in range(1, end + 1):
            shifted[i] += at * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], at: int) -> int:
    value = reduce(lambda v, c: v * at + c, coefficients, 0)
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], count: int) -> list[Fraction]:
    """The ``count`` largest roots, each as often as it occurs, to 100 bits; none that is 0."""
    d = len(coefficients) - 1
    trace = -coefficients[1]
    if trace <= 0:
        return []
    shift = ROOT_BITS + 2 * d.bit_length()  # an integer matrix: a root far below 1 has large ones beside it
    grown = [c << (shift * i) for i, c in enumerate(coefficients)]
    found: list[Fraction] = []
    positive = _above(grown, 0)
    while len(found) < min(count, positive):
        rank = len(found) + 1  # the largest number with ``rank`` roots not below it
        low, high, n_low, n_high = 0, (trace << shift) + 1, positive, 0
        while high - low > 1 and (high - low) << ROOT_BITS > high:
            if n_low - n_high == 1 and (high - low) << 4 < high and _sign(grown, low) * _sign(grown, high) < 0:
                below = _sign(grown, low)
                while high - low > 1 and (high - low) << ROOT_BITS > high:
                    middle = (low + high) // 2
                    if _sign(grown, middle) == below:
                        low = middle
                    else:
                        high = middle
                break
            middle = (low + high) // 2
            n = _above(grown, middle)
            if n >= rank:
                low, n_low = middle, n
            else:
                high, n_high = middle, n
        found += [Fraction(low + high, 2 << shift)] * max(n_low - n_high, 1)
    return found[:min(count, positive)]


def null_vectors(matrix: list[list[int]], roots: list[Fraction]) -> list[list[float]]:
    """A unit vector for each root, orthogonal to those before it; its largest entry is positive."""
    d, made = len(matrix), []
    with decimal.localcontext() as context:
        context.prec = DIGITS + len(str(max(map(max, matrix))))
        number = decimal.Decimal
        dot = lambda a, b: sum((x * y for x, y in zip(a, b)), number(0))

        def apart(v: list) -> list:
            for w in made:
                part = dot(v, w)
                v = [x - part * y for x, y in zip(v, w)]
            size = dot(v, v).sqrt()
            return [x / size for x in v]

        tiny = number(10) ** (len(str(max(map(max, matrix)))) - context.prec + 8)
        factors, known = None, None
        for root in roots:
            if root != known:
                value = number(root.numerator) / number(root.denominator)
                factors, known = _factors([[number(x) - (value if i == j else 0) for j, x in enumerate(r)] for i, r in enumerate(matrix)], tiny), root
            v = [number(1 + (7919 * (i + 1) * (len(made) + 1)) % 1009) for i in range(d)]
            for _ in range(3):
                v = apart(_solved(factors, apart(v)))
            made.append(v)
        signed = [v if max(v) >= -min(v) else [-x for x in v] for v in made]
        return [[float(x) for x in v] for v in signed]


def _factors(a: list[list], tiny) -> tuple[list[list], list[int]]:
    """Elimination with the largest pivot of each column; a pivot of nothing becomes tiny."""
    d, order = len(a), []
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        order.append(best)
        a[k], a[best] = a[best], a[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        top, pivot = a[k], a[k][k]
        for i in range(k + 1, d):
            if a[i][k]:
                row, f = a[i], a[i][k] / pivot
                row[k + 1:] = [x - f * y for x, y in zip(row[k + 1:], top[k + 1:])]
                row[k] = f
    return a, order


def _solved(factors: tuple[list[list], list[int]], right: list) -> list:
    a, order = factors
    v, d = list(right), len(a)
    for k, other in enumerate(order):
        v[k], v[other] = v[other], v[k]
    for i in range(d):
        v[i] -= sum((x * y for x, y in zip(a[i][:i], v[:i])), decimal.Decimal(0))
    for i in range(d - 1, -1, -1):
        v[i] = (v[i] - sum((x * y for x, y in zip(a[i][i + 1:], v[i + 1:])), decimal.Decimal(0))) / a[i][i]
    return v


# -- fit and use -----------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit knows: its size grows with the dimension, never with the rows."""

    n: int
    sums: list[int]
    centre: list[int]
    components: list[list[float]]  # unit eigenvectors by falling eigenvalue
    eigenvalues: list[float]
    explained: list[float]
    identity_error: float | None

    @property
    def projection(self) -> np.ndarray:
        """From centred entries to whitened ones."""
        return np.array(self.components).T / np.sqrt(np.array(self.eigenvalues))

    def centred(self, x: np.ndarray) -> np.ndarray:
        rest = [float(c - Fraction(s, self.n)) for c, s in zip(self.centre, self.sums)]
        return (x - np.array(self.centre, np.int64)).astype(np.float64) + np.array(rest)


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``points``; null without any.

    Equal vectors count once and are merged before they meet, however frequent.
    Counts, sums and products are exact at every size. Components of eigenvalue 0
    do not exist, so a table of one vector has none.
    """
    distinct = stored(points.select("x").distinct())
    sums = _summed(distinct.mapInArrow(_count_and_sums, PARTIAL))
    if not sums:
        return None
    n, d = sums[-1, -1], len(sums) - 1
    sums = [sums[i, -1] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = _scatter(distinct, centre)
    scatter = [[n * products[max(i, j), min(i, j)] - rest[i] * rest[j] for j in range(d)] for i in range(d)]  # n^2 times the covariance
    shared = math.gcd(*(v for row in scatter for v in row)) or 1
    matrix = [[v // shared for v in row] for row in scatter]
    roots = largest_roots(polynomial(points.sparkSession, matrix), components)
    trace = sum(matrix[i][i] for i in range(d))
    made = Whitening(
        n, sums, centre, null_vectors(matrix, roots), [float(r * shared / (n * n)) for r in roots],
        [float(r / trace) for r in roots], None)
    if roots:
        made.identity_error = _identity_error(distinct, made)
    return made


def _identity_error(distinct: DataFrame, made: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    r = len(made.eigenvalues)

    def totals(value):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + value(made.centred(_matrix(batch.column("x"))) @ made.projection)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "total"])

        rows = distinct.mapInArrow(part, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
        found = np.zeros(len(rows))
        for row in rows:
            found[row["at"]] = row["total"]
        return found / made.n

    mean = totals(lambda w: w.sum(axis=0))
    covariance = totals(lambda w: (w - mean).T @ (w - mean)).reshape(r, r)
    return float(np.abs(covariance - np.eye(r)).max())


def whitened(points: DataFrame, made: Whitening) -> DataFrame:
    """``row``, component (from 1), deviation and whitened of each row and component.

    ``deviation`` is the sum over dimensions of (n x - sum)^2, exact, null where
    38 digits do not hold it.
    """
    rest = [s - made.n * c for s, c in zip(made.sums, made.centre)]
    limit, r = decimal.Decimal(10) ** 38, len(made.eigenvalues)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x) or not r:
                continue
            y = x - np.array(made.centre, np.int64)
            most = made.n * int(np.abs(y).max()) + max(map(abs, rest))
            wide = most * most * len(rest) >= 1 << 63
            away = made.n * y.astype(object if wide else np.int64) - np.array(rest, object if wide else np.int64)
            deviation = [decimal.Decimal(int(v)) for v in (away * away).sum(axis=1)]
            values = pa.array([v if v < limit else None for v in deviation], pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(len(x)), r))
            yield pa.RecordBatch.from_arrays([
                batch.column("row").take(again), pa.array(np.tile(np.arange(1, r + 1), len(x)), pa.int32()),
                values.take(again), pa.array((made.centred(x) @ made.projection).ravel())],
                ["row", "component", "deviation", "whitened"])

    schema = points.select("row", F.lit(0).alias("component"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened")).schema
    return points.mapInArrow(part, schema)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``row``, component, n, deviation, whitened, explained and identity_error of every usable row.

    Rows without a usable vector (see ``scaled``) are left out; rows that repeat,
    with or without one id, each have their values. All columns stay in the struct
    ``row``, so no name can clash. A table of nothing, or of one distinct vector,
    gives no row; fewer dimensions than ``components`` give as many.
    """
    points = scaled(rows, vector)
    made = fit(points, components)
    if made is None:
        made = Whitening(0, [], [], [], [], [], None)
    share = F.element_at(F.array(*[F.lit(e) for e in made.explained]).cast("array<double>"), F.col("component"))
    return whitened(points, made).withColumns({
        "n": F.lit(made.n).cast("bigint"), "explained": share, "identity_error": F.lit(made.identity_error).cast("double")})
