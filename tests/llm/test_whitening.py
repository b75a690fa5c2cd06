"""Exact whitening against plain linear algebra and exact small cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import whitening

VECTORS = "vec_id bigint, embedding array<double>, label int"


def leverrier(a):
    """Coefficients of det(x - a) with fractions."""
    d = len(a)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][l] * m[l][j] for l in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][l] * m[l][i] for i in range(d) for l in range(d)) / k)
    return [int(c) for c in out]


def gram(rng, d, rank, size):
    x = [[rng.randrange(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d,rank,size", [(1, 1, 9), (2, 2, 5), (5, 3, 10**6), (7, 7, 40), (6, 2, 3)])
def test_polynomial_is_exact(spark, d, rank, size):
    a = gram(random.Random(d), d, rank, size)
    assert whitening.polynomial(spark, a) == leverrier(a)


def test_roots_and_components_of_repeated_and_close_eigenvalues():
    a = [[2, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 0]]
    roots = whitening.largest_roots(leverrier(a), 4)
    assert [round(float(r), 12) for r in roots] == [5, 5, 2]  # 0 is no component
    v = np.array(whitening.null_vectors(a, roots))
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.allclose(v @ np.array(a), v * [[5], [5], [2]])
    big = 10**14
    a = [[big, 1, 0], [1, big, 1], [0, 1, big]]
    roots = whitening.largest_roots(leverrier(a), 3)
    assert [float(r - big) for r in roots] == pytest.approx([math.sqrt(2), 0, -math.sqrt(2)], abs=1e-12)
    assert np.allclose(np.abs(whitening.null_vectors(a, roots)[0]), [0.5, math.sqrt(0.5), 0.5], atol=1e-15)
    assert whitening.largest_roots([1, 0, 0], 2) == []


def check(spark, rows, made=None, d=None):
    df = spark.createDataFrame(rows, VECTORS) if made is None else made
    got = whitening.whiten(df).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    usable = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows
              if v and all(c is not None and math.isfinite(c) for c in v) and (d is None or len(v) == d)]
    distinct = sorted({tuple(v) for _, v in usable})
    n = len(distinct)
    x = np.array(distinct, float)
    sums = [sum(v[k] for v in distinct) for k in range(len(distinct[0]))]
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    count = min(4, int((values > 1e-9 * max(values.max(), 1e-30)).sum()))
    assert len(got) == len(usable) * count
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in range(count):
        e, w = values[-1 - k], vectors[:, -1 - k]
        sign = 0
        for i, v in usable:
            for r in by[i, k + 1]:
                assert r["n"] == n and r["explained"] == pytest.approx(e / values.sum(), rel=1e-8) and r["identity_error"] < 1e-9
                assert int(r["deviation"]) in {sum((n * a - s) ** 2 for a, s in zip(u, sums)) for j, u in usable if j == i}
                want = float((np.array(v) - x.mean(axis=0)) @ w / math.sqrt(e))
                if len(by[i, k + 1]) == 1:
                    sign = sign or (1 if want * r["whitened"] > 0 else -1)
                    assert r["whitened"] == pytest.approx(sign * want, abs=1e-7)


def test_against_plain_linear_algebra(spark):
    rng = random.Random(11)
    base = [[rng.gauss(0, 1) * (1 + k % 3) for k in range(9)] for _ in range(6)]
    rows = [(i, [sum(rng.gauss(0, s) * b[k] for s, b in zip((4, 3, 2, 1, .5, .2), base)) + 30 for k in range(9)], i) for i in range(150)]
    rows += [(200 + i, rows[3][1], 0) for i in range(60)] + [(300, None, 1), (301, [], 1), (302, [1.0] * 8 + [None], 1)]
    rows += [(303, [float("nan")] + [0.0] * 8, 1), (304, [float("inf")] + [0.0] * 8, 1), (305, [1.0] * 4, 1), (3, rows[7][1], 2), (None, [1.5] * 9, 2)]
    check(spark, rows, d=9)


def test_few_dimensions_and_large_entries(spark):
    rng = random.Random(5)
    check(spark, [(i, [rng.gauss(0, 9), rng.gauss(1, 2)], 0) for i in range(40)])
    check(spark, [(i, [rng.gauss(0, 1e9), rng.gauss(1e12, 2e5), rng.gauss(0, 3e7)], 0) for i in range(40)])


def test_nothing_one_vector_and_clashing_columns(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).count() == 0
    rows = [(i, [float(i), float(i * i % 7), 1.0], 0) for i in range(12)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("x", "row", "n", "component", "whitened")})
    check(spark, rows, df)


def test_sums_beyond_longs(spark):
    big = 2.0**52
    rows = [(i, [big * (-1) ** i, float(i)], 0) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).filter("component = 1").collect()
    x = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((6 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(6)}
    assert {r["row"]["vec_id"]: None if r["deviation"] is None else int(r["deviation"]) for r in got} == {
        i: v if v < 10**38 else None for i, v in want.items()}
    assert all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in got)
