"""Whitening against exact fractions and numpy on small tables."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import whitening
from tessera.llm.whitening import covariance, fit, quantise, square_sums, whiten

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.IntegerType())])


def exact(rows):
    """n, sums, covariance and integer vectors by id, from plain Python."""
    xs = {}
    for i, v, *_ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            xs.setdefault(tuple(math.floor(256 * float(np.float32(c))) for c in v), []).append(i)
    fit_list = list(xs)
    n, d = len(fit_list), len(fit_list[0])
    s = [sum(x[k] for x in fit_list) for k in range(d)]
    cov = [[sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit_list) / n for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(c) for c in r] for r in cov]), xs


def random_rows(n=60, d=6, seed=1, spread=1.0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d))
    rows = [(k, [float(c) for c in (r.normal(size=d) @ mix * spread).astype(np.float32)], k % 3) for k in range(n)]
    return rows + [(n + k, rows[0][1], 0) for k in range(20)]


def check(spark, rows):
    got = whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    n, s, cov, xs = exact(rows)
    d = len(s)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    ids = {i: x for x, group in xs.items() for i in group}
    assert sorted(zip(got.vec_id, got.component)) == sorted((i, k + 1) for i in ids for k in range(min(4, d)))
    sign = {}
    for r in got.itertuples():
        x, k = ids[r.vec_id], r.component - 1
        assert r.n == n and int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        want = (np.array(x) - np.array(s) / n) @ axes[:, k] / math.sqrt(values[k])
        if abs(want) > 1e-3:
            assert sign.setdefault(k, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
        assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-9)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("spread", [1.0, 3e7])
def test_against_fractions(spark, spread):
    check(spark, random_rows(spread=spread))


def test_dropped_rows_and_empty_table(spark):
    rows = random_rows(12, 3) + [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 2.0], 0), (103, [float("inf"), 0.0, 0.0], 0)]
    check(spark, rows)
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0


def test_no_variance_short_vectors_null_ids(spark):
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25], 0), (None, [0.5, 0.25], 0)], SCHEMA)).collect()
    assert len(one) == 4 and {r.whitened for r in one} == {None} and {r.explained for r in one} == {None} and {r.identity_error for r in one} == {None}
    line = whiten(spark.createDataFrame([(1, [0.5], 0), (2, [0.0, 0.0], 0), (3, [1.0], 0), (3, [1.0, 0.0], 0)], SCHEMA)).collect()
    assert {r.n for r in line} == {3} and len(line) == 8
    assert all((r.whitened is None) == (r.component == 2) for r in line)


def test_huge_entries_stay_exact(spark):
    """Centred integers beyond 64 bits take Python integers."""
    rows = [(k, [float(np.float32(c)) for c in (1e15 * (k + 1), -2e14 * k * k)], 0) for k in range(5)]
    check(spark, rows)


def test_square_sums_limbs():
    r = np.random.default_rng(3)
    for top in (5, 1 << 20, 1 << 40, 1 << 60):
        y = r.integers(-top, top, (50, 4))
        got = {}
        for i, shift, s in square_sums(y, int(top).bit_length() + 1):
            for k, v in enumerate(s):
                got[i, i + k] = got.get((i, i + k), 0) + (int(v) << shift)
        for i in range(4):
            for j in range(i, 4):
                assert got[i, j] == sum((int(a[i]) + (int(a[j]) if j > i else 0)) ** 2 for a in y)


def test_covariance_of_centred_pairs():
    x = np.array([[0, 2], [4, 2], [2, 8]])
    n, s = 3, x.sum(0)
    y = n * x - s
    q = {(0, 0): int((y[:, 0] ** 2).sum()), (1, 1): int((y[:, 1] ** 2).sum()), (0, 1): int(((y[:, 0] + y[:, 1]) ** 2).sum())}
    assert np.allclose(covariance(q, 2, n), np.cov(x.T, bias=True))


def test_quantise_ends():
    import pyarrow as pa

    rows, x = quantise(pa.array([[-0.0, 0.001, -0.001], [1e30, -1e30]], pa.list_(pa.float32())))
    assert list(rows) == [0, 1] and list(x[0]) == [0, 0, -1] and x[1][0] == np.iinfo(np.int64).max and x[1][1] == np.iinfo(np.int64).min + 1


def test_fit_list_is_distinct(spark):
    model = fit(spark.createDataFrame([(k, [0.5 * (k % 2), 1.0], 0) for k in range(40)], SCHEMA).drop("n"))
    assert model["n"] == 2 and model["dim"] == 2 and whitening.COMPONENTS == 4
