"""Half-open and distinct frames and recurrences against plain Python, in both plans."""

from __future__ import annotations

import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import carry, scan
from tessera.operators import tablecalc as tc


def table(spark, n=120, seed=3, empty=False):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), k, r.choice([None, *range(-4, 12)]), r.choice([None, 1.5, 2.0, 7.25, -3.0]), "x" * 5)
            for k in range(0 if empty else n)]
    return rows, spark.createDataFrame(rows, "g string, o int, x int, y double, spare string")


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


@pytest.fixture(params=[False, True], ids=["plain", "segmented"])
def skew(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(scan, "_num_segments", lambda df, n: n or 5)
    return request.param


def plain_stat(agg, items):
    """Aggregate of (x, y) pairs of a frame."""
    xs = [x for x, _ in items if x is not None]
    if agg == "count":
        return len(xs)
    if agg == "countd":
        return len(set(xs))
    if agg in ("corr", "covar", "covarp"):
        both = [(x, y) for x, y in items if x is not None and y is not None]
        n = len(both)
        if not n:
            return None
        mx, my = sum(x for x, _ in both) / n, sum(y for _, y in both) / n
        c, sx, sy = (sum((a[i] - (mx, my)[i]) * (a[j] - (mx, my)[j]) for a in both) for i, j in ((0, 1), (0, 0), (1, 1)))
        if agg == "corr":
            return c / math.sqrt(sx * sy) if sx > 1e-12 and sy > 1e-12 else None
        return c / n if agg == "covarp" else c / (n - 1) if n > 1 else None
    if not xs:
        return None
    if agg in ("var", "stdev") and len(xs) < 2:
        return None
    return {"sum": sum, "avg": statistics.fmean, "min": min, "max": max, "var": statistics.variance, "varp": statistics.pvariance,
            "stdev": statistics.stdev, "stdevp": statistics.pstdev}[agg](xs)


FRAMES = [(None, 0), (None, -2), (None, 3), (0, None), (-3, None), (2, None), (None, 500), (500, None)]
ALL = ["sum", "avg", "min", "max", "count", "var", "varp", "stdev", "stdevp", "corr", "covar", "covarp", "countd"]


@pytest.mark.parametrize("agg", ALL)
def test_half_open_frames(spark, skew, agg):
    rows, df = table(spark)
    frames = {"sum": FRAMES[1:5], "countd": [*FRAMES[1:6:2], (-2, 1), (1, 3), (2, 1)]}.get(agg, [FRAMES[ALL.index(agg) % len(FRAMES)]])
    for first, last in frames:
        out = df.transform(tc.window(agg, "x", "w", "g", "o", first, last, y="y", skew_safe=skew))
        assert out.columns == [*df.columns, "w"]
        got = {(r.g, r.o): r.w for r in out.collect()}
        assert len(got) == len(rows)
        for items in groups(rows).values():
            for i, r in enumerate(items):
                lo = 0 if first is None else max(0, i + first)
                hi = len(items) if last is None else max(0, min(len(items), i + last + 1))
                want = plain_stat(agg, [(a[2], a[3]) for a in items[lo:hi]])
                assert (got[r[0], r[1]] is None) == (want is None), (agg, first, last, r)
                assert want is None or got[r[0], r[1]] == pytest.approx(want, rel=1e-9, abs=1e-9), (agg, first, last, r)


def test_moments_do_not_cancel(spark, skew):
    """Values far from zero, in a trend: the first rows' variance is tiny against their distance from the mean."""
    df = spark.range(400).select((F.lit(1e9) + F.pow("id", 3)).alias("x"), "id")
    out = df.transform(tc.window("varp", "x", "w", None, "id", None, 0, skew_safe=skew)).orderBy("id").collect()
    for n in (2, 5, 100, 400):
        assert out[n - 1].w == pytest.approx(statistics.pvariance([k**3 for k in range(n)]), rel=1e-6)


def plain_recurrence(items, seed, rate, flow, lower, upper):
    x, out = None, []
    for r in items:
        a, b = rate(r), flow(r)
        p = seed(r) if x is None else x
        x = None if a is None or b is None or p is None else min(upper, max(lower, p * a + b))
        out.append(x)
    return out


def test_recurrence(spark, skew):
    rows, df = table(spark, 150)
    cases = [
        (dict(seed=10, flow=F.col("x")), (lambda r: 10, lambda r: 1, lambda r: r[2], -math.inf, math.inf)),
        (dict(seed=100.0, rate=0.9, flow=F.col("y"), lower=0, upper=40), (lambda r: 100, lambda r: 0.9, lambda r: r[3], 0, 40)),
        (dict(seed=F.col("y"), rate=F.col("x") / 4, flow=1.0, lower=-5, upper=5),
         (lambda r: r[3], lambda r: None if r[2] is None else r[2] / 4, lambda r: 1, -5, 5)),
    ]
    for kw, (seed, rate, flow, lower, upper) in cases:
        out = df.transform(tc.recurrence("v", partition_by="g", order_by="o", skew_safe=skew, **kw))
        assert out.columns == [*df.columns, "v"]
        got = {(r.g, r.o): r.v for r in out.collect()}
        for items in groups(rows).values():
            for r, want in zip(items, plain_recurrence(items, seed, rate, flow, lower, upper)):
                assert (got[r[0], r[1]] is None) == (want is None), (kw, r)
                assert want is None or got[r[0], r[1]] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_composed_maps():
    """Composition equals doing one after the other, at missing states and bounds too."""
    r = random.Random(1)
    one = lambda: (None, None, -1.0, 1.0, None) if r.random() < 0.2 else (
        r.choice([-2.0, -0.5, 0.0, 0.5, 1.0, 3.0]), r.uniform(-3, 3), r.choice([-math.inf, -1.0]), r.choice([math.inf, 2.0]), r.choice([None, r.uniform(-1, 2)]))
    for _ in range(3000):
        f, g, h = one(), one(), one()
        for x in (None, -7.0, 0.0, 0.3, 9.0):
            want = carry._apply(h, carry._apply(g, carry._apply(f, x)))
            got = carry._apply(carry._then(carry._then(f, g), h), x)
            assert (got is None) == (want is None) and (want is None or got == pytest.approx(want, abs=1e-9))


def test_ties_empty_table_and_overflow(spark, skew):
    _, empty = table(spark, empty=True)
    assert empty.transform(tc.recurrence("v", 1, partition_by="g", order_by="o", skew_safe=skew)).count() == 0
    for agg in ("countd", "var", "sum"):
        assert empty.transform(tc.window(agg, "x", "w", "g", "o", None, 1, skew_safe=skew)).count() == 0
    ties = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 5)], "o int, x int")
    assert sorted(r.v for r in ties.transform(tc.recurrence("v", 0, flow=F.col("x"), order_by="o", skew_safe=skew)).collect()) == [5, 10, 15, 20]
    assert sorted(r.w for r in ties.transform(tc.window("countd", "x", "w", None, "o", -1, 0, skew_safe=skew)).collect()) == [1] * 4
    with pytest.raises(ValueError):
        ties.transform(tc.window("median", "x", "w", None, "o", None, 0))
    with pytest.raises(ArithmeticError):
        carry._then((1e300, 0.0, -math.inf, math.inf, 0.0), (1e300, 0.0, -math.inf, math.inf, 0.0))


def test_countd_looks_back_over_blocks(spark, monkeypatch):
    """Hot and rare values, nulls and a null group: blocks of any size, and no full sort of a value's rows by segments."""
    monkeypatch.setattr(tc, "OCCURRENCES", 7, raising=False)
    rows = [(g, o, (None, 1, 1, 1, o % 5, o % 23)[(o * o + (g or 0)) % 6]) for g in (1, 2, None) for o in range(90)]
    df = spark.createDataFrame(rows, "g int, o int, x int")
    for first, last in ((-20, 5), (None, 0), (-1, None)):
        out = df.transform(tc.window("countd", "x", "w", "g", "o", first, last, skew_safe=True))
        plain = df.transform(tc.window("countd", "x", "w", "g", "o", first, last, skew_safe=False))
        key = lambda r: (r.g or 0, r.o)
        got = sorted(out.collect(), key=key)
        assert got == sorted(plain.collect(), key=key)
        for r in got:
            lo, hi = 0 if first is None else r.o + first, 89 if last is None else r.o + last
            assert r.w == len({x for g, o, x in rows if g == r.g and lo <= o <= hi and x is not None})
    seen = df.where("x is not null").select("g", F.col("x").alias("_tsr_v"), F.col("o").cast("long").alias("_tsr_p"))
    plan = tc._previous(seen, ["g", "_tsr_v"], True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "rangepartitioning" not in plan
