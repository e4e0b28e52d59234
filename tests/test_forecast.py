"""Forecasts against plain recursions, seasons, gaps, and sketches that roll up."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import analytics as AN


def plain_smooth(y, alpha, beta=None, gamma=None, m=0):
    """One series, step by step: forecasts one ahead of the end."""
    if m:
        level = sum(y[:m]) / m
        slope = (sum(y[m:2 * m]) / m - level) / m
        season = [v - level for v in y[:m]]
    else:
        level, slope, season = y[0], (y[1] - y[0] if beta is not None and len(y) > 1 else 0.0), [0.0]
    err = []
    for t in range(m or 1, len(y)):
        c = season[t % m] if m else 0.0
        err.append(y[t] - level - slope - c)
        new = alpha * (y[t] - c) + (1 - alpha) * (level + slope)
        if beta is not None:
            slope = beta * (new - level) + (1 - beta) * slope
        level = new
        if m:
            season[t % m] = gamma * (y[t] - new) + (1 - gamma) * c
    return level, slope, season, err


def test_all_series_of_a_batch_at_once():
    r = np.random.default_rng(1)
    series = [r.normal(10, 3, n) for n in (30, 17, 24, 9, 1)]
    y, n = AN._matrix(series)
    for beta, gamma, m in [(None, None, 0), (0.3, None, 0), (0.3, 0.4, 4)]:
        use = [i for i in range(5) if len(series[i]) >= 2 * m]
        got = AN.smooth(y[use], n[use], 0.6, beta, gamma, m)
        for j, i in enumerate(use):
            level, slope, season, err = plain_smooth(list(series[i]), 0.6, beta, gamma, m)
            assert got["level"][j] == pytest.approx(level) and got["slope"][j] == pytest.approx(slope)
            assert np.allclose(got["err"][j][m or 1:len(series[i])], err) and np.isnan(got["err"][j][len(series[i]):]).all()
            if m:
                assert got["cycle"][j] == pytest.approx(season)


def test_season_by_autocorrelation():
    t = np.arange(60)
    assert AN.find_season(5 + 0.3 * t + 4 * np.sin(2 * np.pi * t / 12)) == 12
    assert AN.find_season(np.tile([1.0, 5, 2, 9], 8)) == 4
    assert AN.find_season(3.0 + 2 * t) == 0 and AN.find_season(np.ones(40)) == 0 and AN.find_season(np.array([1.0, 2])) == 0
    assert AN.find_season(np.random.default_rng(0).normal(size=300), 6) == 0


def test_gaps_are_filled_by_rule():
    t, v = [1, 2, 3, 10, 11], [1.0, None, 3.0, 10.0, 11.0]
    assert list(AN.fill_missing(t, v, "interpolate")) == list(range(1, 12))
    assert list(AN.fill_missing(t, v, "previous")) == [1, 1, 3, 3, 3, 3, 3, 3, 3, 10, 11]
    assert list(AN.fill_missing(t, v, "zero")) == [1, 0, 3, 0, 0, 0, 0, 0, 0, 10, 11]
    assert len(AN.fill_missing([4], [None], "interpolate")) == 0 and list(AN.fill_missing([4, 5], [None, 2.0], "previous")) == [2, 2]
    with pytest.raises(ValueError):
        AN.fill_missing([0, 10**6], [1.0, 1.0], "zero")


def test_forecast_models(spark):
    season = [10.0, -5.0, 3.0, -8.0]
    rows = [("s", t, 50 + 2.0 * t + season[t % 4]) for t in range(32)] + [("l", t, 7.0 * t) for t in (1, 2, 3, 10, 11)] + [
        (None, t, 4.0) for t in range(6)] + [("one", 5, 3.0), ("void", 1, None), ("t", None, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.t): r for r in AN.forecast(["k"], "t", "v", periods=4, periods_back=2)(df).collect()}
    for t in (32, 33, 34, 35, -1, -2):
        assert got["s", t].forecast == pytest.approx(50 + 2.0 * t + season[t % 4], abs=0.2)
    assert [got["l", t].forecast for t in (12, 13, 0)] == pytest.approx([84, 91, 0], abs=1e-6)
    assert [got[None, t].forecast for t in (6, 9, -1)] == pytest.approx([4, 4, 4]) and got["one", 6].forecast == 3.0
    assert {k for k, _ in got} == {"s", "l", None, "one"} and all(r.low <= r.forecast <= r.high for r in got.values())
    whole = AN.forecast([], "t", "v", 1, ignore_last=2, model="level", params=(1.0, None, None))(df.where("k = 's'")).collect()
    assert [(r.t, r.forecast) for r in whole] == [(30, 50 + 2.0 * 29 + season[1])]
    with pytest.raises(Exception, match="one row per group and period"):
        AN.forecast([], "t", "v", 1)(df.union(df)).collect()
    assert AN.forecast(["k"], "t", "v", 2)(df.limit(0)).count() == 0


def test_nearest_centre(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [2.5, 3.0]), (4, None), (5, [None, 1.0]), (6, [math.nan, 0.0]), (7, [1.0])], "id int, e array<double>")
    out = {r.id: (r.cluster, r.d) for r in AN.nearest_centre("e", [[0.0, 1.0], [5.0, 5.0]], distance="d")(df).collect()}
    assert out == {1: (0, 0.0), 2: (1, 0.0), 3: (0, 10.25), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_countd_sketches_roll_up(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 5000).alias("user"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    days = df.groupBy("day", "g").agg(A.countd_sketch("user").alias("s"))
    total = days.agg(A.countd_of("s").alias("n")).first().n
    assert abs(total - 5000) <= 1 + 0.065 * 5000
    # A refreshed period replaces its sketch.
    redone = days.where("day <> 0").unionByName(df.where("day = 0 and user < 10").groupBy("day", "g").agg(A.countd_sketch("user").alias("s")))
    exact = df.where("day <> 0 or user < 10").agg(F.count_distinct("user").alias("n")).first().n
    assert abs(redone.agg(A.countd_of("s").alias("n")).first().n - exact) <= 1 + 0.065 * exact
    none = spark.createDataFrame([(1, None)], "g int, user long").groupBy("g").agg(A.countd_sketch("user").alias("s"))
    assert none.agg(A.countd_of("s").alias("n")).first().n == 0 and days.limit(0).agg(A.countd_of("s").alias("n")).first().n == 0
