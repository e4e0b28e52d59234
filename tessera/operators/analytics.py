"""Analytics pane and view-shaping operators.

Reference lines/bands, distributions and confidence intervals are grouped
aggregates attached back to the marks.  Trend lines are closed-form least
squares from ``regr_*`` aggregates (merged map-side); the polynomial fit
gathers its power sums in one aggregate and solves the small normal
equations per group inside ``applyInPandas`` (one row per group).  The
forecast gathers each aggregated series into one row and smooths all series
of a batch together, and clustering uses ``pyspark.ml`` KMeans.
"""

from __future__ import annotations

import sys as _sys
from functools import reduce
from collections.abc import Callable, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import scan
from tessera.operators.aggregates import exact_percentiles
from tessera.operators.joins import attach_scalar

# Functions of this module run inside Python workers; pickle them by value so
# executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

Step = Callable[[DataFrame], DataFrame]


def _attach(df: DataFrame, agg: DataFrame, scope: Sequence[str]) -> DataFrame:
    if not scope:
        return attach_scalar(df, agg)
    r = agg.withColumnsRenamed({s: f"_sc_{s}" for s in scope})
    cond = None
    for s in scope:
        t = df[s].eqNullSafe(r[f"_sc_{s}"])
        cond = t if cond is None else cond & t
    return df.join(r, cond, "left").drop(*[f"_sc_{s}" for s in scope])


def mode_of(df: DataFrame, scope: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per scope (ties: the smallest value).

    Counts per (scope, value) are a partial aggregation; the pick is a
    min over (-count, value) structs per scope — no window, no group gathered.
    """
    counts = df.groupBy(*scope, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*scope).agg(F.min(F.struct((-F.col("_n")).alias("_neg"), F.col(value).alias("_v"))).alias("_b"))
    return best.select(*scope, F.col("_b._v").alias(name))


def reference_lines(value: str, scope: Sequence[str], kinds: Mapping[str, object]) -> Step:
    """Reference lines per scope (table = no scope, pane = scope columns).

    ``kinds`` maps an output name to 'avg' | 'median' | 'mode' | 'min' | 'max' |
    'sum' | ('percentile', p) | ('constant', c).
    """
    scope = list(scope)

    def step(df: DataFrame) -> DataFrame:
        simple, pcts = [], {}
        out = df
        for name, k in kinds.items():
            if isinstance(k, tuple) and k[0] == "constant":
                out = out.withColumn(name, F.lit(k[1]))
            elif isinstance(k, tuple) and k[0] == "percentile":
                pcts[name] = float(k[1])
            elif k == "median":
                pcts[name] = 0.5
            elif k == "mode":
                out = _attach(out, mode_of(df, scope, value, name), scope)
            else:
                simple.append({"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[k](value).alias(name))
        if simple:
            out = _attach(out, df.groupBy(*scope).agg(*simple), scope)
        if pcts:
            out = _attach(out, exact_percentiles(scope, value, pcts)(df), scope)
        return out
    return step


def reference_band(value: str, scope: Sequence[str], lo: float, hi: float,
                   names: tuple[str, str] = ("band_from", "band_to")) -> Step:
    """Band between two percentiles of ``value`` per scope."""
    return reference_lines(value, scope, {names[0]: ("percentile", lo), names[1]: ("percentile", hi)})


def distribution(value: str, scope: Sequence[str], ps: Sequence[float], prefix: str = "p") -> Step:
    """Percentile distribution (several percentile lines at once)."""
    return reference_lines(value, scope, {f"{prefix}{int(round(p * 100))}": ("percentile", p) for p in ps})


def confidence_interval(value: str, scope: Sequence[str], level: float = 0.95) -> Step:
    """mean +- z * s / sqrt(n) per scope at the given two-sided level."""
    z = NormalDist().inv_cdf(0.5 + level / 2)

    def step(df: DataFrame) -> DataFrame:
        agg = df.groupBy(*scope).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"),
                                     F.count(value).alias("_n"))
        half = F.lit(z) * F.col("_s") / F.sqrt(F.col("_n"))
        return agg.select(*scope, F.col("_m").alias("mean"), (F.col("_m") - half).alias("ci_low"),
                          (F.col("_m") + half).alias("ci_high"), F.col("_n").alias("n"))
    return step


# ----------------------------------------------------------------- trends

_TRANSFORMS = {
    "linear": (lambda x: x, lambda y: y, None),
    "exponential": (lambda x: x, F.ln, "y"),
    "logarithmic": (F.ln, lambda y: y, "x"),
    "power": (F.ln, F.ln, "xy"),
}


def trend(x: str, y: str, group_by: Sequence[str] = (), model: str = "linear") -> Step:
    """Least-squares trend per group: slope, intercept, R² and n.

    exponential: ln y = a + b x   (y > 0)       -> y = e^a e^(b x)
    logarithmic: y = a + b ln x  (x > 0)
    power:       ln y = a + b ln x (x, y > 0)   -> y = e^a x^b
    """
    fx, fy, positive = _TRANSFORMS[model]

    def step(df: DataFrame) -> DataFrame:
        d = df
        if positive and "x" in positive:
            d = d.filter(F.col(x) > 0)
        if positive and "y" in positive:
            d = d.filter(F.col(y) > 0)
        X, Y = fx(F.col(x)), fy(F.col(y))
        return d.groupBy(*group_by).agg(
            F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"),
            F.regr_r2(Y, X).alias("r2"), F.regr_count(Y, X).alias("n"))
    return step


def trend_polynomial(x: str, y: str, degree: int, group_by: Sequence[str] = ()) -> Step:
    """Polynomial least squares of ``degree`` per group: coefficients c0..cn.

    A first aggregate finds mean and spread of x; a second collects the power
    sums of the centred and scaled x (so they keep their precision for large x).
    The normal equations are solved batch-wise (``mapInPandas``) on that
    one-row-per-group table and expanded back to powers of x.
    """
    group_by = list(group_by)

    def step(df: DataFrame) -> DataFrame:
        X, Y = F.col(x).cast("double"), F.col(y).cast("double")
        d = df.filter(X.isNotNull() & Y.isNotNull()).select(*group_by, X.alias("_x"), Y.alias("_y"))
        shape = d.groupBy(*group_by).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
        j = _attach(d, shape, group_by)
        u = (F.col("_x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
        sums = [F.sum(F.pow(u, k)).alias(f"sx{k}") for k in range(2 * degree + 1)]
        sums += [F.sum(F.pow(u, k) * F.col("_y")).alias(f"sxy{k}") for k in range(degree + 1)]
        agg = j.groupBy(*group_by, "_m", "_s").agg(*sums)
        schema = T.StructType([f for f in agg.schema.fields if f.name in group_by]
                              + [T.StructField(f"c{k}", T.DoubleType()) for k in range(degree + 1)])

        def solve(batches):
            for pdf in batches:
                n = degree + 1
                sx = pdf[[f"sx{k}" for k in range(2 * degree + 1)]].to_numpy(float)
                b = pdf[[f"sxy{k}" for k in range(n)]].to_numpy(float)
                m, s = pdf["_m"].to_numpy(float), pdf["_s"].to_numpy(float)
                coef = np.zeros((len(pdf), n))
                for r in range(len(pdf)):
                    A = np.array([[sx[r, i + k] for k in range(n)] for i in range(n)])
                    scaled = np.polynomial.Polynomial(np.linalg.lstsq(A, b[r], rcond=None)[0])
                    s1 = s[r] if s[r] > 0 else 1.0
                    c = scaled(np.polynomial.Polynomial([-m[r] / s1, 1 / s1])).coef
                    coef[r, :len(c)] = c
                out = pdf[group_by].copy()
                for k in range(n):
                    out[f"c{k}"] = coef[:, k]
                yield out

        return agg.mapInPandas(solve, schema)
    return step


def moving_average(value: str, n: int, name: str, partition_by=None, order_by=None, skew_safe: bool | None = None) -> Step:
    """Trailing mean of the last ``n`` rows (current included)."""
    return lambda df: scan.framed(df, {name: lambda w: F.avg(value).over(w.rowsBetween(-(n - 1), 0))},
                                  partition_by, order_by, -(n - 1), 0, skew_safe=skew_safe)


# ----------------------------------------------------------------- forecast

GRID = (0.1, 0.3, 0.5, 0.7, 0.9)
MAX_PERIODS = 100_000


def smooth(y: np.ndarray, n: np.ndarray, alpha: float, beta: float | None = None, gamma: float | None = None, season: int = 0) -> dict:
    """Exponential smoothing of all series at once: level (``beta`` None), additive trend, or additive trend and season.

    ``y`` has a series a row, its first ``n`` columns.  Starts: the first value and (trend) the first difference; with
    a season the first season's mean, the mean step to the second and the first season's deviations.  Returns level,
    trend and season after the last value and the errors of the one-step fits (NaN where there is none).
    """
    rows, steps = y.shape
    err = np.full(y.shape, np.nan)
    if season:
        level = y[:, :season].mean(1)
        slope = (y[:, season:2 * season].mean(1) - level) / season
        cycle = y[:, :season] - level[:, None]
        start = season
    else:
        level = y[:, 0].copy()
        slope = np.where(n > 1, y[:, min(1, steps - 1)] - y[:, 0], 0.0) if beta is not None else np.zeros(rows)
        cycle, start = np.zeros((rows, 1)), 1
        err[:, 0] = 0.0
    m = max(season, 1)
    for t in range(start, steps):
        on = t < n
        c = cycle[:, t % m] if season else 0.0
        ahead = level + slope
        new = alpha * (y[:, t] - c) + (1 - alpha) * ahead
        err[:, t] = np.where(on, y[:, t] - ahead - c, np.nan)
        if beta is not None:
            slope = np.where(on, beta * (new - level) + (1 - beta) * slope, slope)
        level = np.where(on, new, level)
        if season:
            cycle[:, t % m] = np.where(on, gamma * (y[:, t] - new) + (1 - gamma) * c, c)
    return {"level": level, "slope": slope, "cycle": cycle, "err": err}


def find_season(y: np.ndarray, max_season: int = 24) -> int:
    """The lag (from 2, with two whole seasons in the series) of the highest peak of the autocorrelation around the series' line,
    if that is beyond chance (2 / sqrt(n)); else 0."""
    n = len(y)
    top = min(max_season, n // 2)
    if top < 2:
        return 0
    t = np.arange(n)
    d = y - np.polyval(np.polyfit(t, y, 1), t)
    var = float(d @ d)
    if var <= 1e-12 * max(float(y @ y), 1e-300):
        return 0
    r = np.array([float(d[k:] @ d[:n - k]) / var for k in range(min(top + 2, n))])
    peaks = [k for k in range(2, top + 1) if r[k] > r[k - 1] and (k + 1 >= len(r) or r[k] >= r[k + 1]) and r[k] > 2 / np.sqrt(n)]
    return max(peaks, key=lambda k: (r[k], -k), default=0)


def fill_missing(t: Sequence[int], v: Sequence[float | None], rule: str) -> np.ndarray:
    """Values of all periods from the first to the last; absent and null ones by rule: ``interpolate`` (a straight line between the
    neighbours), ``previous`` or ``zero``.  Null values before the first or after the last known one take that one."""
    if t[-1] - t[0] >= MAX_PERIODS:
        raise ValueError(f"a series spans over {MAX_PERIODS} periods")
    y = np.full(t[-1] - t[0] + 1, np.nan)
    y[np.asarray(t) - t[0]] = [np.nan if x is None else x for x in v]
    gone = np.isnan(y)
    if rule == "zero":
        return np.where(gone, 0.0, y)
    at = np.flatnonzero(~gone)
    if not len(at):
        return y[:0]
    if rule == "previous":
        return y[at[np.maximum(np.searchsorted(at, np.arange(len(y)), side="right") - 1, 0)]]
    return np.interp(np.arange(len(y)), at, y[at])


def _matrix(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in series])
    y = np.zeros((len(series), int(n.max())))
    for i, s in enumerate(series):
        y[i, :len(s)] = s
    return y, n


def _best_fit(series: list[np.ndarray], model: str, season: int | None, max_season: int, params: tuple | None) -> list[dict]:
    """For each series the fit of least AICc over the models asked for and the grid (or the given parameters)."""
    out: list[dict] = [{} for _ in series]
    lags = [(find_season(s, max_season) if season is None else season) if model in ("auto", "seasonal") else 0 for s in series]
    lags = [k if len(s) >= 2 * k else 0 for k, s in zip(lags, series)]
    fixed = lambda i: [params[i]] if params else GRID
    for lag in sorted(set(lags)):
        rows = [i for i, k in enumerate(lags) if k == lag]
        y, n = _matrix([series[i] for i in rows])
        tries = []
        if model in ("auto", "level"):
            tries += [(a, None, None, 0) for a in fixed(0)]
        if model in ("auto", "trend") or (model == "seasonal" and not lag):
            tries += [(a, b, None, 0) for a in fixed(0) for b in fixed(1)]
        if lag and model in ("auto", "seasonal"):
            tries += [(a, b, g, lag) for a in fixed(0) for b in fixed(1) for g in fixed(2)]
        best = np.full(len(rows), np.inf)
        for a, b, g, m in tries:
            f = smooth(y, n, a, b, g, m)
            e = f["err"][:, lag:]  # all models over the same periods
            k = 2 if b is None else 4 if not m else 5 + m
            count = np.maximum(n - lag, 1)
            mse = np.nansum(e * e, 1) / count
            score = count * np.log(np.maximum(mse, 1e-300)) + 2 * k + np.where(count > k + 1, 2 * k * (k + 1) / np.maximum(count - k - 1, 1), 2.0 * k * (k + 1))
            for j in np.flatnonzero(score < best - 1e-9):
                best[j] = score[j]
                last = int(n[j])
                out[rows[j]] = {"level": f["level"][j], "slope": f["slope"][j] if b is not None else 0.0,
                                "cycle": np.roll(f["cycle"][j], -(last % m)) if m else np.zeros(1), "a": a, "b": b or 0.0, "season": m,
                                "sigma": float(np.sqrt(np.nansum(e[j] ** 2) / max(count[j] - 1, 1)))}
    return out


def forecast(group_by: Sequence[str], time_col: str, value: str, periods: int, interval: float = 0.95,
             ignore_last: int = 0, model: str = "auto", periods_back: int = 0, season: int | None = None, max_season: int = 24,
             missing: str = "interpolate", params: tuple | None = None) -> Step:
    """Forecast ``periods`` steps per series by exponential smoothing: ``model`` ``level``, ``trend`` (additive), ``seasonal``
    (additive trend and season) or the best of them (``auto``) by corrected AIC over a fixed grid of parameters.

    Input is the aggregated series: one row per (group, period) with integer periods in ``time_col``; of several rows of a
    period one would be lost, so that is an error.  Absent periods and null values are filled by ``missing``
    (``interpolate``, ``previous`` or ``zero``).  ``season`` is the season's length; by default it is found by
    autocorrelation, up to ``max_season``; without one ``seasonal`` falls back to ``trend``.  ``params`` fixes
    (alpha, beta, gamma).  ``ignore_last`` periods are left out; ``periods_back`` steps before the first are forecast
    from the series in reverse.  All series of a batch are smoothed together, as one matrix.

    Output: group, period, forecast, low, high (prediction interval from the in-sample residual spread, widening with
    the horizon).  A series without known values gives no rows; null periods are left out; null groups are a group.
    """
    group_by = list(group_by)
    z = NormalDist().inv_cdf(0.5 + interval / 2)

    def step(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(time_col).isNotNull()).groupBy(*group_by).agg(F.array_sort(F.collect_list(F.struct(
            F.col(time_col).cast("long").alias("t"), F.col(value).cast("double").alias("v")))).alias("_s"))
        src = rows.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group_by)], F.col("_s.t").alias("t"), F.col("_s.v").alias("v"))
        schema = T.StructType([*[df.schema[g] for g in group_by], T.StructField(time_col, T.LongType()),
                               *[T.StructField(c, T.DoubleType()) for c in ("forecast", "low", "high")]])
        k_groups = len(group_by)

        def steps(fit: dict, count: int, first: int, sign: int) -> list[tuple]:
            out = []
            for h in range(1, count + 1):
                f = fit["level"] + h * fit["slope"] + fit["cycle"][(h - 1) % len(fit["cycle"])]
                width = z * fit["sigma"] * np.sqrt(1 + (h - 1) * fit["a"] ** 2 * (1 + h * fit["b"]) ** 2)
                out.append((first + sign * h, float(f), float(f - width), float(f + width)))
            return out

        def run(batches):
            for batch in batches:
                at, starts, series = [], [], []
                for i, (t, v) in enumerate(zip(batch.column(k_groups).to_pylist(), batch.column(k_groups + 1).to_pylist())):
                    if len(set(t)) < len(t):
                        raise ValueError("forecast needs one row per group and period")
                    y = fill_missing(t, v, missing) if t else np.zeros(0)
                    y = y[:max(len(y) - ignore_last, 0)]
                    if len(y):
                        at.append(i)
                        starts.append(t[0])
                        series.append(y)
                if not series:
                    continue
                out: list[list[tuple]] = [[] for _ in series]
                if periods_back:
                    for o, fit, first in zip(out, _best_fit([s[::-1] for s in series], model, season, max_season, params), starts):
                        o += steps(fit, periods_back, first, -1)
                for o, fit, first, s in zip(out, _best_fit(series, model, season, max_season, params), starts, series):
                    o += steps(fit, periods, first + len(s) - 1, 1)
                pick = pa.array(np.repeat(at, [len(o) for o in out]), pa.int64())
                flat = [r for o in out for r in o]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(pick) for k in range(k_groups)], pa.array([r[0] for r in flat], pa.int64()),
                     *[pa.array([r[k] for r in flat], pa.float64()) for k in (1, 2, 3)]], names=schema.names)

        return src.mapInArrow(run, schema)
    return step


# ----------------------------------------------------------------- clustering

def cluster(features: Sequence[str] | str, k: int | None = None, seed: int = 42, k_range: Sequence[int] = range(2, 7),
            name: str = "cluster", max_iter: int = 20) -> Step:
    """K-means on standardised features (``pyspark.ml``); ``k=None`` picks k by
    the silhouette score over ``k_range``.  ``features`` may be numeric columns
    or one array column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector

    def step(df: DataFrame) -> DataFrame:
        # Rows with a null or NaN feature cannot be placed: they stay, without a cluster.
        names = [features] if isinstance(features, str) else list(features)
        number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
        whole = (F.col(features).isNotNull() & F.forall(features, number)) if isinstance(features, str) else \
            reduce(lambda p, q: p & q, [number(F.col(n)) for n in names])
        apart = df.filter(~whole)
        df = df.filter(whole)
        if isinstance(features, str):
            d = df.withColumn("_raw", array_to_vector(F.col(features).cast("array<double>")))
            stages = []
        else:
            d = df
            stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error")]
        stages.append(StandardScaler(inputCol="_raw", outputCol="_feat", withMean=True, withStd=True))
        prep = Pipeline(stages=stages).fit(d)
        # The search fits and scores several k on the same features: keep them
        # (memory and disk; recomputed from lineage if an executor is lost).
        feat = prep.transform(d).persist(StorageLevel.MEMORY_AND_DISK)
        candidates = [k] if k else list(k_range)
        best = None
        try:
            for kk in candidates:
                model = KMeans(k=kk, seed=seed, featuresCol="_feat", predictionCol=name, maxIter=max_iter).fit(feat)
                score = (ClusteringEvaluator(featuresCol="_feat", predictionCol=name).evaluate(model.transform(feat))
                         if not k else 0.0)
                if best is None or score > best[0]:
                    best = (score, model)
        finally:
            feat.unpersist()
        out = best[1].transform(prep.transform(d))
        out = out.drop("_raw", "_feat")
        return out.unionByName(apart.withColumn(name, F.lit(None).cast(out.schema[name].dataType)))
    return step


def nearest_centre(features: str, centres: Sequence[Sequence[float]], name: str = "cluster", distance: str | None = None) -> Step:
    """The number (from 0) of the nearest of the given centres to an array column, by squared Euclidean distance; ties go to the
    first.  Null vectors, null or NaN entries and vectors of another length give null."""
    def step(df: DataFrame) -> DataFrame:
        x = F.col(features).cast("array<double>")
        whole = (F.size(x) == len(centres[0])) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
        far = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
               for c in centres]
        best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))
        out = df.withColumn("_tsr_near", F.when(whole, best))
        if distance:
            out = out.withColumn(distance, F.col("_tsr_near.d"))
        return out.withColumn(name, F.col("_tsr_near.i")).drop("_tsr_near")
    return step


# ----------------------------------------------------------------- view shapes

def histogram(value: str, size: float, name: str = "bin") -> Step:
    return lambda df: df.groupBy((F.floor(F.col(value) / size) * size).alias(name)).agg(
        F.count(F.lit(1)).alias("count"))


def box_plot(value: str, scope: Sequence[str]) -> Step:
    """Five-number summary (exact, skew-safe) and the 1.5 IQR whisker limits."""
    def step(df: DataFrame) -> DataFrame:
        q = exact_percentiles(scope, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})(df)
        iqr = F.col("q3") - F.col("q1")
        return q.withColumns({"whisker_low": F.greatest(F.col("min"), F.col("q1") - 1.5 * iqr),
                              "whisker_high": F.least(F.col("max"), F.col("q3") + 1.5 * iqr)})
    return step


def pareto(dim: str, measure: Column, name: str = "cumulative_share") -> Step:
    """Members sorted by a measure with the cumulative share of the total."""
    def step(df: DataFrame) -> DataFrame:
        agg = df.groupBy(dim).agg(measure.alias("value"))
        run = scan.running(agg, "value", None, [("value", "desc"), (dim, "asc")], aggs=("sum",), prefix="_p_")
        tot = agg.agg(F.sum("value").alias("_total"))
        out = attach_scalar(run, tot)
        return out.withColumn(name, F.try_divide(F.col("_p_sum"), F.col("_total"))).drop("_p_sum", "_total")
    return step


def waterfall(value: str, order_by, partition_by=None) -> Step:
    """Start and end of each step of a running total."""
    def step(df: DataFrame) -> DataFrame:
        run = scan.running(df, value, partition_by, order_by, aggs=("sum",), prefix="_w_")
        return run.withColumns({"step_end": F.col("_w_sum"), "step_start": F.col("_w_sum") - F.col(value)}) \
            .drop("_w_sum")
    return step


def sparkline(entity: Sequence[str], period: Column, value: Column, name: str = "series") -> Step:
    """Ordered (period, value) series per entity.

    Aggregated to one value per (entity, period) first, so an entity's array
    has at most one element per period whatever the number of raw rows.
    """
    def step(df: DataFrame) -> DataFrame:
        per = df.groupBy(*entity, period.alias("_period")).agg(value.alias("_v"))
        return per.groupBy(*entity).agg(F.array_sort(F.collect_list(
            F.struct(F.col("_period").alias("period"), F.col("_v").alias("value")))).alias(name))
    return step


def calendar_heatmap(date_col: str, measure: Column) -> Step:
    """Measure by week of year (rows) x weekday 1..7 (columns, Sunday = 1)."""
    from tessera.functions.dates import week

    def step(df: DataFrame) -> DataFrame:
        d = df.withColumns({"year": F.year(date_col), "week": week(date_col), "_wd": F.dayofweek(date_col)})
        return d.groupBy("year", "week").pivot("_wd", list(range(1, 8))).agg(measure)
    return step
