"""Table calculations over an aggregated view.

Addressing = ``order_by``, partitioning = ``partition_by``.  Whole-partition
results (WINDOW_x without a frame, SIZE, TOTAL, percent of total) are a
grouped aggregate joined back; running results and ranks use the segmented
scans of :mod:`tessera.operators.scan`; bounded frames and offsets use
``scan.framed``.  No step sends a whole partition (or the whole view) to one
task unless ``skew_safe=False`` is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import carry, scan
from tessera.operators.aggregates import exact_percentiles
from tessera.operators.joins import attach_scalar
from tessera.operators.sizing import resolve_skew_safe
from tessera.session import stored

Step = Callable[[DataFrame], DataFrame]

# WINDOW_/RUNNING_ aggregate names and their Spark functions.
_AGGS: dict[str, Callable[..., Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}
_PAIR_AGGS = {"corr": F.corr, "covar": F.covar_samp, "covarp": F.covar_pop}


def _names(x) -> list[str]:
    return [] if x is None else ([x] if isinstance(x, str) else list(x))


def _attach_partition_agg(df: DataFrame, parts: list[str], aggs: list[Column]) -> DataFrame:
    agg = df.groupBy(*parts).agg(*aggs)
    if not parts:
        return attach_scalar(df, agg)
    r = agg.withColumnsRenamed({p: f"_tc_{p}" for p in parts})
    cond = None
    for p in parts:
        t = df[p].eqNullSafe(r[f"_tc_{p}"])
        cond = t if cond is None else cond & t
    return df.join(r, cond, "left").drop(*[f"_tc_{p}" for p in parts])


# ----------------------------------------------------------------- running

def running(agg: str, value: str, name: str, partition_by=None, order_by=None, skew_safe: bool | None = None) -> Step:
    """RUNNING_SUM / _AVG / _COUNT / _MIN / _MAX along the address."""
    def step(df: DataFrame) -> DataFrame:
        out = scan.running(df, value, partition_by, order_by, aggs=(agg,), prefix="_run_", skew_safe=skew_safe)
        return out.withColumnRenamed(f"_run_{agg}", name)
    return step


def running_countd(value: str, name: str, partition_by=None, order_by=None, skew_safe: bool | None = None) -> Step:
    """Running COUNTD: flag each value's first occurrence, running-sum the flags."""
    def step(df: DataFrame) -> DataFrame:
        parts = _names(partition_by)
        first = scan.row_index(df, "_occ", partition_by=parts + [value], order_by=order_by, skew_safe=skew_safe)
        flagged = first.withColumn("_first", F.when((F.col("_occ") == 1) & F.col(value).isNotNull(), 1).otherwise(0))
        out = scan.running(flagged, "_first", parts, order_by, aggs=("sum",), prefix="_rc_", skew_safe=skew_safe)
        return out.withColumn(name, F.col("_rc_sum").cast("long")).drop("_occ", "_first", "_rc_sum")
    return step


# ----------------------------------------------------------------- window

def window(agg: str, value: str, name: str, partition_by=None, order_by=None,
           first: int | None = None, last: int | None = None, y: str | None = None,
           skew_safe: bool | None = None) -> Step:
    """WINDOW_<agg>(value[, first, last]): the whole partition, or a row frame
    ``first..last`` relative to the current row.  With ``last`` alone the frame
    runs from FIRST() to ``last``, with ``first`` alone from ``first`` to LAST().
    ``corr``/``covar``/``covarp`` take a second column ``y``; ``median`` and
    ``percentile_<p>`` are exact and take bounded frames or the whole partition;
    ``countd`` counts distinct non-null values in any frame."""
    parts = _names(partition_by)
    percentile = agg == "median" or agg.startswith("percentile_")

    def agg_col():
        if agg in _PAIR_AGGS:
            return _PAIR_AGGS[agg](value, y)
        if agg == "median":
            return F.percentile(F.col(value), 0.5)
        if agg.startswith("percentile_"):
            return F.percentile(F.col(value), float(agg.split("_", 1)[1]))
        if agg == "countd":
            return F.count_distinct(F.col(value))
        return _AGGS[agg](value)

    def step(df: DataFrame) -> DataFrame:
        if first is None and last is None:
            if percentile:
                p = 0.5 if agg == "median" else float(agg.split("_", 1)[1])
                pct = exact_percentiles(parts, value, {name: p})(df)
                if not parts:
                    return attach_scalar(df, pct)
                return _join_back(df, pct, parts)
            return _attach_partition_agg(df, parts, [agg_col().alias(name)])
        if agg == "countd":
            return _framed_countd(df, value, name, parts, order_by, first, last, skew_safe)
        if first is None or last is None:
            if percentile:
                raise ValueError("WINDOW_MEDIAN and WINDOW_PERCENTILE take a bounded frame or the whole partition")
            return _half_open(df, agg, value, y, name, parts, order_by, first, last, skew_safe)
        return scan.framed(df, {name: lambda w: agg_col().over(w.rowsBetween(first, last))},
                           parts, order_by, first, last, skew_safe=skew_safe)
    return step


def _half_open(df: DataFrame, agg: str, value: str, y: str | None, name: str, parts: list[str], order_by, first: int | None,
               last: int | None, skew_safe: bool | None) -> DataFrame:
    """Frames FIRST()..last and first..LAST(): a running aggregate (of the reversed order for the second), read ``last``
    rows further on; past the end of the partition it is the partition's own."""
    skew_safe = resolve_skew_safe(df, skew_safe)
    out = scan.row_index(df, "_tsr_p", parts, order_by, skew_safe=skew_safe)
    order, k = ("_tsr_p", last) if first is None else (("_tsr_p", "desc"), -first)
    moments = agg not in ("sum", "avg", "min", "max", "count")
    if moments:
        out = carry.running_moments(out, value, y if agg in _PAIR_AGGS else None, parts, order, prefix="_tsr_m_", skew_safe=skew_safe)
        out = out.withColumn("_tsr_r", carry.statistic(agg, "_tsr_m_"))
    else:
        out = scan.running(out, value, parts, order, aggs=(agg,), prefix="_tsr_r_", skew_safe=skew_safe).withColumnRenamed(f"_tsr_r_{agg}", "_tsr_r")
    got = F.col("_tsr_r")
    if k:
        shift = (lambda w: F.lag("_tsr_r", -k).over(w)) if k < 0 else (lambda w: F.lead("_tsr_r", k).over(w))
        out = scan.framed(out, {"_tsr_s": shift}, parts, order, min(k, 0), max(k, 0), skew_safe=skew_safe)
        got = F.col("_tsr_s")
    if k > 0:
        # The last k rows of the order see the whole partition: the running value of its last row.
        n = F.count(F.lit(1)).alias("_tsr_n")
        end = F.max_by("_tsr_r", "_tsr_p") if first is None else F.min_by("_tsr_r", "_tsr_p")
        out = stored(out, "frames")
        out = _attach_partition_agg(out, parts, [n, end.alias("_tsr_e")])
        place = F.col("_tsr_p") if first is None else F.col("_tsr_n") + 1 - F.col("_tsr_p")
        got = F.when(place + k > F.col("_tsr_n"), F.col("_tsr_e")).otherwise(got)
    if agg == "count":
        got = F.coalesce(got, F.lit(0))  # an empty frame
    return out.withColumn(name, got).drop("_tsr_p", "_tsr_r", "_tsr_s", "_tsr_n", "_tsr_e", *[f"_tsr_m_{c}" for c in carry.TWO])


# Positions of a block: within one, a group's rows are ordered in one task.
OCCURRENCES = 1 << 20


def _previous(seen: DataFrame, keys: list[str], skew_safe: bool) -> DataFrame:
    """``_tsr_q``: the position of the group's row before, for rows with distinct positions ``_tsr_p``.  A group is ordered
    within blocks of positions; of each block its first row looks back to the last row of an earlier one, and first and
    last rows are an aggregate, so nothing is joined and no group is one task's work."""
    lag = lambda w: F.lag("_tsr_p", 1).over(w)
    if not skew_safe:
        return seen.withColumn("_tsr_q", lag(Window.partitionBy(*keys).orderBy("_tsr_p")))
    cut = seen.withColumn("_tsr_b", F.floor(F.col("_tsr_p") / OCCURRENCES))
    inner = cut.withColumn("_tsr_q", lag(Window.partitionBy(*keys, "_tsr_b").orderBy("_tsr_p"))).where(F.col("_tsr_q").isNotNull())
    ends = cut.groupBy(*keys, "_tsr_b").agg(F.min("_tsr_p").alias("_tsr_p"), F.max("_tsr_p").alias("_tsr_z"))
    first = ends.withColumn("_tsr_q", F.lag("_tsr_z", 1).over(Window.partitionBy(*keys).orderBy("_tsr_b")))
    cols = [*keys, "_tsr_p", "_tsr_q"]
    return inner.select(*cols).unionByName(first.select(*cols))


def _framed_countd(df: DataFrame, value: str, name: str, parts: list[str], order_by, first: int | None, last: int | None,
                   skew_safe: bool | None) -> DataFrame:
    """COUNTD over a frame: each row is its value's first one in the frames of an interval of rows, which starts after the
    frames that still hold the previous occurrence; +1 and -1 at the interval's ends, and a running sum of those."""
    skew_safe = resolve_skew_safe(df, skew_safe)
    # Cutting into segments measures, samples and then reads its input: each input is made once, and stored.
    once = (lambda x: stored(x, "addressed")) if skew_safe else (lambda x: x)
    df = once(df)
    # Numbered once and stored: both uses see the same numbers, whatever the ties.
    rows = stored(scan.row_index(df, "_tsr_p", parts, order_by, skew_safe=skew_safe), "frames")
    seen = rows.where(F.col(value).isNotNull()).select(*parts, F.col(value).alias("_tsr_v"), "_tsr_p")
    seen = _previous(seen, [*parts, "_tsr_v"], skew_safe)
    p, q = F.col("_tsr_p"), F.col("_tsr_q")
    # With FIRST() a frame holds every earlier occurrence, with LAST() every later one.
    start = F.lit(1) if last is None else p - last
    if first is not None:
        start = F.greatest(start, F.coalesce(q - first + 1, F.lit(1)))
        ends = F.array(F.struct(F.greatest(start, F.lit(1)).alias("at"), F.lit(1).alias("d")), F.struct((p - first + 1).alias("at"), F.lit(-1).alias("d")))
        live = F.greatest(start, F.lit(1)) <= p - first
    else:
        ends = F.array(F.struct(F.greatest(start, F.lit(1)).alias("at"), F.lit(1).alias("d")))
        live = q.isNull()
    events = (seen.where(live).select(*parts, F.explode(ends).alias("_tsr_x")).groupBy(*parts, F.col("_tsr_x.at").alias("_tsr_p"))
              .agg(F.sum("_tsr_x.d").alias("_tsr_d")))
    out = scan._null_safe_join(rows, events, [*parts, "_tsr_p"]).withColumn("_tsr_d", F.coalesce("_tsr_d", F.lit(0)))
    out = scan.running(once(out), "_tsr_d", parts, "_tsr_p", aggs=("sum",), prefix="_tsr_r_", skew_safe=skew_safe)
    return out.withColumn(name, F.col("_tsr_r_sum").cast("long")).drop("_tsr_p", "_tsr_d", "_tsr_r_sum")


def _join_back(df: DataFrame, agg: DataFrame, parts: list[str]) -> DataFrame:
    r = agg.withColumnsRenamed({p: f"_tc_{p}" for p in parts})
    cond = None
    for p in parts:
        t = df[p].eqNullSafe(r[f"_tc_{p}"])
        cond = t if cond is None else cond & t
    return df.join(r, cond, "left").drop(*[f"_tc_{p}" for p in parts])


# ----------------------------------------------------------------- ranks

def rank(value: str, name: str, partition_by=None, ascending: bool = False, kind: str = "rank",
         tie_breakers: Sequence[str] = (), skew_safe: bool | None = None) -> Step:
    """RANK (competition), RANK_DENSE, RANK_MODIFIED, RANK_PERCENTILE, RANK_UNIQUE.

    Descending by default.  ``unique`` breaks ties by ``tie_breakers``.
    """
    def step(df: DataFrame) -> DataFrame:
        if kind == "unique":
            o = (value, "asc" if ascending else "desc")
            return scan.row_index(df, name, partition_by, [o, *tie_breakers], skew_safe=skew_safe)
        k = {"rank": "rank", "dense": "dense", "modified": "modified", "percentile": "percentile"}[kind]
        out = scan.ranks(df, value, partition_by, ascending, kinds=(k,), prefix="_rk_", skew_safe=skew_safe)
        return out.withColumnRenamed(f"_rk_{k}", name)
    return step


# ----------------------------------------------------------------- position

def index(name: str, partition_by=None, order_by=None, skew_safe: bool | None = None) -> Step:
    """INDEX(): 1-based position along the address."""
    return lambda df: scan.row_index(df, name, partition_by, order_by, skew_safe=skew_safe)


def size(name: str, partition_by=None) -> Step:
    """SIZE(): rows in the partition."""
    parts = _names(partition_by)
    return lambda df: _attach_partition_agg(df, parts, [F.count(F.lit(1)).alias(name)])


def first(name: str, partition_by=None, order_by=None, skew_safe: bool | None = None) -> Step:
    """FIRST(): offset from the current row to the first row (0, -1, -2, ...)."""
    def step(df: DataFrame) -> DataFrame:
        out = scan.row_index(df, "_idx", partition_by, order_by, skew_safe=skew_safe)
        return out.withColumn(name, (1 - F.col("_idx")).cast("long")).drop("_idx")
    return step


def last(name: str, partition_by=None, order_by=None, skew_safe: bool | None = None) -> Step:
    """LAST(): rows from the current row to the last row (..., 2, 1, 0)."""
    def step(df: DataFrame) -> DataFrame:
        parts = _names(partition_by)
        out = scan.row_index(df, "_idx", parts, order_by, skew_safe=skew_safe)
        out = _attach_partition_agg(out, parts, [F.count(F.lit(1)).alias("_size")])
        return out.withColumn(name, (F.col("_size") - F.col("_idx")).cast("long")).drop("_idx", "_size")
    return step


def lookup(value: str, offset: int, name: str, partition_by=None, order_by=None,
           skew_safe: bool | None = None) -> Step:
    """LOOKUP(value, offset): the value ``offset`` rows away (negative = before)."""
    def fn(w):
        return F.lag(value, -offset).over(w) if offset < 0 else F.lead(value, offset).over(w)
    lo, hi = (offset, 0) if offset < 0 else (0, offset)
    return lambda df: scan.framed(df, {name: fn}, partition_by, order_by, lo, hi, skew_safe=skew_safe)


def previous_value(value: str, seed, name: str, partition_by=None, order_by=None,
                   skew_safe: bool | None = None) -> Step:
    """PREVIOUS_VALUE(seed) applied to ``value``: the previous row's value, the
    seed on the first row of each partition."""
    def fn(w):
        seed_col = seed if isinstance(seed, Column) else F.lit(seed)
        return F.coalesce(F.lag(value, 1).over(w), seed_col)
    return lambda df: scan.framed(df, {name: fn}, partition_by, order_by, -1, 0, skew_safe=skew_safe)


def recurrence(name: str, seed, rate=1.0, flow=0.0, lower=None, upper=None, partition_by=None, order_by=None,
               skew_safe: bool | None = None) -> Step:
    """A formula that uses PREVIOUS_VALUE(seed) of itself: ``PREVIOUS_VALUE(seed) * rate + flow``, kept between ``lower`` and
    ``upper``.  Balances, decayed totals, compounded growth and stock levels are of this form; see :func:`carry.recurrence`."""
    return lambda df: carry.recurrence(df, name, seed, rate, flow, lower, upper, partition_by, order_by, skew_safe=skew_safe)


def total(base: DataFrame, partition_by: Sequence[str], aggs: dict[str, Column]) -> Step:
    """TOTAL(agg): the aggregate re-computed from the *base rows* at the
    partition level (never an average of averages), joined onto the view."""
    parts = list(partition_by)

    def step(view: DataFrame) -> DataFrame:
        t = base.groupBy(*parts).agg(*[a.alias(n) for n, a in aggs.items()])
        if not parts:
            return attach_scalar(view, t)
        return _join_back(view, t, parts)
    return step


# ----------------------------------------------------------------- quick table calcs

def percent_of_total(value: str, name: str, partition_by=None, skew_safe: bool | None = None) -> Step:
    """Share of the partition total.  The total is a grouped aggregate joined
    back (a scalar subquery without partitions); a view known to be small
    (``skew_safe=False``, or a size estimate within one task) uses a window
    over the partition instead, which reads the view once."""
    parts = _names(partition_by)

    def step(df: DataFrame) -> DataFrame:
        if not resolve_skew_safe(df, skew_safe):
            tot = F.sum(value).over(Window.partitionBy(*parts))
            return df.withColumn(name, F.try_divide(F.col(value), tot))
        out = _attach_partition_agg(df, parts, [F.sum(value).alias("_tot")])
        return out.withColumn(name, F.try_divide(F.col(value), F.col("_tot"))).drop("_tot")
    return step


def difference(value: str, name: str, partition_by=None, order_by=None, offset: int = -1,
               skew_safe: bool | None = None) -> Step:
    """Difference from the row ``offset`` away (previous by default)."""
    def step(df: DataFrame) -> DataFrame:
        out = lookup(value, offset, "_prev", partition_by, order_by, skew_safe)(df)
        return out.withColumn(name, F.col(value) - F.col("_prev")).drop("_prev")
    return step


def percent_difference(value: str, name: str, partition_by=None, order_by=None, offset: int = -1,
                       skew_safe: bool | None = None) -> Step:
    def step(df: DataFrame) -> DataFrame:
        out = lookup(value, offset, "_prev", partition_by, order_by, skew_safe)(df)
        return out.withColumn(name, F.try_divide(F.col(value) - F.col("_prev"), F.col("_prev"))).drop("_prev")
    return step
