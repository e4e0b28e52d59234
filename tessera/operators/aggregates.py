"""Aggregates (Column forms for ``groupBy().agg``) and aggregation steps.

Algebraic aggregates (sum, count, min, max, avg, var, corr, ...) are merged
map-side by Spark's partial aggregation, so a hot group costs one partial row
per task.  Exact percentiles are the exception: Spark's ``percentile`` keeps
every distinct value of a group in the final task.  ``exact_percentiles``
brackets the target ranks with a sketch and counts instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import c
from tessera.operators import scan
from tessera.operators.joins import attach_scalar, broadcast_if_small
from tessera.session import stored

Step = Callable[[DataFrame], DataFrame]


def sum_(x) -> Column:
    return F.sum(c(x))


def avg(x) -> Column:
    return F.avg(c(x))


def min_(x) -> Column:
    return F.min(c(x))


def max_(x) -> Column:
    return F.max(c(x))


def count(x) -> Column:
    """COUNT(x): non-null values."""
    return F.count(c(x))


def counta(x) -> Column:
    """COUNTA(x): non-empty values (null and '' are empty)."""
    x = c(x)
    return F.count(F.when(x.cast("string") != "", x))


def count_rows() -> Column:
    """Number of Records."""
    return F.count(F.lit(1))


def countd(x, approx: bool = False, rsd: float = 0.05) -> Column:
    """COUNTD(x): distinct non-null values (HyperLogLog++ when ``approx``)."""
    return F.approx_count_distinct(c(x), rsd) if approx else F.count_distinct(c(x))


def countd_both(groups: Sequence[str], x: str, approx_name: str, exact_name: str, rsd: float = 0.05) -> Step:
    """COUNTD(x) both ways, sketched and exact.  In one aggregate Spark keeps a sketch beside every (group, value) pair.

    Each pair is taken once (a sketch sees no repeats) and sent to its group's task, so a group has one sketch and its
    distinct values are streamed past it: nothing is kept but one sketch per group of the task.
    """
    def step(df: DataFrame) -> DataFrame:
        pairs = df.select(*groups, c(x).alias("_tsr_x")).distinct()
        return (pairs.repartition(*groups) if groups else pairs).groupBy(*groups).agg(
            countd("_tsr_x", approx=True, rsd=rsd).alias(approx_name), count("_tsr_x").alias(exact_name))
    return step


def countd_sketch(x, lg_k: int = 12) -> Column:
    """A mergeable sketch of the distinct non-null values of ``x`` (compared as text); its standard error is about 1 / sqrt(2 ** lg_k)."""
    return F.hll_sketch_agg(c(x).cast("string"), lg_k)


def countd_of(sketch) -> Column:
    """COUNTD of all rows that stored sketches cover, as an aggregate over those sketches: views roll up to coarser levels, and
    refreshed periods replace theirs, without the base rows.  No sketch gives 0."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c(sketch))), F.lit(0).cast("bigint"))


def median(x, approx: bool = False) -> Column:
    return F.percentile_approx(c(x), 0.5, 10000) if approx else F.median(c(x))


def percentile(x, p: float, approx: bool = False) -> Column:
    """PERCENTILE(x, p) with linear interpolation (or a bounded sketch)."""
    return F.percentile_approx(c(x), p, 10000) if approx else F.percentile(c(x), p)


def stdev(x) -> Column:
    return F.stddev_samp(c(x))


def stdevp(x) -> Column:
    return F.stddev_pop(c(x))


def var(x) -> Column:
    return F.var_samp(c(x))


def varp(x) -> Column:
    return F.var_pop(c(x))


def corr(x, y) -> Column:
    return F.corr(c(x), c(y))


def covar(x, y) -> Column:
    return F.covar_samp(c(x), c(y))


def covarp(x, y) -> Column:
    return F.covar_pop(c(x), c(y))


def attr(x) -> Column:
    """ATTR(x): the value when every row has the same one, else null."""
    x = c(x)
    return F.when(F.min(x) == F.max(x), F.min(x))


def collect_geometry(groups: Sequence[str], point: str, name: str = "points", precision: int | None = None,
                     chunk: int | None = None) -> Step:
    """COLLECT of a group's points as a multipoint, in order: every point, repeats
    too.  With ``precision`` it is a multipoint of the distinct points snapped to
    so many decimal degrees, found by a grouped aggregate before anything is
    collected, so a group's array is bounded by the grid cells at that precision.
    With ``chunk`` a group of any size comes as arrays of at most so many points,
    numbered from 0 in the column ``chunk``, and no task holds more than one of them.
    """
    def step(df: DataFrame) -> DataFrame:
        p = F.col(point)
        if precision is None:
            pts = df.select(*groups, F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")).alias("_pt")).filter(F.col("_pt.lat").isNotNull())
        else:
            snapped = F.struct(F.round(p["lat"], precision).alias("lat"), F.round(p["lon"], precision).alias("lon"))
            pts = df.select(*groups, snapped.alias("_pt")).filter(F.col("_pt.lat").isNotNull()).distinct()
        keys = list(groups)
        if chunk:
            pts = scan.row_index(pts, "_i", groups, ["_pt"], start=0).withColumn("chunk", F.floor(F.col("_i") / chunk))
            keys.append("chunk")
        return pts.groupBy(*keys).agg(F.array_sort(F.collect_list("_pt")).alias(name))
    return step


def sum_if(cond: Column, x) -> Column:
    """SUM(IF cond THEN x END)."""
    return F.sum(F.when(cond, c(x)))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def ratio(num: Column, den: Column) -> Column:
    """Ratio of aggregates; a zero denominator gives null (DIVIDE)."""
    return F.try_divide(num, den)


def group_by(groups: Sequence[str], aggs: Mapping[str, Column]) -> Step:
    """Group and aggregate; no groups gives one row."""
    return lambda df: df.groupBy(*groups).agg(*[a.alias(n) for n, a in aggs.items()])


def nested_stat(view_dims: Sequence[str], outer_dims: Sequence[str], inner: Column,
                outer: Callable[[Column], Column], name: str) -> Step:
    """STDEV(SUM(x)) and kin: aggregate to the view's marks, then a statistic of
    the mark values per ``outer_dims``."""
    def step(df: DataFrame) -> DataFrame:
        marks = df.groupBy(*view_dims).agg(inner.alias("_mark"))
        return marks.groupBy(*outer_dims).agg(outer(F.col("_mark")).alias(name))
    return step


def totals(groups: Sequence[str], aggs: Mapping[str, Column], kind: str = "rollup",
           sets: Sequence[Sequence[str]] | None = None) -> Step:
    """Grand totals and subtotals: ``rollup`` (row subtotals), ``cube`` (both
    ways) or explicit grouping ``sets``; ``grouping_id`` tells levels apart."""
    def step(df: DataFrame) -> DataFrame:
        exprs = [a.alias(n) for n, a in aggs.items()] + [F.grouping_id().alias("grouping_id")]
        if kind == "cube":
            return df.cube(*groups).agg(*exprs)
        if kind == "sets":
            return df.groupingSets([[F.col(g) for g in s] for s in sets], *groups).agg(*exprs)
        return df.rollup(*groups).agg(*exprs)
    return step


# Rank error of the sketch is one in ACCURACY; the bracket reaches MARGIN of the rows to both sides.
ACCURACY = 10_000
MARGIN = 0.001
# Groups of at most so many values are left to Spark's percentile.
FEW = 4000


def exact_percentiles(groups: Sequence[str], value: str, ps: Mapping[str, float], num_segments: int | None = None) -> Step:
    """Exact interpolated percentiles per group without gathering or sorting a group.

    1. One pass of partial aggregates: rows and a quantile sketch per group.  The
       sketch brackets each target rank (by ten times its rank error).  Groups of
       at most ``FEW`` values go to Spark's own ``percentile``.
    2. A second pass, with the brackets attached, counts the rows below each
       bracket and counts the values inside it, each distinct value once.
    3. A running count over those few values finds the values at the two ranks
       around ``1 + (n-1) p``, which are interpolated.

    Same definition as Spark ``percentile`` and DuckDB ``quantile_cont``; a group with
    only nulls gives nulls.  Large groups' rows are not shuffled (a brackets table
    too large to broadcast is joined on the groups, which Spark can split); equal
    values are counted, not sorted.  A rank outside its bracket is an error.
    Integers and decimals are compared as doubles, as those two do.
    """
    groups = list(groups)
    names = list(ps)

    def step(df: DataFrame) -> DataFrame:
        base = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(value).cast("double").alias("_v"))
        keys = [f"_g{i}" for i in range(len(groups))]
        marks = sorted({round(min(1.0, max(0.0, ps[nm] + d)), 12) for nm in names for d in (-MARGIN, MARGIN)})
        sketch = base.groupBy(*keys).agg(
            F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.percentile_approx("_v", [float(m) for m in marks], ACCURACY).alias("_q"))
        at = lambda p, d: F.col("_q")[marks.index(round(min(1.0, max(0.0, p + d)), 12))]
        spec = [F.struct(
            F.lit(nm).alias("p"), (F.lit(1.0) + (F.col("_n") - 1) * float(ps[nm])).alias("h"),
            F.when(F.lit(ps[nm] - MARGIN <= 0), F.col("_min")).otherwise(at(ps[nm], -MARGIN)).alias("lo"),
            F.when(F.lit(ps[nm] + MARGIN >= 1), F.col("_max")).otherwise(at(ps[nm], MARGIN)).alias("hi")) for nm in names]
        brackets = stored(sketch.select(*keys, (F.col("_n") > FEW).alias("_many"), F.array(*spec).alias("_b")), "brackets")
        if keys:
            side = broadcast_if_small(brackets.withColumnsRenamed({k: f"_b{k}" for k in keys}))
            rows = base.join(side, _ns_cond(keys, [f"_b{k}" for k in keys]))
        else:
            rows = attach_scalar(base, brackets)
        sizes = brackets.agg(F.max("_many").alias("many"), F.min("_many").alias("few")).first()
        found = []
        if not sizes["many"] or not sizes["few"]:
            # Groups of few rows (or none but nulls): Spark's own percentile holds their values.
            few = rows if not sizes["many"] else rows.where(~F.col("_many"))
            found.append(few.groupBy(*keys).agg(*[F.percentile("_v", float(ps[nm])).alias(nm) for nm in names]))
        if sizes["many"]:
            found.append(bracketed(rows if sizes["few"] else rows.where("_many"), keys))
        out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], *names)

    def bracketed(rows: DataFrame, keys: list[str]) -> DataFrame:
        below = rows.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_b")[i]["lo"]).alias(f"_c{i}") for i in range(len(names))])
        inside = rows.select(*keys, "_v", F.explode(F.filter("_b", lambda b: F.col("_v").between(b["lo"], b["hi"]))).alias("_t")).groupBy(
            *keys, F.col("_t.p").alias("_p"), F.col("_t.h").alias("_h"), "_v").agg(F.count(F.lit(1)).alias("_c"))
        run = scan.running(stored(inside, "inside"), "_c", [*keys, "_p"], ["_v"], aggs=("sum",), prefix="_r_", num_segments=num_segments)
        low = below.select(*[F.col(k).alias(f"_b{k}") for k in keys], F.explode(F.array(*[
            F.struct(F.lit(nm).alias("p"), F.col(f"_c{i}").alias("c")) for i, nm in enumerate(names)])).alias("_l")).select(
            *[f"_b{k}" for k in keys], F.col("_l.p").alias("_bp"), F.col("_l.c").alias("_below"))
        ranked = run.join(low, _ns_cond([*keys, "_p"], [*[f"_b{k}" for k in keys], "_bp"]))
        last = F.col("_below") + F.col("_r_sum")
        holds = lambda r: (r > last - F.col("_c")) & (r <= last)
        aggs = []
        for nm in names:
            mine = F.col("_p") == nm
            lo_v = F.max(F.when(mine & holds(F.floor("_h")), F.col("_v")))
            hi_v = F.max(F.when(mine & holds(F.ceil("_h")), F.col("_v")))
            frac = F.max(F.when(mine, F.col("_h") - F.floor("_h")))
            outside = F.raise_error(F.lit(f"percentile {nm}: the target rank lies outside its bracket; raise aggregates.MARGIN")).cast("double")
            aggs.append(F.when(lo_v.isNull() | hi_v.isNull(), outside).otherwise(lo_v + (hi_v - lo_v) * frac).alias(nm))
        return ranked.groupBy(*keys).agg(*aggs)
    return step


def _ns_cond(left_keys: Sequence[str], right_keys: Sequence[str]):
    cond = None
    for a, b in zip(left_keys, right_keys):
        t = F.col(a).eqNullSafe(F.col(b))
        cond = t if cond is None else cond & t
    return cond
