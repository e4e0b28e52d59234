"""State carried along ordered groups: recurrences and running moments.

Both cut every group into range segments (:mod:`tessera.operators.scan`), reduce a
segment to one row and carry that row forward along the segments of its group:

* a recurrence's segment is one map of the state, composed from its rows' maps;
* a segment's moments are count, means, squared deviations and co-deviations, which
  merge without cancelling.

The carried table has one row per (group, segment).  It is read in order by a
streaming pass that holds one state; the rows themselves are never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import scan
from tessera.operators.scan import SEG
from tessera.operators.sizing import resolve_skew_safe
from tessera.session import stored

INF = math.inf
_RID = "_tsr_rid"
MAP = ["_tsr_a", "_tsr_b", "_tsr_lo", "_tsr_hi", "_tsr_m"]


def _carry_states(tails: DataFrame, parts: Sequence[str], cols: Sequence[str], states: Sequence[str],
                  step: Callable[[tuple | None, tuple], tuple | None]) -> DataFrame:
    """One row per (group, segment) with the state before it: ``step(state, row)`` over the earlier segments of the
    group, null before the first.  ``cols`` are the row's columns, ``states`` the state's (doubles)."""
    w = Window.partitionBy(*parts).orderBy(SEG)
    src = tails.select(*[F.col(p).alias(f"k{i}") for i, p in enumerate(parts)], F.col(SEG).alias("s"),
                       (F.row_number().over(w) == 1).alias("first"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    schema = T.StructType([*[tails.schema[p] for p in parts], tails.schema[SEG], *[T.StructField(s, T.DoubleType()) for s in states]])
    n_keys, n_states = len(parts), len(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            first = b.column(n_keys + 1).to_pylist()
            out = []
            for f, row in zip(first, zip(*[b.column(k).to_pylist() for k in range(n_keys + 2, b.num_columns)])):
                if f:
                    state = None
                out.append(state or (None,) * n_states)
                state = step(state, row)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in range(n_keys + 1)], *[pa.array([o[k] for o in out], pa.float64()) for k in range(n_states)]], names=schema.names)

    return src.mapInArrow(run, schema)


# ----------------------------------------------------------------- recurrence

def _apply(f: tuple, x: float | None) -> float | None:
    """The map ``(a, b, low, high, value at missing)`` at a state; a null ``a`` maps everything to missing."""
    a, b, low, high, m = f
    if a is None:
        return None
    return m if x is None else min(max(a * x + b, low), high)


def _then(f: tuple, g: tuple) -> tuple:
    """The map that does ``f`` and then ``g``: clamped affine maps are closed under composition."""
    a, b, low, high, m = g
    if a is None:
        return g
    if f[0] is None:
        return (None if m is None else 0.0, m, -INF, INF, m)
    if a == 0:
        c = min(max(b, low), high)
        return (0.0, c, -INF, INF, _apply(g, f[4]))
    ends = (a * f[2] + b, a * f[3] + b)
    lo, hi = (ends if a > 0 else ends[::-1])
    out = (a * f[0], a * f[1] + b, min(max(lo, low), high), min(max(hi, low), high), _apply(g, f[4]))
    if not math.isfinite(out[0]) or math.isnan(out[1]):
        raise ArithmeticError("the rates of a segment multiply beyond double precision")
    return out


def recurrence(df: DataFrame, name: str, seed, rate=1.0, flow=0.0, lower=None, upper=None, partition_by=None, order_by=None,
               skew_safe: bool | None = None, num_segments: int | None = None) -> DataFrame:
    """``value = min(upper, max(lower, previous * rate + flow))`` along ``order_by``; ``previous`` is ``seed`` on the first
    row of a group and after a row whose value is null.

    ``seed rate flow lower upper`` are numbers or columns, taken as doubles, of each row.  A null rate, flow or (where
    it is needed) seed gives a null value; a null bound is no bound.  Row maps compose, so a group may span any
    number of tasks: segments are reduced to one map each, the states at their starts carried forward, and the
    rows of each segment run through once more.  Ties of the order are broken in the stored rows' order.
    """
    parts = scan._names(partition_by)
    col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    seed_, rate_, flow_ = col(seed), col(rate), col(flow)
    low, high = F.coalesce(col(lower), F.lit(-INF)), F.coalesce(col(upper), F.lit(INF))
    clamp = lambda v: F.least(F.greatest(v, low), high)
    known = rate_.isNotNull() & flow_.isNotNull()
    first = clamp(seed_ * rate_ + flow_)
    # least() and greatest() skip nulls; a null seed must stay null.
    maps = [F.when(known, rate_), F.when(known, flow_), low, high, F.when(known & seed_.isNotNull(), first)]
    rows = df.withColumns({_RID: F.monotonically_increasing_id(), **dict(zip(MAP, maps))})
    many = resolve_skew_safe(df, skew_safe)
    if many:
        seg = scan.segment(rows, parts, order_by, num_segments or scan._num_segments(df, None))
    else:
        seg = stored(rows.withColumn(SEG, F.lit(0)), "segments")
    keys = [*parts, SEG]
    w = Window.partitionBy(*keys).orderBy(*scan.sort_orders(order_by), _RID)
    slim = seg.select(*keys, _RID, *MAP, F.row_number().over(w).alias("_tsr_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_tsr_c"))
    if many:
        tails = _segment_maps(slim, parts)
        starts = _carry_states(tails, parts, MAP, ["_tsr_x"], lambda x, f: (None if (v := _apply(f, x[0] if x else None)) is None else (v,)))
        slim = scan._null_safe_join(slim.drop("_tsr_c"), starts, keys)
        # A join may reorder rows; the position puts them back in order.
        slim = slim.withColumn("_tsr_o", F.row_number().over(Window.partitionBy(*keys).orderBy("_tsr_i")))
    else:
        slim = slim.withColumns({"_tsr_x": F.lit(None).cast("double"), "_tsr_o": F.col("_tsr_i")})
    values = _values(slim.select(_RID, "_tsr_o", "_tsr_x", *MAP), name)
    return seg.drop(name).join(values, _RID).drop(_RID, SEG, *MAP)


def _segment_maps(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Each segment's composed map, from its rows in order."""
    schema = T.StructType([*[rows.schema[p] for p in parts], rows.schema[SEG], *[T.StructField(c, T.DoubleType()) for c in MAP]])
    n = len(parts) + 1
    src = rows.select(*[F.col(p).alias(f"k{i}") for i, p in enumerate(parts)], F.col(SEG).alias("s"), F.col("_tsr_i").alias("i"),
                      (F.col("_tsr_i") == F.col("_tsr_c")).alias("last"), *MAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            at, out = [], []
            place, last = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            for k, g in enumerate(zip(*[b.column(n + 2 + j).to_pylist() for j in range(len(MAP))])):
                f = g if place[k] == 1 else _then(f, g)
                if last[k]:
                    at.append(k)
                    out.append(f)
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(idx) for k in range(n)],
                                              *[pa.array([o[k] for o in out], pa.float64()) for k in range(len(MAP))]], names=schema.names)

    return src.mapInArrow(run, schema)


def _values(rows: DataFrame, name: str) -> DataFrame:
    """The value of every row, from rows in order (place 1 starts a segment at state ``_tsr_x``)."""
    schema = T.StructType([rows.schema[_RID], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for b in batches:
            out = []
            for place, start, *f in zip(*[b.column(k).to_pylist() for k in range(1, b.num_columns)]):
                x = _apply(f, start if place == 1 else x)
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


# ----------------------------------------------------------------- moments

ONE, TWO = ("n", "mx", "sx"), ("n", "mx", "sx", "my", "sy", "c")


def _merge_rows(a: tuple | None, b: tuple) -> tuple:
    """Moments of two sets of rows together (counts, means, squared deviations, co-deviations)."""
    if a is None or not a[0]:
        return b
    if not b[0]:
        return a
    n = a[0] + b[0]
    k = a[0] * b[0] / n
    dx = b[1] - a[1]
    out = (n, a[1] + dx * b[0] / n, a[2] + b[2] + dx * dx * k)
    if len(a) == len(ONE):
        return out
    dy = b[3] - a[3]
    return (*out, a[3] + dy * b[0] / n, a[4] + b[4] + dy * dy * k, a[5] + b[5] + dx * dy * k)


def _merge_columns(a: Callable[[str], Column], b: Callable[[str], Column], fields: Sequence[str]) -> dict[str, Column]:
    """``_merge_rows`` as expressions over two sets of columns; an empty side may be null."""
    na, nb = F.coalesce(a("n"), F.lit(0.0)), F.coalesce(b("n"), F.lit(0.0))
    n, k = na + nb, na * nb / (na + nb)
    dx = b("mx") - a("mx")
    both = {"n": n, "mx": a("mx") + dx * nb / n, "sx": a("sx") + b("sx") + dx * dx * k}
    if len(fields) == len(TWO):
        dy = b("my") - a("my")
        both |= {"my": a("my") + dy * nb / n, "sy": a("sy") + b("sy") + dy * dy * k, "c": a("c") + b("c") + dx * dy * k}
    return {f: F.when(na == 0, b(f)).when(nb == 0, a(f)).otherwise(v) for f, v in both.items()}


def running_moments(df: DataFrame, x: str, y: str | None = None, partition_by=None, order_by=None, prefix: str = "m_",
                    skew_safe: bool | None = None, num_segments: int | None = None) -> DataFrame:
    """Moments of the rows from the start of the group to the current one: ``n`` (rows where ``x``, and ``y`` if given, are
    not null), means ``mx my``, sums of squared deviations ``sx sy`` and of products ``c``, as doubles."""
    parts = scan._names(partition_by)
    fields = TWO if y else ONE
    xx = F.col(x).cast("double")
    yy = F.col(y).cast("double") if y else None
    if y:
        xx, yy = F.when(yy.isNotNull(), xx), F.when(xx.isNotNull(), yy)

    def over(w) -> dict[str, Column]:
        n = F.count(xx).over(w).cast("double")
        # A window's variance can fall below zero by rounding.
        out = {"n": n, "mx": F.avg(xx).over(w), "sx": F.greatest(F.var_pop(xx).over(w), F.lit(0.0)) * n}
        if y:
            out |= {"my": F.avg(yy).over(w), "sy": F.greatest(F.var_pop(yy).over(w), F.lit(0.0)) * n, "c": F.covar_pop(xx, yy).over(w) * n}
        return out

    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not resolve_skew_safe(df, skew_safe):
        w = frame(Window.partitionBy(*parts).orderBy(*scan.sort_orders(order_by)))
        return df.withColumns({f"{prefix}{k}": v for k, v in over(w).items()})
    local, parts = scan._local(df, parts, order_by, {f"_l_{k}": (lambda k: lambda w: over(frame(w))[k])(k) for k in fields}, num_segments)
    tails = local.filter(F.col(scan._RN) == F.col(scan._N)).select(*parts, SEG, *[f"_l_{k}" for k in fields])
    starts = _carry_states(tails, parts, [f"_l_{k}" for k in fields], [f"_c_{k}" for k in fields], _merge_rows)
    j = scan._null_safe_join(local, starts, [*parts, SEG])
    merged = _merge_columns(lambda k: F.col(f"_c_{k}"), lambda k: F.col(f"_l_{k}"), fields)
    res = j.withColumns({f"{prefix}{k}": v for k, v in merged.items()})
    return res.drop(SEG, scan._RN, scan._N, *[f"_{s}_{k}" for s in "lc" for k in fields])


def statistic(agg: str, prefix: str = "m_") -> Column:
    """``var varp stdev stdevp covar covarp corr`` from moment columns; null where there are too few rows or no variance."""
    m = lambda k: F.col(f"{prefix}{k}")
    if agg == "corr":
        return F.when((m("sx") > 0) & (m("sy") > 0), m("c") / F.sqrt(m("sx") * m("sy")))
    top = m("c") if agg.startswith("covar") else m("sx")
    rows = m("n") if agg.endswith("p") else m("n") - 1
    out = F.when(rows > 0, top / rows)
    return F.sqrt(out) if agg.startswith("stdev") else out
