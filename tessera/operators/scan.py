"""Skew-safe ordered scans: running aggregates, row numbers, ranks and fills.

A plain ``Window.partitionBy(g).orderBy(o)`` sends every row of a partition
group to one task; when one group holds a third of the data that task is the
whole job, and with no ``partitionBy`` at all every row goes to one task.

These helpers split each group into *segments* instead:

1. ``repartitionByRange(n, g..., o...)`` cuts the (group, order) key space into
   ``n`` balanced ranges (Spark samples the keys); a hot group spans many
   ranges, and equal keys always land in the same range.  Range bounds come from
   a sample, so two plans over the same rows may cut differently: the rows are
   therefore written with their segment to the shared checkpoint folder once,
   and everything after reads that table.
2. Inside each (group, segment) an ordinary window computes the local result.
3. One summary row per (group, segment) — its count, total, last value... —
   is carried forward along the segments of the group with a window over the
   small summary table.
4. The carried values join back on (group, segment).

The result is exact (same values and types as the single-window form) with work
spread over ``n`` tasks whatever the key distribution.  ``skew_safe=False`` gives
the single-window plan; ``None`` (default) picks it only when the whole input is
within one task's budget (``tessera.scan.singleTaskBytes``, 64 MiB), so no group
can overload a task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import attach_scalar
from tessera.operators.sizing import num_segments, resolve_skew_safe
from tessera.session import stored

SEG = "_tsr_seg"
_RN = "_tsr_rn"
_N = "_tsr_n"


def sort_orders(order_by) -> list[Column]:
    """Normalise an order spec: names, Columns, or (name, 'asc'|'desc') pairs."""
    if order_by is None:
        return []
    if isinstance(order_by, (str, Column, tuple)):
        order_by = [order_by]
    out = []
    for o in order_by:
        if isinstance(o, tuple):
            name, direction = o
            col = F.col(name) if isinstance(name, str) else name
            out.append(col.desc_nulls_last() if direction.lower().startswith("d") else col.asc_nulls_first())
        elif isinstance(o, str):
            out.append(F.col(o).asc_nulls_first())
        else:
            out.append(o)
    return out


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def _num_segments(df: DataFrame, n: int | None) -> int:
    return num_segments(df, n)


def segment(df: DataFrame, partition_by, order_by, num_segments: int | None = None) -> DataFrame:
    """Range-partition on (partition keys, order keys) and tag each row with its segment.

    The tagged rows are written to shared storage: a row keeps its segment
    whatever is later read from them.
    """
    keys = [F.col(p).asc_nulls_first() for p in _names(partition_by)] + sort_orders(order_by)
    n = _num_segments(df, num_segments)
    return stored(df.repartitionByRange(n, *keys).withColumn(SEG, F.spark_partition_id()), "segments")


def _null_safe_join(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null (grouped nulls are a member)."""
    renamed = small
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        term = big[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = term if cond is None else cond & term
    out = big.join(renamed, cond, "left")
    return out.drop(*[f"__r_{k}" for k in keys])


def _local(df, partition_by, order_by, local_cols: dict[str, Column], num_segments):
    """Segment, then compute local window columns plus row number / segment size."""
    parts = _names(partition_by)
    seg = segment(df, parts, order_by, num_segments)
    wkeys = parts + [SEG]
    w = Window.partitionBy(*wkeys).orderBy(*sort_orders(order_by))
    wall = Window.partitionBy(*wkeys)
    cols = {_RN: F.row_number().over(w), _N: F.count(F.lit(1)).over(wall)}
    for k, v in local_cols.items():
        cols[k] = v(w) if callable(v) else v
    return seg.withColumns(cols), parts


def _carry(local: DataFrame, parts, tail_cols: dict[str, Column], carry_cols: dict[str, callable]):
    """Per-segment tails (last row of each segment) carried forward along the group."""
    tails = local.filter(F.col(_RN) == F.col(_N)).select(*parts, SEG, *[v.alias(k) for k, v in tail_cols.items()])
    wprev = Window.partitionBy(*parts).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*parts, SEG, *[fn(wprev).alias(k) for k, fn in carry_cols.items()])
    return carried


def running(df: DataFrame, value: str | Column, partition_by=None, order_by=None,
            aggs: Sequence[str] = ("sum",), prefix: str = "running_", skew_safe: bool | None = None,
            num_segments: int | None = None) -> DataFrame:
    """Running sum/count/min/max/avg of ``value`` along ``order_by`` within ``partition_by``.

    Frame: rows from the start of the partition to the current row.
    """
    v = F.col(value) if isinstance(value, str) else value
    parts = _names(partition_by)
    skew_safe = resolve_skew_safe(df, skew_safe)
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fns = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}
    w = frame((Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(*sort_orders(order_by)))
    plain = df.withColumns({f"{prefix}{a}": fns[a](v).over(w) for a in aggs})
    if not skew_safe:
        return plain
    # Only the parts of the aggregates asked for; a sum or average needs its count to tell null from zero.
    needed = dict.fromkeys(x for a in aggs for x in {"avg": ("sum", "count"), "sum": ("sum", "count")}.get(a, (a,)))
    local_cols = {f"_l_{a}": (lambda f: lambda w: f(v).over(frame(w)))(fns[a]) for a in needed}
    local, parts = _local(df, parts, order_by, local_cols, num_segments)
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    carried = _carry(local, parts, {f"_t_{a}": F.col(f"_l_{a}") for a in needed},
                     {f"_c_{a}": (lambda f, a: lambda w: f(f"_t_{a}").over(w))(merge[a], a) for a in needed})
    j = _null_safe_join(local, carried, parts + [SEG])
    both = lambda a: F.coalesce(F.col(f"_l_{a}"), F.lit(0)) + F.coalesce(F.col(f"_c_{a}"), F.lit(0))
    outs = {
        "sum": lambda: F.when(both("count") > 0, both("sum")),
        "count": lambda: both("count"),
        "min": lambda: F.least(F.col("_l_min"), F.col("_c_min")),
        "max": lambda: F.greatest(F.col("_l_max"), F.col("_c_max")),
        "avg": lambda: F.try_divide(both("sum"), both("count")),
    }
    res = j.withColumns({f"{prefix}{a}": outs[a]().cast(plain.schema[f"{prefix}{a}"].dataType) for a in aggs})
    return res.drop(SEG, _RN, _N, *[f"_{k}_{a}" for k in "lc" for a in needed])


def row_index(df: DataFrame, name: str, partition_by=None, order_by=None, start: int = 1,
              step: int = 1, skew_safe: bool | None = None, num_segments: int | None = None) -> DataFrame:
    """Row number along a total order (ties must be broken by the caller), as
    ``start + step * (n - 1)``; global when ``partition_by`` is empty."""
    parts = _names(partition_by)
    skew_safe = resolve_skew_safe(df, skew_safe)
    if not skew_safe:
        w = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(*sort_orders(order_by))
        return df.withColumn(name, (F.lit(start) + F.lit(step) * (F.row_number().over(w) - 1)).cast("long"))
    seg = segment(df, parts, order_by, num_segments)
    local = seg.withColumn(_RN, F.row_number().over(Window.partitionBy(*parts, SEG).orderBy(*sort_orders(order_by))))
    # The rows of each segment are counted by partial aggregates: the numbering itself is sorted once.
    before = Window.partitionBy(*parts).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = seg.groupBy(*parts, SEG).agg(F.count(F.lit(1)).alias("_t_n")).select(*parts, SEG, F.sum("_t_n").over(before).alias("_c_n"))
    j = _null_safe_join(local, carried, parts + [SEG])
    rn = F.col(_RN) + F.coalesce(F.col("_c_n"), F.lit(0))
    return j.withColumn(name, (F.lit(start) + F.lit(step) * (rn - 1)).cast("long")).drop(SEG, _RN, "_c_n")


def ranks(df: DataFrame, value: str, partition_by=None, ascending: bool = False,
          kinds: Sequence[str] = ("rank",), prefix: str = "", skew_safe: bool | None = None,
          num_segments: int | None = None) -> DataFrame:
    """Competition ``rank``, ``dense`` rank, ``modified`` (ties take the worst rank)
    and ``percentile`` ((rank-1)/(n-1)) of ``value`` within ``partition_by``.
    Descending by default, as the BI RANK functions are."""
    parts = _names(partition_by)
    o = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    skew_safe = resolve_skew_safe(df, skew_safe)
    if not skew_safe:
        w = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(o)
        wr = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        outs = {"rank": F.rank().over(w).cast("long"), "dense": F.dense_rank().over(w).cast("long"),
                "modified": F.count(F.lit(1)).over(wr).cast("long"),
                "percentile": F.percent_rank().over(w)}
        return df.withColumns({f"{prefix}{k}": outs[k] for k in kinds})
    # Equal values rank alike: count each (group, value) once and rank the counts, so that
    # no value's rows meet in one task; then join the ranks back.
    df = stored(df, "ranked")  # both sides of the join must see the same values
    counts = stored(df.groupBy(*parts, value).agg(F.count(F.lit(1)).alias("_c")), "values")
    order = [(value, "asc" if ascending else "desc")] if not ascending else [F.col(value).asc_nulls_last()]
    run = running(counts, "_c", parts, order, aggs=("sum",), prefix="_r_", skew_safe=True, num_segments=num_segments)
    if "dense" in kinds:
        run = row_index(run, "_d", parts, order, skew_safe=True, num_segments=num_segments)
    totals = counts.groupBy(*parts).agg(F.sum("_c").alias("_g_n")) if "percentile" in kinds else None
    if totals is not None:
        run = _null_safe_join(run, totals, parts) if parts else attach_scalar(run, totals)
    j = _null_safe_join(df, run, [*parts, value])
    rank = F.col("_r_sum") - F.col("_c") + 1
    outs = {"rank": lambda: rank.cast("long"), "dense": lambda: F.col("_d").cast("long"), "modified": lambda: F.col("_r_sum").cast("long"),
            "percentile": lambda: F.when(F.col("_g_n") > 1, (rank - 1) / (F.col("_g_n") - 1)).otherwise(F.lit(0.0))}
    res = j.withColumns({f"{prefix}{k}": outs[k]() for k in kinds})
    return res.drop("_c", "_r_sum", "_d", "_g_n")


def fill(df: DataFrame, cols: Sequence[str], partition_by=None, order_by=None,
         direction: str = "down", skew_safe: bool | None = None, num_segments: int | None = None) -> DataFrame:
    """Fill nulls from the nearest non-null row before (``down``) or after (``up``)."""
    cols = _names(cols)
    parts = _names(partition_by)
    if direction == "up":
        # Filling up is filling down along the reversed order.
        order_by = _reverse_spec(order_by)
    orders = sort_orders(order_by)
    skew_safe = resolve_skew_safe(df, skew_safe)
    if not skew_safe:
        w = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(*orders) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({c_: F.last(c_, ignorenulls=True).over(w) for c_ in cols})
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_cols = {f"_l_{c_}": (lambda c_: lambda w: F.last(c_, ignorenulls=True).over(frame(w)))(c_) for c_ in cols}
    local, parts = _local(df, parts, orders, local_cols, num_segments)
    carried = _carry(local, parts, {f"_t_{c_}": F.col(f"_l_{c_}") for c_ in cols},
                     {f"_c_{c_}": (lambda c_: lambda w: F.last(f"_t_{c_}", ignorenulls=True).over(w))(c_) for c_ in cols})
    j = _null_safe_join(local, carried, parts + [SEG])
    res = j.withColumns({c_: F.coalesce(F.col(f"_l_{c_}"), F.col(f"_c_{c_}")) for c_ in cols})
    return res.drop(SEG, _RN, _N, *[f"_l_{c_}" for c_ in cols], *[f"_c_{c_}" for c_ in cols])


def _reverse_spec(order_by) -> list[tuple]:
    """Reverse an order spec given as names or (name, direction) pairs."""
    if isinstance(order_by, (str, tuple)):
        order_by = [order_by]
    out = []
    for o in order_by:
        name, direction = (o, "asc") if isinstance(o, str) else o
        out.append((name, "asc" if direction.lower().startswith("d") else "desc"))
    return out


def _reach(column: Column) -> tuple[int, int]:
    """Rows before and after the current one that a window expression reads (from its text)."""
    text = column._jc.toString()
    back = fwd = 0
    for name, args in re.findall(r"\b(lag|lead)\(((?:[^()]|\([^()]*\))*)\) OVER", text):
        n = int(re.search(r", (-?\d+), [^,]*, (?:true|false)$", args)[1]) * (1 if name == "lead" else -1)
        back, fwd = max(back, -n), max(fwd, n)
    for a, b in re.findall(r"ROWS BETWEEN (.+?) AND (.+?)\)", text):
        if "UNBOUNDED" in a + b:
            raise ValueError("framed() takes bounded frames only; use running() or an aggregate")
        a, b = (0 if x == "CURRENT ROW" else int(x) for x in (a, b))
        back, fwd = max(back, -a), max(fwd, b)
    return back, fwd


def framed(df: DataFrame, exprs: dict, partition_by=None, order_by=None, lo: int = 0, hi: int = 0,
           skew_safe: bool | None = None, block: int | None = None, num_segments: int | None = None) -> DataFrame:
    """Window expressions over bounded row frames.

    ``exprs`` maps output names to ``fn(window_spec) -> Column``.  Skew-safe
    form: number the rows of each partition (``row_index``), cut them into
    blocks of ``block`` rows, copy the last rows of each block into the next
    block and the first rows into the previous one as read-only context, and
    evaluate the window per (partition, block).  The context is the largest
    reach of ``lo``, ``hi`` and the expressions themselves (their frames and
    offsets), and a block has at least that many rows.
    """
    parts = _names(partition_by)
    skew_safe = resolve_skew_safe(df, skew_safe)
    if not skew_safe:
        w = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(*sort_orders(order_by))
        return df.withColumns({n: f(w) for n, f in exprs.items()})
    w = Window.partitionBy(*parts, "_tsr_blk").orderBy("_tsr_fi")
    reaches = [_reach(f(w)) for f in exprs.values()]
    back, fwd = max([0, -lo, *[r[0] for r in reaches]]), max([0, hi, *[r[1] for r in reaches]])
    size = max(int(block or max(4096, 8 * (back + fwd))), back, fwd, 1)
    idx = row_index(df, "_tsr_fi", partition_by=parts, order_by=order_by, start=0,
                    skew_safe=True, num_segments=num_segments)
    pos = F.col("_tsr_fi")
    blk = F.floor(pos / size)
    # One pass: each row goes to its block and, near an edge, to the neighbour as context.
    to = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
    if back:
        to.append(F.when(pos % size >= size - back, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    if fwd:
        to.append(F.when(pos % size < fwd, F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
    u = idx.withColumn("_tsr_to", F.explode(F.filter(F.array(*to), lambda x: x.isNotNull())))
    u = u.withColumns({"_tsr_blk": F.col("_tsr_to.b"), "_tsr_halo": F.col("_tsr_to.h")}).drop("_tsr_to")
    out = u.withColumns({n: f(w) for n, f in exprs.items()})
    return out.filter(~F.col("_tsr_halo")).drop("_tsr_fi", "_tsr_blk", "_tsr_halo")
