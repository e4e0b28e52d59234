"""Filters, sort, limit and de-duplication steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import datepart
from tessera.operators import scan
from tessera.session import stored

Step = Callable[[DataFrame], DataFrame]


def keep_values(col: str, values: Sequence) -> Step:
    return lambda df: df.filter(F.col(col).isin(list(values)))


def exclude_values(col: str, values: Sequence) -> Step:
    """Drop the listed values; null rows stay."""
    return lambda df: df.filter(~F.col(col).isin(list(values)) | F.col(col).isNull())


def range_(col: str, lo=None, hi=None) -> Step:
    """Inclusive range; either end may be open."""
    def step(df: DataFrame) -> DataFrame:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(col) >= F.lit(lo))
        if hi is not None:
            cond = cond & (F.col(col) <= F.lit(hi))
        return df.filter(cond)
    return step


def nulls(col: str, keep: bool = False) -> Step:
    """keep=True keeps only nulls, else drops them."""
    return lambda df: df.filter(F.col(col).isNull() if keep else F.col(col).isNotNull())


def contains(col: str, pattern: str, wildcard: bool = False) -> Step:
    """Substring match, or SQL LIKE when ``wildcard`` ('*' and '?' accepted)."""
    if wildcard:
        like = pattern.replace("*", "%").replace("?", "_")
        return lambda df: df.filter(F.col(col).like(like))
    return lambda df: df.filter(F.col(col).contains(pattern))


def expression(cond: Column, keep: bool = True) -> Step:
    """Keep (or remove) rows where the predicate is true; unknown counts as not true."""
    return lambda df: df.filter(cond if keep else ~F.coalesce(cond, F.lit(False)))


def date_part(col: str, part: str, values: Sequence[int]) -> Step:
    return lambda df: df.filter(datepart(part, col).isin(list(values)))


def include_null(cond: Column, col: str) -> Step:
    """A filter with the 'include null values' flag."""
    return lambda df: df.filter(cond | F.col(col).isNull())


def context(*steps: Step) -> Step:
    """Context filters: applied to the base rows before FIXED level-of-detail."""
    def step(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df
    return step


def datasource(categorical: Mapping[str, Sequence] | None = None,
               quantitative: Mapping[str, tuple] | None = None,
               exclude: bool = False) -> Step:
    """Data-source (extract) filter: categorical members and/or quantitative ranges.

    Written as plain predicates on source columns so Catalyst pushes them into
    the scan (``PushedFilters``).
    """
    def step(df: DataFrame) -> DataFrame:
        cond = F.lit(True)
        for c, vals in (categorical or {}).items():
            cond = cond & F.col(c).isin(list(vals))
        for c, (lo, hi) in (quantitative or {}).items():
            if lo is not None:
                cond = cond & (F.col(c) >= F.lit(lo))
            if hi is not None:
                cond = cond & (F.col(c) <= F.lit(hi))
        return df.filter(~cond if exclude else cond)
    return step


def top_n(n: int, by: str, tie_breakers: Sequence[str] = (), descending: bool = True) -> Step:
    """The n rows with the largest (smallest) ``by``; ties broken by the given keys.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own n best, only n x tasks rows reach the final merge.
    """
    o = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return lambda df: df.orderBy(o, *[F.col(t).asc() for t in tie_breakers]).limit(n)


def bottom_n(n: int, by: str, tie_breakers: Sequence[str] = ()) -> Step:
    return top_n(n, by, tie_breakers, descending=False)


def top_n_members(dim: str, measure: Column, n: int, descending: bool = True) -> Step:
    """Keep rows whose ``dim`` member is among the top n by an aggregate measure.

    Aggregate (partial + final) -> n best members -> semi join, broadcast if Spark
    finds the members small.
    """
    def step(df: DataFrame) -> DataFrame:
        agg = df.groupBy(dim).agg(measure.alias("_m"))
        o = F.col("_m").desc_nulls_last() if descending else F.col("_m").asc_nulls_last()
        best = agg.orderBy(o, F.col(dim).asc_nulls_first()).limit(n).select(dim)
        best = best.withColumnRenamed(dim, "_tsr_member")
        return df.join(best, df[dim].eqNullSafe(best["_tsr_member"]), "left_semi")
    return step


def distinct(cols: Sequence[str] | None = None) -> Step:
    """Drop duplicate rows (all columns, or the given ones keeping any one row)."""
    return lambda df: df.distinct() if not cols else df.dropDuplicates(list(cols))


def distinct_ordered(cols: Sequence[str], order_by) -> Step:
    """Keep the first row per key along ``order_by`` (deterministic dedup).

    When the order is all ascending (or all descending) this is a ``min`` (or
    ``max``) of a struct led by the order columns — an aggregate that Spark
    merges map-side, so a key holding a third of the rows costs one partial row
    per task.  Mixed directions fall back to a row_number window.
    """
    specs = [(o, "asc") if isinstance(o, str) else o for o in
             ([order_by] if isinstance(order_by, (str, tuple)) else list(order_by))]

    def step(df: DataFrame) -> DataFrame:
        dirs = {d.lower()[:1] for _, d in specs} if all(isinstance(s, tuple) for s in specs) else {"x"}
        if len(dirs) == 1 and dirs <= {"a", "d"}:
            order_names = [n for n, _ in specs]
            rest = [c for c in df.columns if c not in cols and c not in order_names]
            packed = F.struct(*[F.col(n).alias(f"_o{i}") for i, n in enumerate(order_names)],
                              *[F.col(c) for c in rest], *[F.col(n) for n in order_names])
            pick = F.min(packed) if dirs == {"a"} else F.max(packed)
            out = df.groupBy(*cols).agg(pick.alias("_best"))
            return out.select(*cols, *[F.col(f"_best.`{c}`").alias(c) for c in df.columns if c not in cols])
        w = Window.partitionBy(*cols).orderBy(*scan.sort_orders(order_by))
        return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return step


def remove_blank_rows() -> Step:
    return lambda df: df.dropna(how="all")


def skip_rows(n: int, order_by) -> Step:
    """Drop the first n rows along a total order.

    Rows are numbered by the segmented row index (``orderBy().offset(n)``
    would pass every row through a single task); the filter keeps the rest.
    """
    def step(df: DataFrame) -> DataFrame:
        return scan.row_index(df, "_idx", order_by=order_by).filter(F.col("_idx") > n).drop("_idx")
    return step


def remove_last_rows(n: int, order_by) -> Step:
    """Drop the last n rows along a total order.

    Rows are numbered without a single-task window; the row count is one
    aggregate, so only rows with index > count - n are removed.
    """
    def step(df: DataFrame) -> DataFrame:
        idx = scan.row_index(df, "_idx", order_by=order_by)
        from tessera.operators.joins import attach_scalar
        total = df.agg(F.count(F.lit(1)).alias("_total"))
        return attach_scalar(idx, total).filter(F.col("_idx") <= F.col("_total") - n).drop("_idx", "_total")
    return step


def sample(fraction: float | None = None, n: int | None = None, seed: int = 42, order_by=None) -> Step:
    """Random sample by fraction, or the first n rows along an order."""
    if fraction is not None:
        return lambda df: df.sample(fraction=fraction, seed=seed)
    return lambda df: df.orderBy(*scan.sort_orders(order_by)).limit(n)


def sort(specs) -> Step:
    """Multi-column sort: names or (name, 'asc'|'desc')."""
    return lambda df: df.orderBy(*scan.sort_orders(specs))


def with_position(sorted_df: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a sorted DataFrame in the order in which it holds them, from 1."""
    kept = stored(sorted_df.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    return scan.row_index(kept, name, order_by=["_at"]).drop("_at")


def manual_sort_key(col: str, order: Sequence) -> Column:
    """Sort key from a hand-written member order; unlisted members go last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col))
    return F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1))


def sort_manual(col: str, order: Sequence, tie_breakers: Sequence[str] = ()) -> Step:
    return lambda df: df.orderBy(manual_sort_key(col, order), *tie_breakers)


def sort_computed(dim: str, measure: Column, descending: bool = True) -> Step:
    """Sort rows by an aggregate of another field per ``dim`` member."""
    def step(df: DataFrame) -> DataFrame:
        keys = df.groupBy(F.col(dim).alias("_sort_dim")).agg(measure.alias("_sort_key"))
        j = df.join(keys, df[dim].eqNullSafe(keys["_sort_dim"]), "left").drop("_sort_dim")
        o = F.col("_sort_key").desc_nulls_last() if descending else F.col("_sort_key").asc_nulls_last()
        return j.orderBy(o, F.col(dim)).drop("_sort_key")
    return step
