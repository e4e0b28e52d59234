"""Level-of-detail expressions.

* FIXED d: aggregate at d on the (context-filtered) base rows, join back on d.
* FIXED with no dims / table-scoped: one global aggregate attached to all rows.
* INCLUDE d: aggregate at view + d, then re-aggregate to the view.
* EXCLUDE d: aggregate at view - d, joined onto the view's marks.

Joins back are null-safe (a null dimension member is a member) and run as
shuffle joins that AQE can convert to broadcast (the LOD side has one row per
member) or split when a member is hot — never a window that would put one
member's rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import attach_scalar

Step = Callable[[DataFrame], DataFrame]


def _join_on_dims(df: DataFrame, agg: DataFrame, dims: Sequence[str]) -> DataFrame:
    r = agg.withColumnsRenamed({d: f"_lod_{d}" for d in dims})
    cond = None
    for d in dims:
        t = df[d].eqNullSafe(r[f"_lod_{d}"])
        cond = t if cond is None else cond & t
    return df.join(r, cond, "left").drop(*[f"_lod_{d}" for d in dims])


def fixed(dims: Sequence[str], aggs: Mapping[str, Column], base: DataFrame | None = None) -> Step:
    """{FIXED dims : AGG} as new columns.  ``base`` (default: the input) is the
    row set the aggregate sees — pass the context-filtered rows to have
    dimension filters applied after the LOD."""
    dims = list(dims)

    def step(df: DataFrame) -> DataFrame:
        src = base if base is not None else df
        agg = src.groupBy(*dims).agg(*[a.alias(n) for n, a in aggs.items()])
        if not dims:
            return attach_scalar(df, agg)
        return _join_on_dims(df, agg, dims)
    return step


def fixed_global(aggs: Mapping[str, Column], base: DataFrame | None = None) -> Step:
    """{FIXED : AGG} — one value for the whole table."""
    return fixed([], aggs, base)


def table(aggs: Mapping[str, Column], base: DataFrame | None = None) -> Step:
    """{AGG(x)} with no keyword: same as a global FIXED."""
    return fixed([], aggs, base)


def include(view_dims: Sequence[str], include_dims: Sequence[str], inner: Column,
            outer: Callable[[Column], Column], name: str) -> Step:
    """{INCLUDE d : inner} re-aggregated to the view with ``outer`` (e.g. AVG)."""
    def step(df: DataFrame) -> DataFrame:
        fine = df.groupBy(*view_dims, *include_dims).agg(inner.alias("_inc"))
        return fine.groupBy(*view_dims).agg(outer(F.col("_inc")).alias(name))
    return step


def exclude(view: DataFrame, view_dims: Sequence[str], exclude_dims: Sequence[str],
            agg: Column, name: str) -> Step:
    """{EXCLUDE d : agg} on base rows, attached to the aggregated ``view``.

    Returns a step on the *base rows* producing the view with the new column.
    """
    coarse = [d for d in view_dims if d not in set(exclude_dims)]

    def step(base: DataFrame) -> DataFrame:
        a = base.groupBy(*coarse).agg(agg.alias(name))
        if not coarse:
            return attach_scalar(view, a)
        return _join_on_dims(view, a, coarse)
    return step


def aggregate_of(view_dims: Sequence[str], lod_col: str, outer: Callable[[Column], Column],
                 name: str) -> Step:
    """AGG({LOD}): aggregate a joined LOD column at the view level."""
    return lambda df: df.groupBy(*view_dims).agg(outer(F.col(lod_col)).alias(name))
