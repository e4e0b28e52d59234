"""A worksheet view composed from the operators, in the order the BI model
evaluates it:

    base rows -> data-source & context filters -> FIXED LODs -> dimension filters
    -> group by the view's dimensions -> INCLUDE / EXCLUDE LODs -> table
    calculations -> totals -> sort / top-n

Each stage is a lazy DataFrame transformation, so the whole view is one
Catalyst plan: filters reach the scan, unused columns are pruned, and AQE
picks join strategies and partition counts at runtime.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import lod

Step = Callable[[DataFrame], DataFrame]


@dataclass
class ViewSpec:
    dims: Sequence[str]
    measures: Mapping[str, Column]
    datasource_filters: Sequence[Step] = ()
    context_filters: Sequence[Step] = ()
    fixed_lods: Sequence[tuple[Sequence[str], Mapping[str, Column]]] = ()
    dimension_filters: Sequence[Step] = ()
    measure_filters: Sequence[Column] = ()
    view_lods: Sequence[Step] = ()          # INCLUDE / EXCLUDE steps on (base, view)
    table_calcs: Sequence[Step] = ()
    totals: str | None = None               # None | "rollup" | "cube"
    sort: Sequence = ()
    top_n: int | None = None
    extra: dict = field(default_factory=dict)


def view(base: DataFrame, spec: ViewSpec) -> DataFrame:
    rows = base
    for f in spec.datasource_filters:
        rows = f(rows)
    ctx = rows
    for f in spec.context_filters:
        ctx = f(ctx)
    # FIXED LODs see the context-filtered rows, before dimension filters.
    for dims, aggs in spec.fixed_lods:
        ctx = ctx.transform(lod.fixed(dims, aggs, base=ctx))
    filtered = ctx
    for f in spec.dimension_filters:
        filtered = f(filtered)
    if spec.totals:
        out = filtered.transform(A.totals(list(spec.dims), dict(spec.measures), spec.totals))
    else:
        out = filtered.groupBy(*spec.dims).agg(*[m.alias(n) for n, m in spec.measures.items()])
    for cond in spec.measure_filters:
        out = out.filter(cond)
    for step in spec.view_lods:
        out = step(filtered, out)
    for step in spec.table_calcs:
        out = step(out)
    if spec.sort:
        from tessera.operators.scan import sort_orders
        out = out.orderBy(*sort_orders(list(spec.sort)))
    if spec.top_n:
        out = out.limit(spec.top_n)
    return out


def exclude_step(view_dims: Sequence[str], exclude_dims: Sequence[str], agg: Column, name: str):
    """EXCLUDE LOD as a view step: (filtered base rows, view) -> view with the column."""
    def step(base: DataFrame, v: DataFrame) -> DataFrame:
        return base.transform(lod.exclude(v, view_dims, exclude_dims, agg, name))
    return step


def include_step(view_dims: Sequence[str], include_dims: Sequence[str], inner: Column,
                 outer: Callable[[Column], Column], name: str):
    """INCLUDE LOD as a view step, joined onto the view by its dimensions."""
    def step(base: DataFrame, v: DataFrame) -> DataFrame:
        inc = base.transform(lod.include(view_dims, include_dims, inner, outer, name))
        r = inc.withColumnsRenamed({d: f"_inc_{d}" for d in view_dims})
        cond = None
        for d in view_dims:
            t = v[d].eqNullSafe(r[f"_inc_{d}"])
            cond = t if cond is None else cond & t
        return v.join(r, cond, "left").drop(*[f"_inc_{d}" for d in view_dims])
    return step


def measure(name: str) -> Column:
    return F.col(name)
