"""Set operations and reshaping: union, unpivot, pivot, transpose, measure values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import scan

Step = Callable[[DataFrame], DataFrame]


def union(others: Sequence[DataFrame], source_col: str | None = None,
          source_names: Sequence[str] | None = None) -> Step:
    """Append tables by column name; columns missing on one side become null.  A
    column of numbers here and text (or dates, or flags) there becomes text.

    With ``source_col`` every row records which input it came from.
    """
    def step(df: DataFrame) -> DataFrame:
        frames = [df, *others]
        if source_col:
            names = list(source_names or [f"table{i + 1}" for i in range(len(frames))])
            frames = [f.withColumn(source_col, F.lit(n)) for f, n in zip(frames, names)]
        kinds: dict[str, list[T.DataType]] = {}
        for f in frames:
            for c in f.schema.fields:
                kinds.setdefault(c.name, []).append(c.dataType)
        text = {c for c, ts in kinds.items() if not _one_family(ts)}
        out = None
        for f in frames:
            f = f.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in text else F.col(f"`{c}`") for c in f.columns])
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out
    return step


def _one_family(types: Sequence[T.DataType]) -> bool:
    """True if Spark's union widens these types to one without changing what the values are."""
    types = [t for t in types if not isinstance(t, T.NullType)]
    families = [T.NumericType, (T.DateType, T.TimestampType, T.TimestampNTZType), T.StringType]
    return all(t == types[0] for t in types) or any(all(isinstance(t, f) for t in types) for f in families)


def unpivot(ids: Sequence[str], cols: Sequence[str], attribute: str = "Attribute",
            value: str = "Value") -> Step:
    """Columns -> rows; rows whose value is null are dropped."""
    return lambda df: df.unpivot(list(ids), list(cols), attribute, value).filter(F.col(value).isNotNull())


def unpivot_other(keep: Sequence[str], attribute: str = "Attribute", value: str = "Value") -> Step:
    """Unpivot every column except ``keep``."""
    def step(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c not in keep]
        return unpivot(keep, cols, attribute, value)(df)
    return step


def pivot(pivot_col: str, value_col: str, agg: str = "sum", values: Sequence | None = None,
          group_by: Sequence[str] | None = None) -> Step:
    """Rows -> columns with an aggregate.  Give ``values`` to skip the distinct
    pass; otherwise every distinct member becomes a column, null too (named
    ``null``, or ``null_2`` beside a member of that text): the members are the
    output's schema, so they are read.  A cell without rows is null, for counts too."""
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
           "countd": F.count_distinct, "median": F.median}

    def step(df: DataFrame) -> DataFrame:
        keys = list(group_by) if group_by is not None else [c for c in df.columns if c not in (pivot_col, value_col)]
        if values is not None:
            return df.groupBy(*keys).pivot(pivot_col, list(values)).agg(fns[agg](value_col))
        vals = [r[0] for r in df.select(pivot_col).distinct().collect()]
        members = sorted(v for v in vals if v is not None)
        if None not in vals:
            return df.groupBy(*keys).pivot(pivot_col, members).agg(fns[agg](value_col))
        # One conditional aggregate per member; as in a pivot, a cell that no row falls into is null.
        cell = lambda hit: F.when(F.count_if(hit) > 0, fns[agg](F.when(hit, F.col(value_col))))
        names = _distinct_names([*[str(v) for v in members], "null"])
        out = [cell(F.col(pivot_col).eqNullSafe(F.lit(v))).alias(n) for v, n in zip([*members, None], names)]
        return df.groupBy(*keys).agg(*out)
    return step


def _distinct_names(names: Sequence[str]) -> list[str]:
    """The names in order; one that is taken gets the first free ``_2``, ``_3``, ..."""
    taken, out = set(names), []
    used: set[str] = set()
    for n in names:
        new, k = n, 2
        while new in used or (new != n and new in taken):
            new, k = f"{n}_{k}", k + 1
        used.add(new)
        out.append(new)
    return out


def transpose(index_col: str, max_columns: int = 10_000) -> Step:
    """Rows <-> columns: each value column becomes a row, each row a column named
    by its ``index_col`` value (null: ``null``).  The second and further rows of a
    value, in the order of their other columns, get the first free of ``_2``,
    ``_3``, ...  Built from unpivot + pivot, so the work is a distributed
    aggregation; the driver counts the rows of each name, since names are the
    output's schema, and more than ``max_columns`` rows are an error."""
    def step(df: DataFrame) -> DataFrame:
        value_cols = [c for c in df.columns if c != index_col]
        named = df.select(F.coalesce(F.col(index_col).cast("string"), F.lit("null")).alias("_idx"),
                          *[F.col(c).cast("string").alias(c) for c in value_cols])
        counts = named.groupBy("_idx").agg(F.count(F.lit(1)).alias("n")).orderBy("_idx").limit(max_columns + 1).collect()
        if sum(r["n"] for r in counts) > max_columns:
            raise ValueError(f"transpose: over {max_columns} rows would become columns; raise max_columns")
        keys = [(r["_idx"], k) for r in counts for k in range(1, r["n"] + 1)]
        if all(k == 1 for _, k in keys):
            named = named.withColumn("_k", F.lit(1))
        else:
            named = scan.row_index(named, "_k", ["_idx"], value_cols)
        long = named.select(F.concat_ws(":", F.col("_k").cast("string"), "_idx").alias("_idx"), *value_cols).unpivot("_idx", value_cols, "key", "_v")
        wide = long.groupBy("key").pivot("_idx", [f"{k}:{n}" for n, k in keys]).agg(F.first("_v"))
        return wide.toDF("key", *_transposed_names(keys))
    return step


def _transposed_names(keys: Sequence[tuple[str, int]]) -> list[str]:
    """Column names: first rows keep their value's name, the others take free ones."""
    taken = {n for n, k in keys if k == 1}
    out = []
    for n, k in keys:
        new, j = n, 2
        while k > 1 and new in taken:
            new, j = f"{n}_{j}", j + 1
        taken.add(new)
        out.append(new)
    return out


def measure_values(group_by: Sequence[str], measures: Mapping[str, Column],
                   names_col: str = "Measure Names", values_col: str = "Measure Values") -> Step:
    """Measure Names / Measure Values: aggregate several measures, one row each."""
    def step(df: DataFrame) -> DataFrame:
        agg = df.groupBy(*group_by).agg(*[m.cast("double").alias(n) for n, m in measures.items()])
        return agg.unpivot(list(group_by), list(measures), names_col, values_col)
    return step
