"""Data-preparation steps (column and value operators).

Every function returns a ``DataFrame -> DataFrame`` step for ``df.transform``::

    df.transform(prep.rename({"o_orderkey": "order_id"})).transform(prep.trim(["name"]))
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.logic import to_integer
from tessera.operators import scan

Step = Callable[[DataFrame], DataFrame]


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


# ---------------------------------------------------------------- columns (2.2)

def rename(mapping: Mapping[str, str]) -> Step:
    return lambda df: df.withColumnsRenamed(dict(mapping))


def remove_columns(cols) -> Step:
    return lambda df: df.drop(*_cols(cols))


def select_columns(cols) -> Step:
    return lambda df: df.select(*_cols(cols))


def duplicate_column(src: str, new: str) -> Step:
    return lambda df: df.withColumn(new, F.col(src))


def reorder_columns(order: Sequence[str]) -> Step:
    """Put ``order`` first; the remaining columns follow in their old order."""
    def step(df: DataFrame) -> DataFrame:
        first = list(order)
        return df.select(*first, *[c for c in df.columns if c not in first])
    return step


def change_type(types: Mapping[str, str | T.DataType]) -> Step:
    """Typed cast; values that do not convert become null (never an error)."""
    def step(df: DataFrame) -> DataFrame:
        return df.withColumns({c: _try_cast(F.col(c), t) for c, t in types.items()})
    return step


def _try_cast(col: Column, t) -> Column:
    t_name = t if isinstance(t, str) else t.simpleString()
    if t_name in ("int", "integer", "bigint", "long", "smallint", "tinyint"):
        return to_integer(col, t_name)
    return col.try_cast(t_name)


def split_delimiter(col: str, delimiter: str, n: int, names: Sequence[str] | None = None) -> Step:
    """Split a text column into ``n`` columns (``col_1``..``col_n``); missing parts are null."""
    names = list(names) if names else [f"{col}_{i}" for i in range(1, n + 1)]

    def step(df: DataFrame) -> DataFrame:
        parts = F.split(F.col(col), re.escape(delimiter), -1)
        return df.withColumns({nm: F.try_element_at(parts, F.lit(i + 1)) for i, nm in enumerate(names)})
    return step


def split_position(col: str, positions: Sequence[int], names: Sequence[str] | None = None) -> Step:
    """Split text at 0-based character offsets (e.g. [0, 3, 6] -> 3 slices)."""
    pos = list(positions)
    names = list(names) if names else [f"{col}_{i}" for i in range(1, len(pos) + 1)]

    def step(df: DataFrame) -> DataFrame:
        out = {}
        for i, nm in enumerate(names):
            start = pos[i] + 1
            if i + 1 < len(pos):
                out[nm] = F.substring(F.col(col), start, pos[i + 1] - pos[i])
            else:
                out[nm] = F.substr(F.col(col), F.lit(start))
        return df.withColumns(out)
    return step


def merge_columns(cols: Sequence[str], new: str, separator: str = "") -> Step:
    """Join text of several columns into one and drop the sources."""
    def step(df: DataFrame) -> DataFrame:
        merged = F.concat_ws(separator, *[F.col(c).cast("string") for c in cols])
        return df.withColumn(new, merged).drop(*[c for c in cols if c != new])
    return step


def add_column(name: str, expr: Column, dtype: str | None = None) -> Step:
    return lambda df: df.withColumn(name, expr if dtype is None else _try_cast(expr, dtype))


def conditional_column(name: str, conditions: Sequence[tuple[Column, object]], default=None) -> Step:
    """if c1 then v1 else if c2 then v2 ... else default."""
    def step(df: DataFrame) -> DataFrame:
        out = None
        for cond, val in conditions:
            v = val if isinstance(val, Column) else F.lit(val)
            out = F.when(cond, v) if out is None else out.when(cond, v)
        if default is not None:
            out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
        return df.withColumn(name, out)
    return step


def add_index(name: str, order_by, start: int = 0, increment: int = 1, partition_by=None) -> Step:
    """Index column along a total order, computed without a single-task window."""
    return lambda df: scan.row_index(df, name, partition_by=partition_by, order_by=order_by,
                                     start=start, step=increment)


def promote_headers(order_by) -> Step:
    """The first row (by ``order_by``) becomes the column names and is removed."""
    def step(df: DataFrame) -> DataFrame:
        orders = scan.sort_orders(order_by)
        first = df.orderBy(*orders).limit(1).collect()  # one row
        if not first:
            return df
        header = [str(v) if v is not None else f"Column{i + 1}" for i, v in enumerate(first[0])]
        cond = None
        for f, v in zip(df.schema.fields, first[0]):
            term = F.col(f"`{f.name}`").eqNullSafe(F.lit(v).cast(f.dataType))
            cond = term if cond is None else cond & term
        # Rows equal to the header row stay, but for one of them.
        more = df.filter(cond).count() - 1
        body = df.filter(~cond)
        if more:
            same = df.sparkSession.range(more).select(
                *[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(df.schema.fields, first[0])])
            body = body.union(same)
        return body.toDF(*header)
    return step


def demote_headers(index_col: str | None = None) -> Step:
    """Column names become the first row; columns are renamed Column1..N (text).

    With ``index_col`` (an existing order column) the header row gets the
    smallest index so order is kept.
    """
    def step(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c != index_col]
        new = [f"Column{i + 1}" for i in range(len(cols))]
        header = df.sparkSession.createDataFrame([tuple(cols)], schema=T.StructType(
            [T.StructField(n, T.StringType()) for n in new]))
        body = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(cols, new)],
                         *([F.col(index_col).cast("long").alias("_row")] if index_col else []))
        if index_col:
            header = header.withColumn("_row", F.lit(-1).cast("long"))
        return header.unionByName(body)
    return step


# ---------------------------------------------------------------- values (2.3)

def replace_text(col: str, old: str, new: str) -> Step:
    """Replace every occurrence of a substring."""
    return lambda df: df.withColumn(col, F.replace(F.col(col), F.lit(old), F.lit(new)))


def replace_value(col: str, old, new) -> Step:
    """Replace whole values equal to ``old`` (null-safe)."""
    return lambda df: df.withColumn(col, F.when(F.col(col).eqNullSafe(F.lit(old)), F.lit(new))
                                    .otherwise(F.col(col)))


def replace_nulls(defaults: Mapping[str, object]) -> Step:
    return lambda df: df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def _map_cols(fn: Callable[[Column], Column], cols) -> Step:
    return lambda df: df.withColumns({c: fn(F.col(c)) for c in _cols(cols)})


def trim(cols) -> Step:
    return _map_cols(F.trim, cols)


def clean_nonprintable(cols) -> Step:
    """Remove control characters."""
    return _map_cols(lambda c: F.regexp_replace(c, r"\p{Cntrl}+", ""), cols)


def remove_letters(cols) -> Step:
    return _map_cols(lambda c: F.regexp_replace(c, r"\p{L}+", ""), cols)


def remove_numbers(cols) -> Step:
    return _map_cols(lambda c: F.regexp_replace(c, r"\p{N}+", ""), cols)


def remove_punctuation(cols) -> Step:
    return _map_cols(lambda c: F.regexp_replace(c, r"\p{P}+", ""), cols)


def upper(cols) -> Step:
    return _map_cols(F.upper, cols)


def lower(cols) -> Step:
    return _map_cols(F.lower, cols)


def proper(cols) -> Step:
    return _map_cols(F.initcap, cols)


def fill_down(cols, order_by, partition_by=None, skew_safe: bool | None = None) -> Step:
    """Carry the last non-null value forward along ``order_by``."""
    return lambda df: scan.fill(df, _cols(cols), partition_by, order_by, "down", skew_safe)


def fill_up(cols, order_by, partition_by=None, skew_safe: bool | None = None) -> Step:
    """Carry the next non-null value backward along ``order_by``."""
    return lambda df: scan.fill(df, _cols(cols), partition_by, order_by, "up", skew_safe)


def group_replace(col: str, groupings: Mapping[str, Sequence[str]]) -> Step:
    """Map many spellings to one value; unmapped values stay.

    The map is literal and bounded by the user's list, so it is inlined as a
    ``map`` expression (no join, no shuffle).
    """
    def step(df: DataFrame) -> DataFrame:
        pairs = []
        for target, members in groupings.items():
            for m in members:
                pairs += [F.lit(m), F.lit(target)]
        if not pairs:
            return df
        m = F.create_map(*pairs)
        return df.withColumn(col, F.coalesce(F.try_element_at(m, F.col(col)), F.col(col)))
    return step


def extract_values(col: str, pattern: str, new: str, group: int = 1) -> Step:
    """New column with the pattern's group; null when the pattern is absent."""
    return lambda df: df.withColumn(new, F.when(F.col(col).rlike(pattern),
                                                F.regexp_extract(F.col(col), pattern, group)))


def extract_before(col: str, delimiter: str, new: str) -> Step:
    """Text before the first delimiter (whole text when absent)."""
    return lambda df: df.withColumn(new, F.substring_index(F.col(col), delimiter, 1))


def extract_after(col: str, delimiter: str, new: str) -> Step:
    """Text after the first delimiter (null when absent)."""
    def step(df: DataFrame) -> DataFrame:
        pos = F.instr(F.col(col), delimiter)
        return df.withColumn(new, F.when(pos > 0, F.substr(F.col(col), pos + len(delimiter))))
    return step


def extract_between(col: str, start: str, end: str, new: str) -> Step:
    """Text between the first ``start`` and the next ``end`` (null when absent)."""
    def step(df: DataFrame) -> DataFrame:
        pos = F.instr(F.col(col), start)
        after = F.when(pos > 0, F.substr(F.col(col), pos + len(start)))
        return df.withColumn(new, F.when(F.instr(after, end) > 0, F.substring_index(after, end, 1)))
    return step


def pad(col: str, length: int, char: str = "0", side: str = "left") -> Step:
    fn = F.lpad if side == "left" else F.rpad
    return lambda df: df.withColumn(col, fn(F.col(col).cast("string"), length, char))


def remove_errors(types: Mapping[str, str]) -> Step:
    """Drop rows where a value is present but does not convert to its type."""
    def step(df: DataFrame) -> DataFrame:
        bad = None
        for c, t in types.items():
            term = F.col(c).isNotNull() & _try_cast(F.col(c), t).isNull()
            bad = term if bad is None else bad | term
        return df.filter(~bad).withColumns({c: _try_cast(F.col(c), t) for c, t in types.items()})
    return step


def replace_errors(types: Mapping[str, str], replacement) -> Step:
    """Convert; values that fail to convert get ``replacement`` (nulls stay null)."""
    def step(df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.coalesce(_try_cast(F.col(c), t),
                          F.when(F.col(c).isNotNull(), F.lit(replacement).try_cast(t)))
            for c, t in types.items()})
    return step


def try_otherwise(name: str, expr: Column, fallback) -> Step:
    """Expression with a fallback where it has no value (use ``try_*`` forms inside)."""
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return lambda df: df.withColumn(name, F.coalesce(expr, fb))
