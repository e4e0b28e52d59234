"""Semantic layer: calendar, time intelligence, sets, groups, bins, hierarchies,
aliases, parameters, measure/dimension switches, row-level security and
relationship discovery on data.

Lookup maps (groups, aliases, parameters, security mappings) are user-sized
literal tables: they are inlined as ``map`` expressions or attached as
broadcast joins whose size is bounded by the user's list.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import scan
from tessera.operators.joins import attach_scalar, broadcast_if_small

Step = Callable[[DataFrame], DataFrame]


# ----------------------------------------------------------------- calendar

def calendar(spark: SparkSession, start: _dt.date, end: _dt.date, num_partitions: int | None = None) -> DataFrame:
    """Date dimension: one row per day with Year, Quarter ("Q1"), Month,
    MonthName, Day, DayOfWeek (Monday = 1) and DayName.

    Days are generated by ``spark.range`` (split over partitions), not by
    exploding one array in one task.
    """
    n = (end - start).days + 1
    parts = num_partitions or max(1, min(n // 10000 + 1, 64))
    days = spark.range(0, n, 1, parts).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("Date"))
    return days.select(
        "Date", F.year("Date").alias("Year"), F.concat(F.lit("Q"), F.quarter("Date")).alias("Quarter"),
        F.month("Date").alias("Month"), F.date_format("Date", "MMMM").alias("MonthName"),
        F.dayofmonth("Date").alias("Day"), ((F.dayofweek("Date") + 5) % 7 + 1).alias("DayOfWeek"),
        F.date_format("Date", "EEEE").alias("DayName"))


def calendar_for(df: DataFrame, date_col: str) -> DataFrame:
    """Calendar spanning the data's own date range (one aggregate row read back)."""
    lo, hi = df.agg(F.min(F.col(date_col).cast("date")), F.max(F.col(date_col).cast("date"))).first()
    return calendar(df.sparkSession, lo, hi)


def date_hierarchy(cols: Sequence[str]) -> Step:
    """Year / Quarter / Month / Day columns for each date column."""
    def step(df: DataFrame) -> DataFrame:
        out = {}
        for c in cols:
            out.update({f"{c}_Year": F.year(c), f"{c}_Quarter": F.quarter(c),
                        f"{c}_Month": F.month(c), f"{c}_Day": F.dayofmonth(c)})
        return df.withColumns(out)
    return step


# ----------------------------------------------------------------- time intelligence

def ytd(value: str, date_col: str, name: str = "ytd", partition_by: Sequence[str] = ()) -> Step:
    """Year-to-date running total along ``date_col`` (skew-safe running sum)."""
    def step(df: DataFrame) -> DataFrame:
        d = df.withColumn("_year", F.year(date_col))
        out = scan.running(d, value, [*partition_by, "_year"], [date_col], aggs=("sum",), prefix="_ytd_")
        return out.withColumnRenamed("_ytd_sum", name).drop("_year")
    return step


def previous_year(value: str, date_col: str, name: str = "py", keys: Sequence[str] = ()) -> Step:
    """Same period last year: self-join on ``date - 12 months`` (and keys)."""
    def step(df: DataFrame) -> DataFrame:
        prev = df.select(*keys, F.add_months(F.col(date_col).cast("date"), 12).alias("_py_date"),
                         F.col(value).alias(name))
        cond = F.col(date_col).cast("date") == prev["_py_date"]
        for k in keys:
            cond = cond & df[k].eqNullSafe(prev[k])
        out = df.join(prev, cond, "left")
        return out.select(*[df[c] for c in df.columns], prev[name])
    return step


def yoy_percent(current: str, prior: str, name: str = "yoy_pct") -> Step:
    """(current - prior) / prior; 0 when the prior is zero or missing."""
    return lambda df: df.withColumn(name, F.coalesce(
        F.try_divide(F.col(current) - F.col(prior), F.col(prior)), F.lit(0.0)))


# ----------------------------------------------------------------- sets, groups, bins

def set_members(col: str, members: Sequence, name: str) -> Step:
    """In/Out flag for a listed set (no member cap)."""
    return lambda df: df.withColumn(name, F.coalesce(F.col(col).isin(list(members)), F.lit(False)))


def set_members_from(members: DataFrame, col: str, name: str, member_col: str | None = None) -> Step:
    """In/Out flag when the set is itself a table: a left join to the distinct
    members (broadcast only after the member count is checked)."""
    mc = member_col or col

    def step(df: DataFrame) -> DataFrame:
        m = broadcast_if_small(members.select(F.col(mc).alias("_m")).distinct())
        return df.join(m.withColumn("_in", F.lit(True)), df[col] == m["_m"], "left").drop("_m") \
            .withColumn(name, F.coalesce(F.col("_in"), F.lit(False))).drop("_in")
    return step


def set_condition(cond: Column, name: str) -> Step:
    return lambda df: df.withColumn(name, F.coalesce(cond, F.lit(False)))


def group_values(col: str, groups: Mapping[str, Sequence], name: str, other: str | None = "Other") -> Step:
    """value -> group label; unlisted values get ``other`` (or keep themselves when None)."""
    def step(df: DataFrame) -> DataFrame:
        pairs = []
        for label, members in groups.items():
            for m in members:
                pairs += [F.lit(m), F.lit(label)]
        looked = F.try_element_at(F.create_map(*pairs), F.col(col).cast("string")) if pairs else F.lit(None)
        fallback = F.lit(other) if other is not None else F.col(col).cast("string")
        return df.withColumn(name, F.coalesce(looked, fallback))
    return step


def group_combined(cols: Sequence, name: str, separator: str = " | ") -> Step:
    """Combined group of several fields (Columns or names), joined by ' | '."""
    return lambda df: df.withColumn(name, F.concat_ws(separator, *[
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def bin_(col: str, size: float, name: str) -> Step:
    """Bin start: floor(x / size) * size (negative values bin downward)."""
    return lambda df: df.withColumn(name, F.floor(F.col(col) / size) * size)


def hierarchy_rollup(levels: Sequence[str], aggs: Mapping[str, Column]) -> Step:
    """Aggregates at every level of a drill path (rollup) with the level depth."""
    def step(df: DataFrame) -> DataFrame:
        out = df.rollup(*levels).agg(*[a.alias(n) for n, a in aggs.items()], F.grouping_id().alias("_gid"))
        lvl = F.lit(len(levels))
        for i, _ in enumerate(levels):
            lvl = lvl - F.shiftright(F.col("_gid"), len(levels) - 1 - i).bitwiseAND(1)
        return out.withColumn("level", lvl.cast("int")).drop("_gid")
    return step


def alias(col: str, aliases: Mapping, name: str | None = None) -> Step:
    """Display aliases for member values; unaliased values show themselves."""
    def step(df: DataFrame) -> DataFrame:
        pairs = []
        for k, v in aliases.items():
            pairs += [F.lit(k), F.lit(v)]
        m = F.create_map(*pairs)
        return df.withColumn(name or col, F.coalesce(F.try_element_at(m, F.col(col)), F.col(col).cast("string")))
    return step


# ----------------------------------------------------------------- parameters

def param_range(spark: SparkSession, lo: float, hi: float, step: float, name: str = "value") -> DataFrame:
    """Range parameter domain lo, lo+step, ..., <= hi."""
    n = int((hi - lo) // step) + 1
    return spark.range(0, n).select((F.lit(lo) + F.col("id") * F.lit(step)).alias(name))


def param_list(spark: SparkSession, values: Sequence, name: str = "value") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], [name])


def param_members(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """List parameter domain: the members of a column, as a DataFrame of any size."""
    return df.select(F.col(column).alias(name)).distinct()


def param_value(value, default=None) -> Column:
    """A scalar parameter inlined as a literal (folded by Catalyst)."""
    return F.lit(value if value is not None else default)


def param_query(spark: SparkSession, query: str, args: Mapping | None = None) -> DataFrame:
    """Parameter domain read from a query, with bound parameters (no string splicing)."""
    return spark.sql(query, args=dict(args or {})).distinct()


def what_if(values: Sequence[float], param: str, group_by: Sequence[str], measure: Callable[[Column], Column],
            name: str) -> Step:
    """Evaluate a measure for every parameter value.

    The (user-sized) value list is attached by ``explode`` of a literal array —
    a generator on each row, no join and no shuffle before the aggregation —
    then one grouped aggregation over (parameter, groups).
    """
    def step(df: DataFrame) -> DataFrame:
        vals = F.array(*[F.lit(float(v)) for v in values])
        return df.withColumn(param, F.explode(vals)).groupBy(param, *group_by).agg(
            measure(F.col(param)).alias(name))
    return step


def measure_switch(measures: Mapping[str, Column], group_by: Sequence[str], choice: str | None = None,
                   name: str = "value") -> Step:
    """Calculation group / measure parameter: the chosen measure, or every
    measure as (measure, value) rows when ``choice`` is None."""
    def step(df: DataFrame) -> DataFrame:
        if choice is not None:
            return df.groupBy(*group_by).agg(measures[choice].alias(name))
        agg = df.groupBy(*group_by).agg(*[m.cast("double").alias(k) for k, m in measures.items()])
        return agg.unpivot(list(group_by), list(measures), "measure", name)
    return step


def dimension_switch(allowed: Sequence[str], choice: str, aggs: Mapping[str, Column],
                     name: str = "dimension") -> Step:
    """Field parameter: group by the chosen column (checked against an allow-list)."""
    if choice not in allowed:
        raise ValueError(f"{choice!r} is not one of {list(allowed)}")
    return lambda df: df.groupBy(F.col(choice).cast("string").alias(name)).agg(
        *[a.alias(n) for n, a in aggs.items()])


# ----------------------------------------------------------------- row-level security

def rls_user_mapping(mapping: DataFrame, user: str, col: str, user_col: str = "user",
                     value_col: str = "value") -> Step:
    """Keep rows whose ``col`` is allowed for ``user`` by a mapping table; when the
    user has no mapping the column must equal the user name.

    The user's mapping rows are few (checked by size estimate before a
    broadcast hint); whether any exist is a scalar subquery, so building the
    step runs no job.
    """
    def step(df: DataFrame) -> DataFrame:
        mine = mapping.filter(F.col(user_col) == F.lit(user))
        allowed = broadcast_if_small(mine.select(F.col(value_col).alias("_allowed")).distinct()
                                     .withColumn("_ok", F.lit(True)))
        has_map = mine.agg((F.count(F.lit(1)) > 0).alias("_has_map"))
        j = attach_scalar(df.join(allowed, df[col] == allowed["_allowed"], "left"), has_map)
        keep = F.when(F.col("_has_map"), F.coalesce(F.col("_ok"), F.lit(False))).otherwise(F.col(col) == F.lit(user))
        return j.filter(keep).drop("_allowed", "_ok", "_has_map")
    return step


def rls_expression(predicate: Callable[[Column], Column], user: str) -> Step:
    """User filter such as ``[col] = USERNAME()``: the predicate gets the user as a literal."""
    return lambda df: df.filter(predicate(F.lit(user)))


def is_member_of(group: str, user_groups: Sequence[str]) -> Column:
    """ISMEMBEROF("g") for the current user's groups (a constant, folded)."""
    return F.lit(group in set(user_groups))


def rls_group(group: str, user_groups: Sequence[str], otherwise: Column) -> Step:
    """Members of ``group`` see everything; others see rows where ``otherwise`` holds."""
    return lambda df: df.filter(is_member_of(group, user_groups) | F.coalesce(otherwise, F.lit(False)))


# ----------------------------------------------------------------- relationships

def _key_stem(col: str) -> str | None:
    """'o_custkey' -> 'custkey'; only key-like columns (…key / …id) take part."""
    base = col.split("_", 1)[1] if "_" in col else col
    low = base.lower()
    return low if (low.endswith("key") or low.endswith("id")) else None


def relationship_candidates(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """Column pairs of different tables with the same key stem (schema only)."""
    cols = [(t, c, _key_stem(c)) for t, df in tables.items() for c in df.columns]
    cols = [x for x in cols if x[2]]
    out = []
    for i, (t1, c1, s1) in enumerate(cols):
        for t2, c2, s2 in cols[i + 1:]:
            if t1 != t2 and s1 == s2:
                a, b = sorted([(t1, c1), (t2, c2)])
                out.append((a[0], a[1], b[0], b[1]))
    return sorted(set(out))


def relationship_infer(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Candidate relationships with value evidence computed on the data.

    For each name candidate: distinct values per side and how many of the left
    distinct values occur on the right (and vice versa).  Each side is reduced
    to its distinct keys first (partial aggregation), then one full outer join
    of the two distinct sets counts both containments.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for lt, lc, rt, rc in relationship_candidates(tables):
        left = tables[lt].select(F.col(lc).alias("_k")).filter(F.col("_k").isNotNull()).distinct() \
            .withColumn("_l", F.lit(1))
        right = tables[rt].select(F.col(rc).cast(tables[lt].schema[lc].dataType).alias("_k")) \
            .filter(F.col("_k").isNotNull()).distinct().withColumn("_r", F.lit(1))
        j = left.join(right, "_k", "full")
        parts.append(j.agg(
            F.count("_l").alias("left_distinct"), F.count("_r").alias("right_distinct"),
            F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("shared"),
        ).select(F.lit(lt).alias("left_table"), F.lit(lc).alias("left_column"), F.lit(rt).alias("right_table"),
                 F.lit(rc).alias("right_column"), "left_distinct", "right_distinct", "shared"))
    if not parts:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in
                               ["left_table", "left_column", "right_table", "right_column"]])
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({
        "left_in_right": F.try_divide(F.col("shared"), F.col("left_distinct")),
        "right_in_left": F.try_divide(F.col("shared"), F.col("right_distinct")),
    })


# Columns are compared within these families, as text.
_FAMILIES = {"byte": "number", "short": "number", "integer": "number", "long": "number", "string": "text", "date": "date"}


def relationship_discover(tables: Mapping[str, DataFrame], min_containment: float = 0.95, lg_k: int = 12, min_distinct: int = 2) -> DataFrame:
    """Column pairs of different tables, whatever their names, where nearly all values of one occur in the other.

    One scan of each table sketches every whole-number, text and date column (Spark's theta sketches: the smallest
    ``2 ** lg_k`` hashes of the distinct values).  Sketches of two columns give the share of one in the other; a
    pair is dropped if that lies four standard errors under ``min_containment``.  A second scan counts the values
    that survivors share, exactly: each distinct value meets the numbers of its columns once, and one row of
    counts comes back.  The driver holds one sketch per column (at most 2 ** lg_k * 8 bytes).

    Rows as :func:`relationship_infer`, of the pairs whose exact containment either way is at least
    ``min_containment``.  Nulls are no values; columns of under ``min_distinct`` values are left out.
    """
    spark = next(iter(tables.values())).sparkSession
    cols = [(t, f.name, _FAMILIES[f.dataType.typeName()]) for t, df in tables.items() for f in df.schema.fields if f.dataType.typeName() in _FAMILIES]
    sketches, parts = {}, []
    for t, df in tables.items():
        own = [c for x, c, _ in cols if x == t]
        if own:
            aggs = [F.theta_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(lg_k)).alias(f"s{i}") for i, c in enumerate(own)]
            parts.append(df.agg(*aggs).select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), F.col(f"s{i}").alias("s"))
                                                                  for i, c in enumerate(own)])).alias("x")).select("x.*"))
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    schema = ("left_table string, left_column string, right_table string, right_column string, left_distinct bigint, right_distinct bigint, "
              "shared bigint, left_in_right double, right_in_left double")
    if not parts:
        return spark.createDataFrame([], schema)
    for r in parts[0].select("t", "c", "s", F.theta_sketch_estimate("s").alias("n")).collect():
        sketches[r["t"], r["c"]] = (bytes(r["s"]), r["n"])
    pairs = [(i, j) for i, a in enumerate(cols) for j, b in enumerate(cols) if a[0] < b[0] and a[2] == b[2]
             and min(sketches[a[:2]][1], sketches[b[:2]][1]) >= min_distinct]
    if not pairs:
        return spark.createDataFrame([], schema)
    side = spark.createDataFrame([(i, j, bytearray(sketches[cols[i][:2]][0]), bytearray(sketches[cols[j][:2]][0]), sketches[cols[i][:2]][1],
                                   sketches[cols[j][:2]][1]) for i, j in pairs], "i int, j int, a binary, b binary, na bigint, nb bigint")
    both = F.theta_sketch_estimate(F.theta_intersection("a", "b"))
    small, large = F.least("na", "nb").cast("double"), F.greatest("na", "nb")
    # The smaller column's values among the hashes that the larger one's sketch reaches.
    sample = F.greatest(small * F.least(F.lit(1.0), F.lit(2**lg_k) / large), F.lit(1.0))
    near = [(r["i"], r["j"]) for r in side.where(both / small >= min_containment - 4 / F.sqrt(sample)).select("i", "j").collect()]
    if not near:
        return spark.createDataFrame([], schema)
    # Exact counts of the survivors: (family, value) -> the columns that hold it.
    used = sorted({i for p in near for i in p})
    values = None
    for t, df in tables.items():
        own = [i for i in used if cols[i][0] == t]
        if own:
            v = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(cols[i][2]).alias("f"), F.col(f"`{cols[i][1]}`").cast("string").alias("v"))
                                              for i in own])).alias("x")).select("x.*").where("v IS NOT NULL").distinct()
            values = v if values is None else values.unionByName(v)
    held = values.groupBy("f", "v").agg(F.collect_list("i").alias("at"))
    has = lambda i: F.array_contains("at", i)
    counts = held.agg(*[F.count_if(has(i)).alias(f"n{i}") for i in used], *[F.count_if(has(i) & has(j)).alias(f"s{i}_{j}") for i, j in near])
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip((*cols[i][:2], *cols[j][:2]), ("left_table", "left_column", "right_table", "right_column"))],
                     F.col(f"n{i}").alias("left_distinct"), F.col(f"n{j}").alias("right_distinct"), F.col(f"s{i}_{j}").alias("shared")) for i, j in near]
    out = counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumns({
        "left_in_right": F.try_divide("shared", "left_distinct"), "right_in_left": F.try_divide("shared", "right_distinct")})
    return out.where((F.greatest("left_in_right", "right_in_left") >= min_containment) & (F.least("left_distinct", "right_distinct") >= min_distinct))


def relationship_cardinality(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """'one' or 'many' per side from row count vs distinct count -> 1:1, m:1, 1:m, m:n."""
    l_ = key_stats(left, [left_key]).select(F.col(f"{left_key}__rows").alias("left_rows"),
                                            F.col(f"{left_key}__distinct").alias("left_distinct"))
    r_ = key_stats(right, [right_key]).select(F.col(f"{right_key}__rows").alias("right_rows"),
                                              F.col(f"{right_key}__distinct").alias("right_distinct"))
    return _cardinality(attach_scalar(l_, r_))


def _cardinality(j: DataFrame) -> DataFrame:
    lone = F.col("left_rows") == F.col("left_distinct")
    rone = F.col("right_rows") == F.col("right_distinct")
    card = (F.when(lone & rone, "1:1").when(~lone & rone, "m:1").when(lone & ~rone, "1:m").otherwise("m:n"))
    return j.withColumn("cardinality", card)


def key_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: non-null count and distinct count of each key column, in one
    aggregation pass (partial aggregation map-side)."""
    aggs = []
    for k in keys:
        aggs += [F.count(k).alias(f"{k}__rows"), F.count_distinct(k).alias(f"{k}__distinct")]
    return df.agg(*aggs)


def relationship_cardinalities(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Cardinality of every name-candidate relationship.  Each table is scanned
    once for the statistics of all its key columns; the per-pair table is
    assembled from those one-row results (a handful of numbers per table)."""
    pairs = relationship_candidates(tables)
    cols: dict[str, list[str]] = {}
    for lt, lc, rt, rc in pairs:
        cols.setdefault(lt, []).append(lc)
        cols.setdefault(rt, []).append(rc)
    # One job for every table: each table's statistics unpivoted to one row per
    # key column, all unioned, read back once (a few numbers per key column).
    parts = []
    for t, cs in cols.items():
        keys = sorted(set(cs))
        one = key_stats(tables[t], keys).select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("column"), F.col(f"{k}__rows").cast("long").alias("rows"),
                     F.col(f"{k}__distinct").cast("long").alias("distinct")) for k in keys])).alias("s"))
        parts.append(one.select(F.lit(t).alias("table"), "s.*"))
    union = parts[0]
    for p_ in parts[1:]:
        union = union.unionByName(p_)
    stats: dict[str, dict[str, int]] = {}
    for r in union.collect():
        stats.setdefault(r["table"], {}).update({f"{r['column']}__rows": r["rows"],
                                                 f"{r['column']}__distinct": r["distinct"]})
    spark = next(iter(tables.values())).sparkSession
    rows = [(f"{lt}.{lc}", f"{rt}.{rc}", stats[lt][f"{lc}__rows"], stats[lt][f"{lc}__distinct"],
             stats[rt][f"{rc}__rows"], stats[rt][f"{rc}__distinct"]) for lt, lc, rt, rc in pairs]
    df = spark.createDataFrame(rows, "left_key string, right_key string, left_rows bigint, left_distinct bigint, "
                                     "right_rows bigint, right_distinct bigint")
    return _cardinality(df)
