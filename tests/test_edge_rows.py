"""Nulls, repeats, clashing names and wide rows: nothing is lost, and both plans of ordered operators agree."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import aggregates, analytics, joins, reshape, scan, sizing
from tessera.operators import tablecalc as tc
from tessera.streaming import incremental as inc


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------- sizes and plans

def test_measured_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("é"), 500).alias("t"), F.array_repeat(F.lit(1.0), 64).alias("a"),
                                 F.array(F.lit("abc"), F.lit(None)).alias("s"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    assert 100 * (1000 + 64 * 8) <= sizing.measured_bytes(df) <= 100 * (1000 + 64 * 8 + 150)
    assert sizing.measured_bytes(df.limit(0)) == 0
    spark.conf.set(sizing.SINGLE_TASK_CONF, "1000000")
    try:
        wide = spark.range(3000).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
        assert not sizing.fits_one_task(wide.withColumn("k", F.rand())) and sizing.fits_one_task(spark.range(1000).select(F.col("id") + 1))
        spark.conf.set(sizing.SEGMENT_BYTES_CONF, "100000")
        assert sizing.num_segments(wide) >= 30
    finally:
        spark.conf.unset(sizing.SINGLE_TASK_CONF)
        spark.conf.unset(sizing.SEGMENT_BYTES_CONF)


def wide(spark):
    """Spare columns that files cannot hold as they are: an interval, a void column and names that differ by case."""
    r = spark.range(60).select(
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("hot").alias("g"), F.col("id").alias("o"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 4).alias("v"), F.lit("x" * 2000).alias("spare"))
    return r.select("*", F.lit(1).alias("Spare"), F.lit(None).alias("nothing"), F.expr("make_interval(1, -2, 0, cast(o as int), 4, 5, 6.5)").alias("span"))


S_OPERATORS = {
    "prep_add_index": lambda s: lambda df: scan.row_index(df, "n", None, ["o"], skew_safe=s),
    "prep_fill_down": lambda s: lambda df: scan.fill(df, ["v"], ["g"], ["o"], skew_safe=s),
    "prep_fill_up": lambda s: lambda df: scan.fill(df, ["v"], ["g"], ["o"], "up", skew_safe=s),
    "running": lambda s: lambda df: scan.running(df, "v", ["g"], ["o"], aggs=("sum", "avg", "count", "min", "max"), skew_safe=s),
    "framed": lambda s: tc.window("avg", "v", "w", "g", "o", -2, 3, skew_safe=s),
    "median": lambda s: tc.window("median", "v", "w", "g", "o", -2, 3, skew_safe=s),
    "corr": lambda s: tc.window("corr", "v", "w", "g", "o", -4, 0, y="o", skew_safe=s),
    "half_open": lambda s: tc.window("var", "v", "w", "g", "o", None, 1, skew_safe=s),
    "countd": lambda s: tc.window("countd", "v", "w", "g", "o", -3, 0, skew_safe=s),
    "rank": lambda s: tc.rank("v", "r", "g", skew_safe=s),
    "rank_dense": lambda s: tc.rank("v", "r", "g", kind="dense", skew_safe=s),
    "rank_percentile": lambda s: tc.rank("v", "r", "g", kind="percentile", skew_safe=s),
    "rank_unique": lambda s: tc.rank("v", "r", "g", kind="unique", tie_breakers=["o"], skew_safe=s),
    "first": lambda s: tc.first("f", "g", "o", skew_safe=s),
    "last": lambda s: tc.last("l", "g", "o", skew_safe=s),
    "lookup": lambda s: tc.lookup("v", -2, "b", "g", "o", skew_safe=s),
    "previous_value": lambda s: tc.previous_value("v", 9, "p", "g", "o", skew_safe=s),
    "recurrence": lambda s: tc.recurrence("p", 9, 0.5, F.col("v"), partition_by="g", order_by="o", skew_safe=s),
    "difference": lambda s: tc.difference("v", "d", "g", "o", skew_safe=s),
    "percent_difference": lambda s: tc.percent_difference("v", "d", "g", "o", skew_safe=s),
    "moving_average": lambda s: analytics.moving_average("v", 3, "m", "g", "o", skew_safe=s),
}


@pytest.mark.parametrize("name", S_OPERATORS)
def test_both_plans_on_wide_rows(spark, name, monkeypatch):
    monkeypatch.setattr(scan, "_num_segments", lambda df, n: n or 3)
    op, df = S_OPERATORS[name], wide(spark)
    plain, cut = op(False)(df), op(True)(df)
    # The same columns, spare ones too; intervals compare as text.
    assert cut.columns == plain.columns and [t for _, t in cut.dtypes] == [t for _, t in plain.dtypes]
    text = lambda d: rows_of(d.toDF(*[f"c{i}" for i in range(len(d.columns))]).select(*[
        F.col(f"c{i}").cast("string") if t in ("interval", "void") else F.round(f"c{i}", 9).alias(f"c{i}") if t == "double" else F.col(f"c{i}")
        for i, (_, t) in enumerate(d.dtypes)]))
    assert text(cut) == text(plain) and len(text(cut)) == 60


def test_stored_columns_come_back(spark):
    df = wide(spark)
    back = session.stored(df, "test")
    assert back.dtypes == df.dtypes
    flat = lambda d: rows_of(d.toDF(*[f"c{i}" for i in range(7)]).select("c0", "c1", "c2", "c3", "c4", F.col("c6").cast("string")))
    assert flat(back) == flat(df)
    assert session.stored(spark.range(3).select(F.lit(None).alias("n")), "test").count() == 3


# ------------------------------------------------------------- percentiles

def test_percentiles_keep_groups_of_nulls(spark, monkeypatch):
    rows = [(1, 1.0), (2, None), (None, 4.0), (None, None), (3, None), (3, 7.0)] + [(9, float(k % 50)) for k in range(500)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for few in (4000, 100, 0):  # all groups by Spark's percentile, one bracketed, all bracketed
        monkeypatch.setattr(aggregates, "FEW", few)
        if few == 0:
            df = df.where("g is not null and g in (1, 9) and v is not null")
        got = {r.g: (r.m, r.p) for r in aggregates.exact_percentiles(["g"], "v", {"m": 0.5, "p": 0.9})(df).collect()}
        want = {9: (24.5, 45.0), 1: (1.0, 1.0)} | ({} if few == 0 else {2: (None, None), None: (4.0, 4.0), 3: (7.0, 7.0)})
        assert set(got) == set(want)
        assert got[9][0] == statistics.median(float(k % 50) for k in range(500)) and {k: got[k] for k in want if k != 9} == {k: want[k] for k in want if k != 9}
    none = spark.createDataFrame([], "g int, v double")
    assert aggregates.exact_percentiles(["g"], "v", {"m": 0.5})(none).count() == 0
    assert [r.m for r in aggregates.exact_percentiles([], "v", {"m": 0.5})(none).collect()] == [None]
    box = {r.g: r for r in analytics.box_plot("v", ["g"])(spark.createDataFrame(rows[:6], "g int, v double")).collect()}
    assert set(box) == {1, 2, 3, None}


# ------------------------------------------------------------- reshape

def test_union_of_mixed_types(spark):
    a = spark.createDataFrame([(1, 2.5, None), (None, 1.0, True)], "k int, n double, f boolean")
    b = spark.createDataFrame([("x", 7, "2024-01-01"), ("1", None, None)], "k string, n int, f string")
    out = reshape.union([b, spark.sql("SELECT DATE'2020-02-03' AS k, 5L AS extra")], "src", ["a", "b", "c"])(a)
    assert dict(out.dtypes) == {"k": "string", "n": "double", "f": "string", "src": "string", "extra": "bigint"}
    got = rows_of(out.select("k", "n", "f", "src", "extra"))
    assert got == sorted([("1", 2.5, None, "a", None), (None, 1.0, "true", "a", None), ("x", 7.0, "2024-01-01", "b", None),
                          ("1", None, None, "b", None), ("2020-02-03", None, None, "c", 5)], key=str)
    assert reshape.union([b.limit(0)])(a.limit(0)).count() == 0


@pytest.mark.parametrize("agg", ["count", "countd", "sum", "median"])
def test_pivot_is_the_same_with_a_null_member(spark, agg):
    rows = [(1, "a", 5), (1, "a", 5), (2, "b", None), (2, "null", 3)]
    with_null = spark.createDataFrame([*rows, (2, None, 8)], "k int, p string, v int")
    got = reshape.pivot("p", "v", agg)(with_null)
    assert got.columns == ["k", "a", "b", "null", "null_2"]
    plain = reshape.pivot("p", "v", agg)(spark.createDataFrame(rows, "k int, p string, v int"))
    assert rows_of(got.drop("null_2")) == rows_of(plain)
    assert {r.k: r.null_2 for r in got.collect()} == {1: None, 2: {"count": 1, "countd": 1, "sum": 8, "median": 8.0}[agg]}


def test_transpose_keeps_every_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a_2", 3), (None, 4), ("null", 5)], "k string, v int")
    out = reshape.transpose("k")(df)
    row = out.collect()[0].asDict()
    assert out.columns == ["key", "a", "a_3", "a_2", "null", "null_2"]
    assert (row["a"], row["a_3"], row["a_2"]) == ("1", "2", "3") and {row["null"], row["null_2"]} == {"4", "5"}
    with pytest.raises(ValueError):
        reshape.transpose("k", max_columns=4)(df)


# ------------------------------------------------------------- diff and merge

def test_table_diff_is_a_multiset_difference(spark):
    old = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "n"), (4, None), (5, "p"), (5, "q"), (6, "z")], "k int, v string")
    new = spark.createDataFrame([("x", 1, None), ("x", 1, None), ("y", 2, 3), ("n", None, None), (None, 4, None), ("q", 5, None), ("p", 5, None), ("w", 7, 1)],
                                "v string, k int, extra int")
    assert dict((r.k, r.change) for r in inc.table_diff(old, new, ["k"]).collect()) == {
        1: "unchanged", 2: "modified", None: "unchanged", 4: "unchanged", 5: "unchanged", 6: "removed", 7: "added"}
    counts = {(r.k, r.v, r.extra): (r.n_old, r.n_new) for r in inc.row_diff(old, new, ["k"]).collect()}
    assert counts[(1, "x", None)] == (2, 2) and counts[(2, "y", None)] == (1, 0) and counts[(2, "y", 3)] == (0, 1)
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    assert [r.change for r in inc.table_diff(old.where("k = 1"), one, ["k"]).collect()] == ["modified"]
    assert inc.table_diff(old.limit(0), new.limit(0), ["k"]).count() == 0
    maps = spark.sql("SELECT 1 AS k, map('a', 1, 'b', 2) AS m"), spark.sql("SELECT 1 AS k, map('b', 2, 'a', 1) AS m")
    assert [r.change for r in inc.table_diff(*maps, ["k"]).collect()] == ["unchanged"]


def test_merge_matches_null_keys(spark):
    target = spark.createDataFrame([(None, "old", "edit"), (1, "old", None)], "k int, v string, note string")
    source = spark.createDataFrame([(None, "new"), (2, "new")], "k int, v string")
    assert rows_of(inc.merge_preserve(target, source, ["k"], ["note"])) == sorted(
        [(None, "new", "edit"), (1, "old", None), (2, "new", None)], key=str)


def test_cross_join_with_maps_nulls_and_repeats(spark):
    left = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"a": 1, "b": 2}), (2, None), (None, {})], "x int, m map<string,int>")
    right = spark.createDataFrame([("p",), (None,)], "y string")
    got = sorted(str((r.x, r.m, r.y)) for r in left.transform(joins.cross(right)).collect())
    assert got == sorted(str((a.x, a.m, b.y)) for a in left.collect() for b in right.collect())
    assert left.transform(joins.cross(right.limit(0))).count() == 0
