"""Skew-safe scans against a plain-Python model, on random skewed inputs.

Few segments are forced so that groups (and the hot group in particular)
span several range partitions, which is where carried values matter.
"""

from __future__ import annotations

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import scan

rows_st = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]),   # skewed key with nulls
              st.integers(0, 40),                                         # order value (ties)
              st.one_of(st.none(), st.integers(-5, 20))),                 # value with nulls
    min_size=0, max_size=60)

SCHEMA = "g string, o int, v int"


def _df(spark, rows):
    data = [(g, o, v, i) for i, (g, o, v) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA + ", id int")


def _model_groups(rows):
    groups = defaultdict(list)
    for i, (g, o, v) in enumerate(rows):
        groups[g].append((o, i, v))
    for g in groups:
        groups[g].sort()
    return groups


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_st)
def test_running_and_index(spark, rows):
    df = _df(spark, rows)
    out = scan.running(df, "v", ["g"], ["o", "id"], aggs=("sum", "count", "min", "max"), num_segments=3, skew_safe=True)
    out = scan.row_index(out, "idx", ["g"], ["o", "id"], num_segments=3, skew_safe=True)
    got = {r.id: (r.running_sum, r.running_count, r.running_min, r.running_max, r.idx) for r in out.collect()}
    for g, items in _model_groups(rows).items():
        s, c, mn, mx = None, 0, None, None
        for k, (o, i, v) in enumerate(items, 1):
            if v is not None:
                s = v if s is None else s + v
                c += 1
                mn = v if mn is None else min(mn, v)
                mx = v if mx is None else max(mx, v)
            assert got[i] == (s, c, mn, mx, k)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_st)
def test_ranks(spark, rows):
    df = _df(spark, rows).filter("v is not null")
    out = scan.ranks(df, "v", ["g"], ascending=False, kinds=("rank", "dense", "modified", "percentile"),
                     num_segments=3, skew_safe=True)
    got = {r.id: (r.rank, r.dense, r.modified, r.percentile) for r in out.collect()}
    groups = defaultdict(list)
    for i, (g, o, v) in enumerate(rows):
        if v is not None:
            groups[g].append((v, i))
    for g, items in groups.items():
        vals = sorted((v for v, _ in items), reverse=True)
        distinct = sorted(set(vals), reverse=True)
        n = len(vals)
        for v, i in items:
            rank = vals.index(v) + 1
            dense = distinct.index(v) + 1
            modified = sum(1 for x in vals if x >= v)
            pct = (rank - 1) / (n - 1) if n > 1 else 0.0
            assert got[i][:3] == (rank, dense, modified)
            assert abs(got[i][3] - pct) < 1e-12


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_st)
def test_fill_down_and_up(spark, rows):
    df = _df(spark, rows)
    down = {r.id: r.v for r in scan.fill(df, ["v"], ["g"], ["o", "id"], "down", True, num_segments=3).collect()}
    up = {r.id: r.v for r in scan.fill(df, ["v"], ["g"], ["o", "id"], "up", True, num_segments=3).collect()}
    for g, items in _model_groups(rows).items():
        last = None
        for o, i, v in items:
            last = v if v is not None else last
            assert down[i] == last
        nxt = None
        for o, i, v in reversed(items):
            nxt = v if v is not None else nxt
            assert up[i] == nxt


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_st, st.integers(-3, 0), st.integers(0, 2))
def test_framed_window(spark, rows, lo, hi):
    from pyspark.sql import functions as F
    df = _df(spark, rows)
    out = scan.framed(df, {"w": lambda w: F.sum("v").over(w.rowsBetween(lo, hi)),
                           "prev": lambda w: F.lag("v", 1).over(w)},
                      ["g"], ["o", "id"], lo, hi, skew_safe=True, block=4, num_segments=3)
    got = {r.id: (r.w, r.prev) for r in out.collect()}
    for g, items in _model_groups(rows).items():
        for k, (o, i, v) in enumerate(items):
            frame = [x[2] for x in items[max(0, k + lo): k + hi + 1] if x[2] is not None]
            exp = sum(frame) if frame else None
            prev = items[k - 1][2] if k > 0 else None
            assert got[i] == (exp, prev)


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA + ", id int")
    assert scan.running(df, "v", ["g"], ["o"]).count() == 0
    assert scan.row_index(df, "i", None, ["o"]).count() == 0


def test_hot_key_spreads_over_segments(spark):
    from pyspark.sql import functions as F
    # one key holds a third of the rows
    df = spark.range(3000).select((F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                   .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))).alias("g"),
                                  F.col("id").alias("o"))
    seg = scan.segment(df, ["g"], ["o"], num_segments=8)
    hot_segments = seg.filter("g = 'hot'").select(scan.SEG).distinct().count()
    assert hot_segments >= 3
    sizes = [r["count"] for r in seg.groupBy(scan.SEG).count().collect()]
    assert max(sizes) <= 2 * (3000 / 8)   # no segment holds the hot key alone


def test_segmented_equals_plain_on_many_rows(spark):
    """200,000 rows, several input partitions and an unused column, with and without exchange reuse."""
    from pyspark.sql import functions as F
    df = (spark.range(200_000, numPartitions=6)
          .select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("g"),
                  (F.xxhash64("id") % 5000).alias("o"), F.col("id"),
                  F.when(F.col("id") % 7 != 0, (F.xxhash64("id", F.lit(1)) % 100).cast("int")).alias("v"),
                  F.concat(F.lit("payload"), "id").alias("unused")))
    calls = [lambda **k: scan.row_index(df, "i", ["g"], ["o", "id"], **k),
             lambda **k: scan.running(df, "v", ["g"], ["o", "id"], aggs=("sum", "max", "avg"), **k),
             lambda **k: scan.ranks(df, "v", ["g"], kinds=("rank", "dense", "modified", "percentile"), **k),
             lambda **k: scan.fill(df, ["v"], ["g"], ["o", "id"], "down", **k),
             lambda **k: scan.framed(df, {"p": lambda w: F.lag("v", 3).over(w), "s": lambda w: F.sum("v").over(w.rowsBetween(-2, 1))},
                                     ["g"], ["o", "id"], 0, 0, **k)]
    reuse = spark.conf.get("spark.sql.exchange.reuse", "true")
    try:
        for call in calls:
            plain = call(skew_safe=False)
            want = plain.select(F.count("*"), F.bit_xor(F.xxhash64(*plain.columns))).first()
            for on in ("true", "false"):
                spark.conf.set("spark.sql.exchange.reuse", on)
                got = call(skew_safe=True, num_segments=7)
                assert got.schema == plain.schema or [f.dataType for f in got.schema] == [f.dataType for f in plain.select(*got.columns).schema]
                assert got.select(*plain.columns).select(F.count("*"), F.bit_xor(F.xxhash64(*plain.columns))).first() == want
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_running_max_of_a_date(spark):
    df = spark.sql("SELECT id, date_add(date'2020-01-01', cast(id * 7 % 11 AS int)) AS d FROM range(20)")
    rows = [sorted(tuple(r) for r in scan.running(df, "d", None, ["id"], aggs=("max",), skew_safe=s, num_segments=3).collect()) for s in (True, False)]
    assert rows[0] == rows[1]


def test_framed_unbounded_frame_is_refused(spark):
    import pytest
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = _df(spark, [("a", 1, 1)])
    with pytest.raises(ValueError):
        scan.framed(df, {"s": lambda w: F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))}, ["g"], ["o"], skew_safe=True)
