"""Semantic layer, analytics pane, streaming and incremental jobs."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import analytics as AN
from tessera.operators import semantic as S
from tessera.streaming import incremental as inc
from tessera.streaming import kpi


def test_calendar_monday_one(spark):
    cal = S.calendar(spark, dt.date(2023, 12, 30), dt.date(2024, 1, 2))
    got = {r.Date: (r.DayOfWeek, r.DayName, r.Quarter) for r in cal.collect()}
    assert got[dt.date(2024, 1, 1)] == (1, "Monday", "Q1")
    assert got[dt.date(2023, 12, 31)] == (7, "Sunday", "Q4")
    assert cal.count() == 4


def test_bins_negative_and_groups(spark):
    df = spark.createDataFrame([(-0.5,), (-10.0,), (9.99,), (10.0,)], "x double")
    out = df.transform(S.bin_("x", 10, "b"))
    assert sorted(r.b for r in out.collect()) == [-10, -10, 0, 10]
    g = spark.createDataFrame([("a",), ("b",), (None,)], "v string").transform(
        S.group_values("v", {"AB": ["a", "b"]}, "grp"))
    assert sorted((r.v or "", r.grp) for r in g.collect()) == [("", "Other"), ("a", "AB"), ("b", "AB")]


def test_rls_mapping_and_fallback(spark):
    mapping = spark.createDataFrame([("alice", "EU"), ("alice", "US"), ("bob", "APAC")], "user string, value string")
    data = spark.createDataFrame([("EU", 1), ("US", 2), ("APAC", 3), ("carol", 4)], "region string, v int")
    alice = data.transform(S.rls_user_mapping(mapping, "alice", "region"))
    assert sorted(r.v for r in alice.collect()) == [1, 2]
    # no mapping: the column must equal the user name
    carol = data.transform(S.rls_user_mapping(mapping, "carol", "region"))
    assert [r.v for r in carol.collect()] == [4]
    mgr = data.transform(S.rls_group("managers", ["managers"], F.lit(False)))
    assert mgr.count() == 4


def test_relationship_discovery(spark):
    fact = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "f_id bigint, f_custid bigint")
    dim = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "d_custid bigint, d_name string")
    out = S.relationship_infer({"dim": dim, "fact": fact}).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.left_distinct, r.right_distinct, r.shared) == (3, 2, 2)
    card = S.relationship_cardinality(fact, "f_custid", dim, "d_custid").collect()[0]
    assert card.cardinality == "m:1"


def test_polynomial_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 200)
    y = 1.5 - 2.0 * x + 0.3 * x * x + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    r = df.transform(AN.trend_polynomial("x", "y", 2, ["g"])).collect()[0]
    exp = np.polyfit(x, y, 2)[::-1]
    assert np.allclose([r.c0, r.c1, r.c2], exp, atol=1e-6)


def test_trend_linear(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double")
    r = df.transform(AN.trend("x", "y")).collect()[0]
    assert abs(r.slope - 2) < 1e-9 and abs(r.intercept - 1) < 1e-9 and abs(r.r2 - 1) < 1e-9


def test_forecast_linear_series(spark):
    df = spark.createDataFrame([("s", t, 10.0 + 3 * t) for t in range(24)], "k string, t bigint, v double")
    out = df.transform(AN.forecast(["k"], "t", "v", periods=3, model="trend")).orderBy("t").collect()
    assert [r.t for r in out] == [24, 25, 26]
    for r in out:
        assert abs(r.forecast - (10 + 3 * r.t)) < 1e-6
        assert r.low <= r.forecast <= r.high


def test_mode_and_box(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("a", 3.0), ("b", 7.0)],
                               "g string, v double")
    m = {r.g: r.mode for r in AN.mode_of(df, ["g"], "v", "mode").collect()}
    assert m == {"a": 2.0, "b": 7.0}  # tie between 2 and 3 -> the smaller value
    box = {r.g: (r.min, r.median, r.max) for r in df.transform(AN.box_plot("v", ["g"])).collect()}
    assert box["a"] == (1.0, 2.0, 3.0)


def test_cluster_assigns_every_row(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(
        np.vstack([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))]))]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    out = df.transform(AN.cluster(["x", "y"], k=None, k_range=range(2, 4))).collect()
    assert len(out) == 40
    first = {r.cluster for r in out if r.id < 20}
    second = {r.cluster for r in out if r.id >= 20}
    assert len(first) == 1 and len(second) == 1 and first != second


def _scratch():
    return tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")


def test_append_stream_dedups(spark):
    src = _scratch()
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0), "a"), (1, dt.datetime(2024, 1, 1, 0, 5), "a-dup"),
            (2, dt.datetime(2024, 1, 1, 1, 0), "b")]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, v string")
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "in"))
    sink = os.path.join(src, "out")
    inc.append_stream(spark, os.path.join(src, "in"), "*.parquet", df.schema, "id", "ts", sink, sink + "-ck")
    got = spark.read.parquet(sink)
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_kpi_stream_reports_open_windows(spark):
    src = _scratch()
    rows = [(dt.datetime(2024, 1, 1, 10), 1.0), (dt.datetime(2024, 1, 2, 10), 2.0), (dt.datetime(2024, 1, 5, 10), 3.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "in"))
    agg = kpi.kpi_stream(stream, "ts", "day", [], {"total": F.sum("v")}, delay="1 day")
    out, query = kpi.run(spark, agg, os.path.join(src, "out"), os.path.join(src, "ck"), ["window_start", "window_end"])
    got = sorted((r.window_start.date(), r.total) for r in out.collect())
    # the window of Jan 5 is still open (watermark = Jan 4 10:00); it is there all the same
    assert got == [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 2.0), (dt.date(2024, 1, 5), 3.0)]
    assert kpi.late_rows(query) == 0


def _arrive(spark, src, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, "in", f"file{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "in", "*"))


def test_append_checked_keeps_every_row(spark):
    src, day = _scratch(), lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [
        [(1, day(1), 2**53 + 1), (1, day(1, 5), None), (None, day(2), 3), (2, None, 4), (3, day(10), 5)],
        [(4, day(2), 6), (1, day(10, 1), 7), (None, day(10, 2), 8), (5, day(20), 9), (5, day(20), 9)],
        [(3, day(19, 12), 10), (1, day(21), 11), (6, day(18), 12)],
    ]
    stream = _arrive(spark, src, batches, "id bigint, ts timestamp_ntz, v bigint")
    sink = os.path.join(src, "out")
    inc.append_checked(stream, "id", "ts", sink, sink + "-ck", delay="1 day", horizon="9 days")
    new = sorted(((r.id, r.ts, r.v) for r in inc.appended(spark, sink).collect()), key=str)
    # The new row of key 1 on day 1 is out of its horizon on day 10; key 3's on day 10 is on day 19.
    assert new == sorted([(1, day(1), 2**53 + 1), (None, day(2), 3), (3, day(10), 5), (1, day(10, 1), 7), (5, day(20), 9),
                          (3, day(19, 12), 10), (1, day(21), 11)], key=str)
    apart = sorted(((r.id, r.v, r._status, r._batch) for r in inc.quarantined(spark, sink).collect()), key=str)
    assert apart == sorted([(1, None, "duplicate", 0), (2, 4, "no_time", 0), (4, 6, "late", 1), (None, 8, "duplicate", 1), (5, 9, "duplicate", 1),
                            (6, 12, "late", 2)], key=str)
    assert inc.appended(spark, sink).columns == ["id", "ts", "v"]
    # Nothing new arrived: a second run adds nothing.
    inc.append_checked(spark.readStream.schema("id bigint, ts timestamp_ntz, v bigint").parquet(os.path.join(src, "in", "*")), "id", "ts", sink,
                       sink + "-ck", delay="1 day", horizon="9 days")
    assert inc.appended(spark, sink).count() + inc.quarantined(spark, sink).count() == 13


def test_calendar_periods_close(spark):
    src, at = _scratch(), lambda m, d: dt.datetime(2024, m, d, 12)
    batches = [[("a", at(1, 5), 1.0), ("a", at(1, 31), 2.0), (None, at(2, 1), 4.0)], [("a", at(4, 2), 8.0)],
               [("a", at(3, 30), 16.0)], [("a", at(1, 6), 32.0), ("a", at(4, 3), None)]]
    stream = _arrive(spark, src, batches, "g string, ts timestamp_ntz, v double")
    out, query = kpi.calendar_stream(spark, stream, "ts", "quarter", ["g"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))},
                                     os.path.join(src, "out"), os.path.join(src, "ck"), delay="5 days")
    got = sorted(((r.window_start.date(), r.window_end.date(), r.g, r.n, r.s, r.m, r.closed) for r in out.collect()), key=str)
    q1, q2, q3 = dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2024, 7, 1)
    # March 30 is within five days of April 2; January 6 is not, and counts as late.
    assert got == sorted([(q1, q2, "a", 3, 19.0, 16.0, False), (q1, q2, None, 1, 4.0, 4.0, False), (q2, q3, "a", 2, 8.0, 8.0, False)], key=str)
    assert kpi.late_rows(query) == 1
    assert kpi.watermark_ms(query, "5 days") == int(dt.datetime(2024, 3, 29, 12, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_table_diff_and_merge(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "c", 2.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, "b", 1.0), (3, "C", 2.0), (4, "d", None)], "k int, s string, x double")
    d = {r.k: r.change for r in inc.table_diff(old, new, ["k"]).collect()}
    assert d == {1: "removed", 2: "unchanged", 3: "modified", 4: "added"}
    target = old.withColumn("note", F.when(F.col("k") == 3, F.lit("keep me")))
    m = {r.k: (r.s, r.note) for r in inc.merge_preserve(target, new, ["k"], ["note"]).collect()}
    assert m == {1: ("a", None), 2: ("b", None), 3: ("C", "keep me"), 4: ("d", None)}


def test_refresh_policy(spark):
    src = _scratch()
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(100)]
    df = spark.createDataFrame(days, "d date, v double")
    path = os.path.join(src, "tbl")
    inc.initial_load(df.withColumn("v", F.lit(-1.0)), "d", path)
    out = inc.refresh_policy(df, "d", path, refresh_days=3, keep_days=60)
    got = {r.d: r.v for r in out.collect()}
    newest = dt.date(2024, 1, 1) + dt.timedelta(days=99)
    assert min(got) == newest - dt.timedelta(days=59)
    assert got[newest] == 99.0 and got[newest - dt.timedelta(days=2)] == 97.0


def test_kpi_week_windows_start_on_sunday(spark):
    src = _scratch()
    rows = [(dt.datetime(2024, 1, 6, 12), 1.0), (dt.datetime(2024, 1, 7, 12), 2.0), (dt.datetime(2024, 1, 30, 12), 5.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "in"))
    agg = kpi.kpi_stream(stream, "ts", "week", [], {"total": F.sum("v")}, delay="1 day")
    out, query = kpi.run(spark, agg, os.path.join(src, "out"), os.path.join(src, "ck"), ["window_start", "window_end"])
    got = sorted((r.window_start, r.total) for r in out.collect())
    # Saturday Jan 6 closes the week that began Sunday Dec 31; Sunday Jan 7 opens the next
    assert got == [(dt.datetime(2023, 12, 31), 1.0), (dt.datetime(2024, 1, 7), 2.0), (dt.datetime(2024, 1, 28), 5.0)]


def test_best_date_column(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.date(2024, 1, 2))],
                               "id int, loaded_at timestamp, order_date date")
    assert inc.best_date_column(df) == "order_date"
    assert inc.best_date_column(df.drop("order_date")) == "loaded_at"


def test_checked_append_reads_the_state_of_many_keys_once():
    """One read, write and timer for a group of keys and batch; before, each key cost its own."""
    calls = {"get": 0, "update": 0, "clear": 0, "timer": 0}

    class State:
        value = None

        def get(self):
            calls["get"] += 1
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            calls["update"] += 1
            self.value = value

        def clear(self):
            calls["clear"] += 1
            self.value = None

    class Handle:
        state = State()

        def getValueState(self, name, schema):
            return self.state

        def registerTimer(self, ms):
            calls["timer"] += 1

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    sorter = inc._Sorter(100)
    sorter.init(Handle())
    nan = float("nan")
    keys = [*range(500), None, nan, (1, "a"), [1, 2]]
    rows = [{"key": k, "ms": 50, "row": (str(k),)} for k in keys]
    first = [r.status for r in sorter.handleInputRows((0,), iter(rows), At(0))]
    again = [r.status for r in sorter.handleInputRows((0,), iter([{**r, "ms": 149 + i % 2} for i, r in enumerate(rows)]), At(0))]
    assert first == ["new"] * len(keys)
    assert sorted(again) == ["duplicate"] * 252 + ["new"] * 252
    assert calls == {"get": 2, "update": 2, "clear": 0, "timer": 2}
    # 149: every key last new at 50 is past its horizon at 150; those new at 150 stay until 250.
    assert list(sorter.handleExpiredTimer((0,), At(0), At(150))) == [] and calls["update"] == 3
    assert list(sorter.handleExpiredTimer((0,), At(0), At(250))) == [] and calls["clear"] == 1


def test_arrivals_of_many_files_are_still_three_batches(spark, sf_small, monkeypatch):
    from tessera.plans import catalog_streaming as cs

    want = sorted(map(tuple, cs.q_append_late(spark, sf_small).collect()), key=str)
    monkeypatch.setattr(cs, "FILE_ROWS", 40)
    files = cs._arrivals(spark, sf_small)[1]
    assert files > 1
    assert sorted(map(tuple, cs.q_append_late(spark, sf_small).collect()), key=str) == want
