"""Calculation functions on hand-made edge rows."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from tessera import functions as fn


def one(spark, col, data=None, schema="x int"):
    df = spark.createDataFrame(data or [(1,)], schema)
    return df.select(col.alias("r")).collect()[0]["r"]


def col_of(spark, col, data, schema):
    return [r["r"] for r in spark.createDataFrame(data, schema).select(col.alias("r")).collect()]


def test_strings(spark):
    assert one(spark, fn.char(F.lit(300))) == "Ĭ"
    assert one(spark, fn.char(F.lit(65))) == "A"
    assert one(spark, fn.find(F.lit("banana"), "an")) == 2
    assert one(spark, fn.find(F.lit("banana"), "an", 3)) == 4
    assert one(spark, fn.find(F.lit("banana"), "x")) == 0
    assert one(spark, fn.findnth(F.lit("banana"), "a", 3)) == 6
    assert one(spark, fn.findnth(F.lit("banana"), "a", 4)) == 0
    assert one(spark, fn.split(F.lit("a-b-c"), "-", -1)) == "c"
    assert one(spark, fn.split(F.lit("a-b-c"), "-", 0)) is None
    assert one(spark, fn.split(F.lit("a-b-c"), "-", 5)) == ""
    assert one(spark, fn.concat(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(spark, fn.combined_field([F.lit("a"), F.lit(None).cast("string"), F.lit(3)], "|")) == "a|3"
    assert one(spark, fn.proper(F.lit("hello wORLD"))) == "Hello World"
    assert one(spark, fn.max2(F.lit(None).cast("int"), F.lit(3))) == 3
    assert one(spark, fn.mid(F.lit("abcdef"), 2, 3)) == "bcd"
    assert one(spark, fn.space(F.lit(3))) == "   "


def test_regex(spark):
    assert one(spark, fn.regexp_extract(F.lit("order 123 x"), r"(\d+)")) == "123"
    assert one(spark, fn.regexp_extract(F.lit("none"), r"(\d+)")) is None
    assert one(spark, fn.regexp_extract(F.lit("ab12"), r"\d+")) == "12"
    assert one(spark, fn.regexp_extract_nth(F.lit("a1b2"), r"([a-z])(\d)([a-z])", 3)) == "b"
    assert one(spark, fn.regexp_replace(F.lit("a1b22"), r"\d+", "#")) == "a#b#"
    assert one(spark, fn.regexp_match(F.lit("xyz"), "y")) is True


def test_math_nulls_not_errors(spark):
    assert one(spark, fn.div(F.lit(7), F.lit(0))) is None
    assert one(spark, fn.div(F.lit(-7), F.lit(2))) == -3
    assert one(spark, fn.mod(F.lit(-7), F.lit(5))) == -2
    assert one(spark, fn.mod(F.lit(7), F.lit(0))) is None
    assert one(spark, fn.sqrt(F.lit(-4.0))) is None
    assert one(spark, fn.log(F.lit(0.0))) is None
    assert one(spark, fn.log(F.lit(8.0), 2)) == 3.0
    assert one(spark, fn.ln(F.lit(-1.0))) is None
    assert one(spark, fn.atan2(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, fn.acos(F.lit(2.0))) is None
    assert one(spark, fn.round_(F.lit(2.5), 0)) == 3.0
    assert one(spark, fn.round_(F.lit(-2.5), 0)) == -3.0
    assert one(spark, fn.sign(F.lit(-3.2))) == -1


def test_hexbin_nearest_centre(spark):
    # Brute force: the nearest centre among nearby lattice points.
    import random
    random.seed(1)
    pts = [(random.uniform(-10, 10), random.uniform(-10, 10)) for _ in range(200)]
    rows = spark.createDataFrame(pts, "x double, y double").select(
        "x", "y", fn.hexbinx("x", "y").alias("hx"), fn.hexbiny("x", "y").alias("hy")).collect()
    w = math.sqrt(3)
    centres = [((i + (j % 2) / 2) * w, 1.5 * j) for i in range(-12, 13) for j in range(-12, 13)]
    for r in rows:
        best = min(centres, key=lambda c: (c[0] - r.x) ** 2 + (c[1] - r.y) ** 2)
        d_best = (best[0] - r.x) ** 2 + (best[1] - r.y) ** 2
        d_got = (r.hx - r.x) ** 2 + (r.hy - r.y) ** 2
        assert abs(d_got - d_best) < 1e-9


def test_dates_boundaries(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 31), dt.date(2024, 2, 1))], "a date, b date")
    r = d.select(fn.datediff("month", "a", "b").alias("m"), fn.datediff("year", "a", "b").alias("y"),
                 fn.datediff("day", "a", "b").alias("d"),
                 fn.dateadd("month", 1, "a", is_date=True).alias("eom")).collect()[0]
    assert (r.m, r.y, r.d) == (1, 0, 1)
    assert r.eom == dt.date(2024, 2, 29)  # month end clamps
    # Sunday-start weeks around New Year: 2023-12-31 is a Sunday, 2024-01-06 a Saturday.
    wk = col_of(spark, fn.week("d"), [(dt.date(2024, 1, 1),), (dt.date(2024, 1, 6),), (dt.date(2024, 1, 7),),
                                      (dt.date(2023, 12, 31),), (dt.date(2023, 12, 30),)], "d date")
    assert wk == [1, 1, 2, 53, 52]
    ws = col_of(spark, fn.datetrunc("week", "d", is_date=True), [(dt.date(2024, 1, 3),)], "d date")
    assert ws == [dt.date(2023, 12, 31)]
    dw = col_of(spark, fn.datediff("week", "a", "b"), [(dt.date(2023, 12, 30), dt.date(2023, 12, 31))],
                "a date, b date")
    assert dw == [1]
    assert one(spark, fn.datename("weekday", F.lit(dt.date(2024, 1, 1)))) == "Monday"
    assert one(spark, fn.datepart("weekday", F.lit(dt.date(2024, 1, 7)))) == 1


def test_bad_casts_and_parsing(spark):
    assert one(spark, fn.int_(F.lit("1.5"))) == 1
    assert one(spark, fn.int_(F.lit("-2.7"))) == -2
    assert one(spark, fn.int_(F.lit("abc"))) is None
    assert one(spark, fn.float_(F.lit("x"))) is None
    assert one(spark, fn.isdate(F.lit("2024-02-30"))) is False
    assert one(spark, fn.isdate(F.lit("2024-02-28"))) is True
    assert one(spark, fn.isnumber(F.lit("12.5"))) is True
    assert one(spark, fn.makedate(2023, 2, 29)) is None
    assert one(spark, fn.makedate(2024, 2, 29)) == dt.date(2024, 2, 29)
    assert one(spark, fn.maketime(25, 0, 0)) is None
    assert one(spark, fn.maketime(9, 5, 7)) == "09:05:07"
    assert one(spark, fn.dateparse("dd/MM/yyyy", F.lit("31/01/2024"))) == dt.datetime(2024, 1, 31)
    assert one(spark, fn.dateparse("dd/MM/yyyy", F.lit("junk"))) is None


def test_logic(spark):
    assert one(spark, fn.iif(F.lit(None).cast("boolean"), "a", "b", "u")) == "u"
    assert one(spark, fn.if_([(F.lit(False), 1)])) is None
    assert one(spark, fn.zn(F.lit(None).cast("double"))) == 0
    assert one(spark, fn.case(F.lit("x"), [("y", 1)], 0)) == 0
    assert one(spark, fn.format_number(F.lit(1234567.891), "#,##0.00")) == "1,234,567.89"
    assert one(spark, fn.format_number(F.lit(0.125), "0.0%")) == "12.5%"
    assert one(spark, fn.format_number(F.lit(1234.5), "$#,##0")) == "$1,234"


def test_spatial(spark):
    p1 = fn.makepoint(F.lit(0.0), F.lit(0.0))
    p2 = fn.makepoint(F.lit(0.0), F.lit(1.0))
    km = one(spark, fn.distance(p1, p2))
    assert abs(km - 2 * math.pi * 6371.0088 / 360) < 1e-6
    sq = F.array(fn.makepoint(F.lit(0.0), F.lit(0.0)), fn.makepoint(F.lit(0.0), F.lit(2.0)),
                 fn.makepoint(F.lit(2.0), F.lit(2.0)), fn.makepoint(F.lit(2.0), F.lit(0.0)))
    assert one(spark, fn.area(sq)) == 4.0


def test_datediff_hours_ignore_session_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # wall clock 01:30 -> 03:30 on the US spring-forward day: two hour boundaries
        got = col_of(spark, fn.datediff("hour", "a", "b"),
                     [(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30))],
                     "a timestamp_ntz, b timestamp_ntz")
        assert got == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
