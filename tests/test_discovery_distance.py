"""Distance joins in dense places and value-based relationship discovery, against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import semantic as S

POINT = "id int, lat double, lon double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("radius,leaf", [(2.0, 3), (40.0, 5), (900.0, 4), (4000.0, 2), (40.0, 10_000)])
def test_dense_cells_lose_no_pair(spark, radius, leaf):
    r = random.Random(int(radius))
    city = [(48.85 + r.gauss(0, 0.05), 2.35 + r.gauss(0, 0.05)) for _ in range(60)]
    edge = [(r.uniform(-0.3, 0.3), r.choice([179.9, -179.9, 180.0, -180.0]) + r.uniform(-0.05, 0.05)) for _ in range(30)]
    pole = [(r.choice([89.95, -89.99, 90.0, 89.0]), r.uniform(-180, 180)) for _ in range(20)] + [(89.99, 0.0)] * 6
    pts = [(i, lat, lon if -180 <= lon <= 180 else lon - math.copysign(360, lon)) for i, (lat, lon) in enumerate(city + edge + pole + city[:5])]
    df = spark.createDataFrame(pts, POINT).select("id", F.struct("lat", "lon").alias("p"))
    out = J.within_distance(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "p", "p", radius, "a", "b", leaf=leaf)
    got = sorted((x.a, x.b) for x in out.collect())
    want = sorted((a[0], b[0]) for a in pts for b in pts if km(a, b) <= radius)
    unsure = {(a[0], b[0]) for a in pts for b in pts if abs(km(a, b) - radius) < 1e-6}
    assert [x for x in got if x not in unsure] == [x for x in want if x not in unsure] and len(set(got)) == len(got)


def test_null_points_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0)], POINT).select("id", F.struct("lat", "lon").alias("p"))
    none = df.limit(0)
    assert [(x.id, x.b) for x in J.within_distance(df, df.withColumnRenamed("id", "b"), "p", "p", 5.0, "id", "b", leaf=0).collect()] == [(1, 1)]
    assert J.within_distance(df, none.withColumnRenamed("id", "b"), "p", "p", 5.0, "id", "b").count() == 0


def test_discovery_by_values(spark):
    orders = spark.range(3000).select(F.col("id").alias("no"), (F.col("id") % 400).cast("int").alias("who"), F.when(F.col("id") % 3 == 0, "x").alias("flag"),
                                      F.lit(None).cast("string").alias("none"))
    people = spark.range(500).select(F.col("id").cast("short").alias("key"), F.concat(F.lit("n"), "id").alias("name"), F.rand(1).alias("ratio"))
    far = spark.range(10_000, 10_050).select(F.col("id").alias("code"), F.col("id").cast("string").alias("text"))
    got = {(r.left_table, r.left_column, r.right_table, r.right_column): (r.left_distinct, r.right_distinct, r.shared)
           for r in S.relationship_discover({"orders": orders, "people": people, "far": far}).collect()}
    # Text "10000" and number 10000 are no match, and one value is no evidence.
    assert got == {("orders", "who", "people", "key"): (400, 500, 400), ("orders", "no", "people", "key"): (3000, 500, 500)}
    part = S.relationship_discover({"a": spark.range(0, 100).toDF("x"), "b": spark.range(40, 140).toDF("y")}, 0.6).collect()
    assert [(r.shared, r.left_in_right) for r in part] == [(60, 0.6)]
    assert S.relationship_discover({"a": spark.range(0, 100).toDF("x"), "b": spark.range(41, 141).toDF("y")}, 0.6).count() == 0
    assert S.relationship_discover({"a": orders.limit(0), "b": people}).count() == 0 and S.relationship_discover({"a": people.select("ratio")}).count() == 0


def test_small_column_against_a_large_one(spark):
    """Few values of the small column are among the hashes that the large one's sketch keeps: still found."""
    large = spark.range(200_000).toDF("k")
    got = S.relationship_discover({"l": large, "s": spark.range(20).select((F.col("id") * 9973).alias("r"))}, lg_k=6).collect()
    assert [(r.left_distinct, r.right_distinct, r.shared) for r in got] == [(200_000, 20, 20)]


def test_collect_in_chunks(spark):
    df = spark.createDataFrame([(g, float(k % 7), float(-k)) for g in (1, None) for k in range(25)] + [(2, None, None)], "g int, lat double, lon double")
    df = df.select("g", F.struct("lat", "lon").alias("p"))
    got = A.collect_geometry(["g"], "p", chunk=10)(df).orderBy("g", "chunk").collect()
    assert [(r.g, r.chunk, len(r.points)) for r in got] == [(g, c, n) for g in (None, 1) for c, n in ((0, 10), (1, 10), (2, 5))]
    whole = {r.g: r.points for r in A.collect_geometry(["g"], "p")(df).collect()}
    assert [p for r in got if r.g == 1 for p in r.points] == whole[1]


def test_crowded_points_are_many_tasks(spark, monkeypatch):
    """One repeated point, read as one partition: its pairs are spread over tasks, and none is lost or made twice."""
    for name, value in (("BLOCK", 25), ("TASK_PAIRS", 5000)):
        monkeypatch.setattr(J, name, value, raising=False)
    r = random.Random(3)
    pts = [(i, 48.85, 2.35) for i in range(150)] + [(150 + i, 48.85 + r.gauss(0, 0.02), 2.35 + r.gauss(0, 0.02)) for i in range(150)]
    df = spark.createDataFrame(pts, POINT).select("id", F.struct("lat", "lon").alias("p")).coalesce(1)
    out = J.within_distance(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "p", "p", 1.5, "a", "b", leaf=8)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    want = {(a[0], b[0]): km(a, b) for a in pts for b in pts if km(a, b) <= 1.5}
    assert len(got) == len(want) and all(abs(want[x.a, x.b] - x.distance_km) < 1e-6 for x in got)
    crowd = [x.task for x in got if x.a < 150 and x.b < 150]
    assert len(crowd) == 150 * 150 and max(map(crowd.count, set(crowd))) < len(crowd) / 3


def shuffled_rows(df):
    """Rows that the shuffles of ``df`` have written in its own last run."""
    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan") or "QueryStage" in name:
            return walk(plan.executedPlan() if name.startswith("Adaptive") else plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def city(spark, n, seed, name):
    r = random.Random(seed)
    pts = [(i, 48.85 + r.uniform(0, 0.03), 2.35 + r.uniform(0, 0.03)) for i in range(n)]
    return spark.createDataFrame(pts, POINT).select(F.col("id").alias(name), F.struct("lat", "lon").alias("p"))


def test_copies_grow_as_the_rows(spark, monkeypatch):
    """Twice the points of both sides are four times the pairs, but twice the rows that are shuffled."""
    for name, value in (("TASK_PAIRS", 1_000_000), ("CORE_PAIRS", 1), ("LEAST_PAIRS", 4)):
        monkeypatch.setattr(J, name, value, raising=False)
    wrote = []
    for n in (6000, 12_000):
        out = J.within_distance(city(spark, n, 1, "a"), city(spark, n, 2, "b"), "p", "p", 30.0, "a", "b", leaf=10**6).agg(F.count(F.lit(1)), F.max("distance_km"))
        assert out.collect()[0][0] == n * n
        wrote.append(shuffled_rows(out))
    assert 12_000 <= wrote[0] and wrote[1] <= 2.2 * wrote[0]


def test_the_side_with_fewer_points_is_copied(spark):
    """Of 8,000 and 60 points in one city the 60 are copied to the parts around them, on either side of the join."""
    many, few = city(spark, 8000, 3, "a"), city(spark, 60, 4, "b")
    one, other = (J.within_distance(x, y, "p", "p", 1.0, i, k, leaf=8) for x, y, i, k in ((many, few, "a", "b"), (few, many, "b", "a")))
    assert one.columns == ["a", "b", "distance_km"] and other.columns == ["b", "a", "distance_km"]
    got = [{(r.a, r.b): r.distance_km for r in df.collect()} for df in (one, other)]
    right = few.collect()
    want = {(x.a, y.b): km((0, *x.p), (0, *y.p)) for x in many.collect() for y in right}
    same = got[0] == got[1] and got[0].keys() == {k for k, d in want.items() if d <= 1.0}
    assert same and all(abs(want[k] - d) < 1e-6 for k, d in got[0].items())
    assert max(shuffled_rows(df) for df in (one, other)) < 8000 + 60 * 144


def test_round_fast(spark):
    xs = [2.0005, -2.0005, 0.0, 1.4994999, 20015.0868, 1e300, float("nan"), float("inf"), None, -0.25]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(fn.round_fast("x", 3).alias("f"), F.round("x", 3).alias("r"), fn.round_fast("x", 1).alias("o")).collect()
    assert [str(g.f) for g in got] == [str(g.r) for g in got] and got[-1].o == -0.3
