"""Registered queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import joins as J
from tessera.plans.registry import register
from tessera.sources.tables import Tables

_LK = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")


def _rich_customers(t):
    # Customers with a positive balance: some orders find no customer.
    return t.customer.filter(F.col("c_acctbal") > 2000).select("c_custkey", "c_name", "c_mktsegment")


@register("join_inner", f"SELECT {_LK}, o_orderdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_inner(spark, d):
    t = Tables(spark, d)
    return t.lineitem.select("l_orderkey", "l_linenumber").transform(
        J.join(_orders(t), "l_orderkey", "o_orderkey", how="inner", expand=["o_orderdate", "o_custkey"]))


@register("join_left", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders "
          "LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) c ON o_custkey = c_custkey")
def q_left(spark, d):
    t = Tables(spark, d)
    return t.orders.select("o_orderkey", "o_custkey").transform(
        J.join(_rich_customers(t), "o_custkey", "c_custkey", how="left"))


@register("join_right", "SELECT c.c_custkey AS o_custkey, o_orderkey, c_name, c_mktsegment FROM "
          "(SELECT * FROM orders WHERE o_orderstatus = 'F') o "
          "RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) c ON o_custkey = c_custkey")
def q_right(spark, d):
    t = Tables(spark, d)
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").transform(
        J.join(_rich_customers(t), "o_custkey", "c_custkey", how="right"))


@register("join_full", "SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, c_name, c_mktsegment FROM "
          "(SELECT * FROM orders WHERE o_orderstatus = 'F') o "
          "FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) c ON o_custkey = c_custkey")
def q_full(spark, d):
    t = Tables(spark, d)
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").transform(
        J.join(_rich_customers(t), "o_custkey", "c_custkey", how="full"))


@register("join_left_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN "
          "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_left_anti(spark, d):
    t = Tables(spark, d)
    return t.customer.select("c_custkey", "c_name").transform(
        J.join(t.orders.filter("o_orderstatus = 'P'").select("o_custkey"), "c_custkey", "o_custkey", how="leftOnly"))


@register("join_right_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN "
          "(SELECT c_custkey FROM customer WHERE c_acctbal > 2000)")
def q_right_anti(spark, d):
    t = Tables(spark, d)
    return t.customer.filter(F.col("c_acctbal") > 2000).select("c_custkey").transform(
        J.join(t.orders.select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey", how="rightOnly"))


@register("join_not_inner", """SELECT c_custkey, c_acctbal, NULL::BIGINT AS o_orderkey, NULL::BIGINT AS o_custkey
  FROM customer WHERE c_acctbal > 2000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT NULL, NULL, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)""")
def q_not_inner(spark, d):
    t = Tables(spark, d)
    return t.customer.filter(F.col("c_acctbal") > 2000).select("c_custkey", "c_acctbal").transform(
        J.join(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey",
               how="notInner"))


@register("join_multi_key", f"""SELECT {_LK}, l.l_partkey, l.l_suppkey, pair_qty FROM lineitem l JOIN
  (SELECT l_partkey, l_suppkey, sum(l_quantity) AS pair_qty FROM lineitem GROUP BY 1, 2) p
  ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey""")
def q_multi_key(spark, d):
    t = Tables(spark, d)
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("pair_qty"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").transform(
        J.join(pairs, ["l_partkey", "l_suppkey"], how="inner"))


@register("join_calculated_key", f"""SELECT {_LK}, o_orderdate, l_shipdate FROM lineitem JOIN orders
  ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY""")
def q_calc_key(spark, d):
    t = Tables(spark, d)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").transform(J.join_on(
        t.orders.select("o_orderkey", "o_orderdate"),
        lambda l_, o: (l_["l_orderkey"] == o["o_orderkey"]) & (l_["l_shipdate"] > fn.dateadd("day", 60, o["o_orderdate"])),
        "inner")).drop("o_orderkey")


@register("join_cross", """SELECT r_name, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM region
  CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s GROUP BY 1, 2""")
def q_cross(spark, d):
    t = Tables(spark, d)
    segs = t.customer.select("c_mktsegment").distinct()
    return t.region.select("r_name").transform(J.cross(segs)).groupBy(
        "r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@register("join_key_type_align", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_key_align(spark, d):
    t = Tables(spark, d)
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    c = J.align_key_types(o, c, "o_custkey", "c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@register("join_related", f"SELECT {_LK}, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def q_related(spark, d):
    t = Tables(spark, d)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").transform(
        J.related(t.supplier, "l_suppkey", ["s_name"], dim_key="s_suppkey")).drop("l_suppkey")


@register("join_lookupvalue", """SELECT o_orderkey, seg_of_customer, seg_of_nation FROM orders
  LEFT JOIN (SELECT c_custkey, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END
             AS seg_of_customer FROM customer GROUP BY c_custkey) a ON o_custkey = a.c_custkey
  LEFT JOIN (SELECT c_nationkey, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END
             AS seg_of_nation FROM customer GROUP BY c_nationkey) b ON o_custkey % 25 = b.c_nationkey""")
def q_lookupvalue(spark, d):
    t = Tables(spark, d)
    o = t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).alias("nk"))
    return (o.transform(J.lookupvalue(t.customer, "c_custkey", "c_mktsegment", "o_custkey", "seg_of_customer"))
            .transform(J.lookupvalue(t.customer, "c_nationkey", "c_mktsegment", "nk", "seg_of_nation"))
            .drop("o_custkey", "nk"))


@register("join_blend", """SELECT c_custkey, c_name, n_orders, round(total_spent, 2) AS total_spent FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spent FROM orders GROUP BY o_custkey) o
  ON c_custkey = o.o_custkey""")
def q_blend(spark, d):
    t = Tables(spark, d)
    out = t.customer.select("c_custkey", "c_name").transform(J.blend(
        t.orders, ["c_custkey"], [F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total_spent")],
        secondary_links=["o_custkey"]))
    return out.withColumn("total_spent", F.round("total_spent", 2))


def _pt(k):
    return fn.makepoint((F.col(k) % 170 - 85).cast("double"), (F.col(k) * 7 % 340 - 170).cast("double"))


_HAV = ("2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) "
        "+ cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))))")


@register("join_distance", f"""SELECT a.k AS c_custkey, b.k AS s_suppkey, round({_HAV}, 3) AS distance_km FROM
  (SELECT c_custkey AS k, CAST(c_custkey % 170 - 85 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 340 - 170 AS DOUBLE) AS lon
   FROM customer) a,
  (SELECT s_suppkey AS k, CAST(s_suppkey % 170 - 85 AS DOUBLE) AS lat, CAST(s_suppkey * 7 % 340 - 170 AS DOUBLE) AS lon
   FROM supplier) b WHERE {_HAV} <= 800""")
def q_distance(spark, d):
    t = Tables(spark, d)
    c = t.customer.select("c_custkey", _pt("c_custkey").alias("pt"))
    s = t.supplier.select("s_suppkey", _pt("s_suppkey").alias("pt"))
    out = J.within_distance(c, s, "pt", "pt", 800.0, "c_custkey", "s_suppkey")
    return out.withColumn("distance_km", fn.round_fast("distance_km", 3))


@register("join_distance_dense", f"""SELECT a.k AS c_custkey, b.k AS s_suppkey, round({_HAV}, 3) AS distance_km FROM
  (SELECT c_custkey AS k, 48 + (c_custkey * 37 % 1000) / 10000.0::DOUBLE AS lat, 2 + (c_custkey * 91 % 1000) / 5000.0::DOUBLE AS lon FROM customer) a,
  (SELECT s_suppkey AS k, 48 + (s_suppkey * 37 % 1000) / 10000.0::DOUBLE AS lat, 2 + (s_suppkey * 91 % 1000) / 5000.0::DOUBLE AS lon FROM supplier) b
  WHERE {_HAV} <= 4""")
def q_distance_dense(spark, d):
    # All points in one city: a quadtree of cells instead of one key.
    t = Tables(spark, d)

    def points(df, key):
        pt = fn.makepoint(48 + (F.col(key) * 37 % 1000) / F.lit(10000.0), 2 + (F.col(key) * 91 % 1000) / F.lit(5000.0))
        return df.select(key, pt.alias("pt"))
    out = J.within_distance(points(t.customer, "c_custkey"), points(t.supplier, "s_suppkey"), "pt", "pt", 4.0, "c_custkey", "s_suppkey", leaf=8)
    return out.withColumn("distance_km", fn.round_fast("distance_km", 3))
