"""Flagship: a sales prep flow on the order tables, end to end.

read lineitem / orders / customer / nation / region -> rename, trim, proper
case, replace nulls, filter status, add revenue -> joins -> group by region and
segment (sum revenue, distinct orders, average quantity) -> percent of total
and rank within region -> sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import filters, joins, prep, tablecalc
from tessera.plans.registry import register, sql_initcap
from tessera.sources.tables import Tables


def sales_by_region_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    orders = (t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
              .transform(prep.rename({"o_orderkey": "order_id", "o_custkey": "customer_id",
                                      "o_orderstatus": "status"}))
              .transform(filters.exclude_values("status", ["P"])))
    lines = (t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
             .transform(prep.add_column("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))))
    customers = (t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
                 .transform(prep.trim(["c_mktsegment"]))
                 .transform(prep.proper(["c_mktsegment"]))
                 .transform(prep.rename({"c_mktsegment": "segment"})))
    geo = (t.nation.select("n_nationkey", "n_regionkey")
           .join(t.region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
           .select("n_nationkey", F.initcap("r_name").alias("region")))
    rows = (lines.join(orders, F.col("l_orderkey") == F.col("order_id"), "inner")
            .transform(joins.join(customers, "customer_id", "c_custkey", how="left", expand=["c_nationkey", "segment"]))
            .transform(joins.related(geo, "c_nationkey", ["region"], dim_key="n_nationkey"))
            .transform(prep.replace_nulls({"region": "Unknown", "segment": "Unknown"})))
    view = rows.transform(A.group_by(["region", "segment"], {
        "revenue": A.sum_("revenue"),
        "n_orders": A.countd("order_id"),
        "avg_qty": A.avg("l_quantity"),
    }))
    # The view has one row per (region, segment): bounded by the dimension
    # sizes, so plain windows (total and rank) are the right plans here.
    view = (view.transform(tablecalc.percent_of_total("revenue", "pct_of_total", skew_safe=False))
            .transform(tablecalc.rank("revenue", "rank_in_region", partition_by=["region"], skew_safe=False)))
    return view.select(
        "region", "segment", F.round("revenue", 2).alias("revenue"), "n_orders",
        F.round("avg_qty", 4).alias("avg_qty"), F.round("pct_of_total", 6).alias("pct_of_total"),
        "rank_in_region",
    ).orderBy("region", "rank_in_region")


FLAGSHIP_SQL = f"""
WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
           WHERE o_orderstatus NOT IN ('P') OR o_orderstatus IS NULL),
l AS (SELECT l_orderkey, l_quantity, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem),
g AS (SELECT n_nationkey, {sql_initcap('r_name')} AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT l.*, o.order_id, coalesce(g.region, 'Unknown') AS region,
             coalesce({sql_initcap('trim(c.c_mktsegment)')}, 'Unknown') AS segment
      FROM l JOIN o ON l.l_orderkey = o.order_id
      LEFT JOIN customer c ON c.c_custkey = o.customer_id
      LEFT JOIN g ON g.n_nationkey = c.c_nationkey),
v AS (SELECT region, segment, sum(revenue) AS revenue, count(DISTINCT order_id) AS n_orders,
             avg(l_quantity) AS avg_qty FROM j GROUP BY region, segment)
SELECT region, segment, round(revenue, 2) AS revenue, n_orders, round(avg_qty, 4) AS avg_qty,
       round(revenue / sum(revenue) OVER (), 6) AS pct_of_total,
       rank() OVER (PARTITION BY region ORDER BY revenue DESC) AS rank_in_region
FROM v
"""

register("flagship_sales_flow", FLAGSHIP_SQL)(sales_by_region_segment)
