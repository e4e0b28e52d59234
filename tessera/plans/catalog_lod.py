"""Registered queries: level-of-detail expressions and context filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import filters as flt
from tessera.operators import lod
from tessera.plans.registry import register
from tessera.sources.tables import Tables


def _oc(t):
    """Orders with the customer's nation and segment (base rows of the view)."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_nationkey", "c_mktsegment")


_OC_SQL = ("(SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, c_nationkey, c_mktsegment "
           "FROM orders JOIN customer ON o_custkey = c_custkey)")


@register("lod_fixed", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS cust_total "
          "FROM orders")
def q_fixed(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    out = o.transform(lod.fixed(["o_custkey"], {"cust_total": F.sum("o_totalprice")}))
    return out.select("o_orderkey", F.round("cust_total", 2).alias("cust_total"))


@register("lod_fixed_global", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (), 8) AS share_of_max "
          "FROM orders")
def q_fixed_global(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    out = o.transform(lod.fixed_global({"max_price": F.max("o_totalprice")}))
    return out.select("o_orderkey", F.round(F.col("o_totalprice") / F.col("max_price"), 8).alias("share_of_max"))


@register("lod_include", f"""SELECT c_mktsegment, round(avg(cust_sum), 4) AS avg_customer_sales FROM
  (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS cust_sum FROM {_OC_SQL} GROUP BY 1, 2) GROUP BY 1""")
def q_include(spark, d):
    out = _oc(Tables(spark, d)).transform(lod.include(["c_mktsegment"], ["o_custkey"], F.sum("o_totalprice"),
                                                      F.avg, "avg_customer_sales"))
    return out.withColumn("avg_customer_sales", F.round("avg_customer_sales", 4))


@register("lod_exclude", """SELECT l_returnflag, l_linestatus, qty, flag_qty FROM
  (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) v
  JOIN (SELECT l_returnflag AS f, sum(l_quantity) AS flag_qty FROM lineitem GROUP BY 1) e ON v.l_returnflag = e.f""")
def q_exclude(spark, d):
    li = Tables(spark, d).lineitem
    view = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return li.transform(lod.exclude(view, ["l_returnflag", "l_linestatus"], ["l_linestatus"],
                                    F.sum("l_quantity"), "flag_qty"))


@register("lod_table", """SELECT l_returnflag, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 8)
  AS share FROM lineitem GROUP BY l_returnflag""")
def q_table(spark, d):
    li = Tables(spark, d).lineitem.select("l_returnflag", "l_quantity")
    with_total = li.transform(lod.table({"total_qty": F.sum("l_quantity")}))
    return with_total.groupBy("l_returnflag").agg(
        F.round(F.sum("l_quantity") / F.first("total_qty"), 8).alias("share"))


@register("lod_nested", f"""SELECT o_orderkey, round(avg(cust_total) OVER (PARTITION BY c_nationkey), 4) AS nation_avg
  FROM (SELECT o_orderkey, c_nationkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS cust_total FROM {_OC_SQL})""")
def q_nested(spark, d):
    base = _oc(Tables(spark, d))
    inner = base.transform(lod.fixed(["o_custkey"], {"cust_total": F.sum("o_totalprice")}))
    outer = inner.transform(lod.fixed(["c_nationkey"], {"nation_avg": F.avg("cust_total")}))
    return outer.select("o_orderkey", F.round("nation_avg", 4).alias("nation_avg"))


@register("lod_aggregate_of", f"""SELECT c_mktsegment, round(avg(cust_total), 4) AS avg_of_lod FROM
  (SELECT c_mktsegment, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS cust_total FROM {_OC_SQL}) GROUP BY 1""")
def q_aggregate_of(spark, d):
    base = _oc(Tables(spark, d))
    out = base.transform(lod.fixed(["o_custkey"], {"cust_total": F.sum("o_totalprice")})).transform(
        lod.aggregate_of(["c_mktsegment"], "cust_total", F.avg, "avg_of_lod"))
    return out.withColumn("avg_of_lod", F.round("avg_of_lod", 4))


@register("flt_context", """SELECT o_orderkey, round(cust_total_f, 2) AS cust_total_f FROM (
  SELECT o_orderkey, o_orderpriority, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS cust_total_f
  FROM orders WHERE o_orderstatus = 'F') WHERE o_orderpriority = '1-URGENT'""")
def q_context(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    ctx = o.transform(flt.context(flt.keep_values("o_orderstatus", ["F"])))
    with_lod = ctx.transform(lod.fixed(["o_custkey"], {"cust_total_f": F.sum("o_totalprice")}))
    # The dimension filter comes after the FIXED LOD, so it does not change the LOD value.
    return with_lod.transform(flt.keep_values("o_orderpriority", ["1-URGENT"])).select(
        "o_orderkey", F.round("cust_total_f", 2).alias("cust_total_f"))


# ------------------------------------------------------------------ composed view

@register("view_composed", """WITH base AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus,
    o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus IN ('F', 'O')),
  ctx AS (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS cust_total FROM base
    WHERE o_orderpriority <> '5-LOW'),
  filt AS (SELECT * FROM ctx WHERE c_mktsegment <> 'HOUSEHOLD'),
  v AS (SELECT c_mktsegment, year(o_orderdate) AS yr, sum(o_totalprice) AS sales, count(DISTINCT o_custkey) AS buyers,
    avg(cust_total) AS avg_cust_total FROM filt GROUP BY 1, 2 HAVING count(*) > 10),
  seg AS (SELECT c_mktsegment AS s, sum(o_totalprice) AS segment_sales FROM filt GROUP BY 1)
SELECT c_mktsegment, yr, round(sales, 2) AS sales, buyers, round(avg_cust_total, 2) AS avg_cust_total,
  round(segment_sales, 2) AS segment_sales, rank() OVER (PARTITION BY yr ORDER BY sales DESC) AS rank_in_year
FROM v JOIN seg ON v.c_mktsegment = seg.s""")
def q_view(spark, d):
    from tessera.operators import tablecalc as tc
    from tessera.plans.view import ViewSpec, exclude_step, view
    t = Tables(spark, d)
    base = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority", "c_mktsegment") \
        .withColumn("yr", F.year("o_orderdate"))
    spec = ViewSpec(
        dims=["c_mktsegment", "yr"],
        measures={"sales": F.sum("o_totalprice"), "buyers": F.count_distinct("o_custkey"),
                  "avg_cust_total": F.avg("cust_total"), "_n": F.count(F.lit(1))},
        datasource_filters=[flt.keep_values("o_orderstatus", ["F", "O"])],
        context_filters=[flt.exclude_values("o_orderpriority", ["5-LOW"])],
        fixed_lods=[(["o_custkey"], {"cust_total": F.sum("o_totalprice")})],
        dimension_filters=[flt.exclude_values("c_mktsegment", ["HOUSEHOLD"])],
        measure_filters=[F.col("_n") > 10],
        view_lods=[exclude_step(["c_mktsegment", "yr"], ["yr"], F.sum("o_totalprice"), "segment_sales")],
        table_calcs=[tc.rank("sales", "rank_in_year", ["yr"])],
    )
    out = view(base, spec)
    return out.select("c_mktsegment", "yr", F.round("sales", 2).alias("sales"), "buyers",
                      F.round("avg_cust_total", 2).alias("avg_cust_total"),
                      F.round("segment_sales", 2).alias("segment_sales"), "rank_in_year")
