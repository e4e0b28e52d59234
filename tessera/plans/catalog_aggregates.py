"""Registered queries: aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import aggregates as A
from tessera.plans.registry import register
from tessera.session import stored
from tessera.sources.tables import Tables


def _li(spark, d):
    return Tables(spark, d).lineitem


@register("agg_group_by", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
  round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_by(spark, d):
    return _li(spark, d).transform(A.group_by(["l_returnflag", "l_linestatus"], {
        "sum_qty": A.sum_("l_quantity"), "sum_price": F.round(A.sum_("l_extendedprice"), 2),
        "avg_disc": F.round(A.avg("l_discount"), 6), "count_order": A.count_rows()}))


@register("agg_group_by_global", "SELECT sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem")
def q_group_by_global(spark, d):
    return _li(spark, d).transform(A.group_by([], {"sum_qty": A.sum_("l_quantity"), "n": A.count_rows()}))


def _simple(qid: str, col_spark, sql: str, group: str = "l_suppkey"):
    register(qid, f"SELECT {group}, {sql} AS v FROM lineitem GROUP BY {group}")(
        lambda spark, d, _c=col_spark: _li(spark, d).groupBy(group).agg(_c().alias("v")))


_simple("agg_sum", lambda: A.sum_("l_quantity"), "sum(l_quantity)")
_simple("agg_avg", lambda: F.round(A.avg("l_extendedprice"), 6), "round(avg(l_extendedprice), 6)")
_simple("agg_min", lambda: A.min_("l_shipdate"), "min(l_shipdate)")
_simple("agg_max", lambda: A.max_("l_extendedprice"), "max(l_extendedprice)")
_simple("agg_count", lambda: A.count(F.when(F.col("l_discount") > 0, F.col("l_discount"))),
        "count(nullif(l_discount, 0))")
_simple("agg_counta", lambda: A.counta(F.when(F.col("l_tax") > 0, F.col("l_returnflag")).otherwise(F.lit(""))),
        "count(CASE WHEN l_tax > 0 THEN l_returnflag END)")
_simple("agg_count_rows", lambda: A.count_rows(), "count(*)")
_simple("agg_countd", lambda: A.countd("l_partkey"), "count(DISTINCT l_partkey)")
_simple("agg_stdev", lambda: F.round(A.stdev("l_quantity"), 6), "round(stddev_samp(l_quantity), 6)")
_simple("agg_stdevp", lambda: F.round(A.stdevp("l_quantity"), 6), "round(stddev_pop(l_quantity), 6)")
_simple("agg_var", lambda: F.round(A.var("l_quantity"), 6), "round(var_samp(l_quantity), 6)")
_simple("agg_varp", lambda: F.round(A.varp("l_quantity"), 6), "round(var_pop(l_quantity), 6)")
_simple("agg_corr", lambda: F.round(A.corr("l_quantity", "l_extendedprice"), 8),
        "round(corr(l_quantity, l_extendedprice), 8)")
_simple("agg_covar", lambda: F.round(A.covar("l_quantity", "l_discount"), 8),
        "round(covar_samp(l_quantity, l_discount), 8)")
_simple("agg_covarp", lambda: F.round(A.covarp("l_quantity", "l_discount"), 8),
        "round(covar_pop(l_quantity, l_discount), 8)")
_simple("agg_attr", lambda: A.attr("l_linestatus"),
        "CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END", group="l_orderkey")
_simple("agg_of_expression",
        lambda: F.round(A.sum_(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2),
        "round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2)", group="l_returnflag")


@register("agg_countd_approx", """SELECT l_suppkey, count(DISTINCT l_partkey) AS exact, TRUE AS within
  FROM lineitem GROUP BY l_suppkey""")
def q_countd_approx(spark, d):
    # The sketch's value must lie within four standard errors of the exact count.
    both = _li(spark, d).transform(A.countd_both(["l_suppkey"], "l_partkey", "v", "exact", rsd=0.02))
    return both.select("l_suppkey", "exact", (F.abs(F.col("v") - F.col("exact")) <= 1 + 0.08 * F.col("exact")).alias("within"))


@register("agg_countd_mergeable", """SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS exact, TRUE AS within
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_countd_mergeable(spark, d):
    # Sketches by month, flag and status are stored; every coarser level is rolled up from that table alone.
    li = _li(spark, d)
    months = stored(li.groupBy("l_returnflag", "l_linestatus", F.trunc("l_shipdate", "month").alias("month")).agg(
        A.countd_sketch("l_partkey").alias("parts")), "sketches")
    rolled = months.cube("l_returnflag", "l_linestatus").agg(A.countd_of("parts").alias("v"))
    exact = li.cube("l_returnflag", "l_linestatus").agg(A.countd("l_partkey").alias("exact"))
    same = F.lit(True)
    for k in ("l_returnflag", "l_linestatus"):
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}"))
    both = exact.alias("e").join(rolled.alias("r"), same)
    return both.select("e.l_returnflag", "e.l_linestatus", "exact", (F.abs(F.col("v") - F.col("exact")) <= 1 + 0.065 * F.col("exact")).alias("within"))


@register("agg_median", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median_price
  FROM lineitem GROUP BY l_returnflag""")
def q_median(spark, d):
    # Exact and skew-safe: three return flags hold every row, so each group is huge.
    return _li(spark, d).transform(A.exact_percentiles(["l_returnflag"], "l_extendedprice", {"median_price": 0.5}))


@register("agg_percentile", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS p90,
  quantile_cont(l_extendedprice, 0.25) AS p25 FROM lineitem GROUP BY l_returnflag""")
def q_percentile(spark, d):
    return _li(spark, d).transform(A.exact_percentiles(["l_returnflag"], "l_extendedprice", {"p90": 0.9, "p25": 0.25}))


@register("agg_percentile_builtin", """SELECT l_suppkey, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem
  GROUP BY l_suppkey""")
def q_percentile_builtin(spark, d):
    # Many small groups: Spark's own percentile aggregate is the cheaper plan.
    return _li(spark, d).groupBy("l_suppkey").agg(A.percentile("l_quantity", 0.95).alias("p95"))


@register("agg_collect", """SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, list_sort(list(struct_pack(
  lat := CAST(c_custkey % 170 - 85 AS DOUBLE), lon := CAST(c_custkey * 7 % 340 - 170 AS DOUBLE)))) AS points
  FROM customer GROUP BY c_nationkey""")
def q_collect(spark, d):
    c = Tables(spark, d).customer
    pt = fn.makepoint((F.col("c_custkey") % 170 - 85).cast("double"), (F.col("c_custkey") * 7 % 340 - 170).cast("double"))
    return c.withColumn("pt", pt).transform(A.collect_geometry(["c_nationkey"], "pt", "points"))


@register("agg_collect_chunks", """SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, i // 10 AS chunk, list_sort(list(p)) AS points FROM (
  SELECT c_nationkey, p, row_number() OVER (PARTITION BY c_nationkey ORDER BY p.lat, p.lon) - 1 AS i FROM (SELECT c_nationkey, struct_pack(
  lat := CAST(c_custkey % 170 - 85 AS DOUBLE), lon := CAST(c_custkey * 7 % 340 - 170 AS DOUBLE)) AS p FROM customer)) GROUP BY 1, 2""")
def q_collect_chunks(spark, d):
    c = Tables(spark, d).customer
    pt = fn.makepoint((F.col("c_custkey") % 170 - 85).cast("double"), (F.col("c_custkey") * 7 % 340 - 170).cast("double"))
    return c.withColumn("pt", pt).transform(A.collect_geometry(["c_nationkey"], "pt", "points", chunk=10))


@register("agg_conditional", """SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice END), 2)
  AS high_disc_sales, count(*) FILTER (WHERE l_quantity > 40) AS big_lines FROM lineitem GROUP BY l_returnflag""")
def q_conditional(spark, d):
    return _li(spark, d).groupBy("l_returnflag").agg(
        F.round(A.sum_if(F.col("l_discount") > 0.05, "l_extendedprice"), 2).alias("high_disc_sales"),
        A.count_if(F.col("l_quantity") > 40).alias("big_lines"))


@register("agg_nested_stat", """SELECT c_mktsegment, round(stddev_samp(mark), 4) AS stdev_of_sums FROM
  (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS mark FROM customer GROUP BY 1, 2) GROUP BY c_mktsegment""")
def q_nested(spark, d):
    out = Tables(spark, d).customer.transform(A.nested_stat(
        ["c_nationkey", "c_mktsegment"], ["c_mktsegment"], F.sum("c_acctbal"), F.stddev_samp, "stdev_of_sums"))
    return out.withColumn("stdev_of_sums", F.round("stdev_of_sums", 4))


@register("agg_ratio", """SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8)
  AS disc_rate, sum(l_quantity) FILTER (WHERE l_quantity > 100) / nullif(count(*) FILTER (WHERE l_quantity > 100), 0)
  AS empty_ratio FROM lineitem GROUP BY l_returnflag""")
def q_ratio(spark, d):
    return _li(spark, d).groupBy("l_returnflag").agg(
        F.round(A.ratio(F.sum(F.col("l_discount") * F.col("l_extendedprice")), F.sum("l_extendedprice")), 8)
        .alias("disc_rate"),
        A.ratio(A.sum_if(F.col("l_quantity") > 100, "l_quantity"), A.count_if(F.col("l_quantity") > 100))
        .alias("empty_ratio"))


@register("agg_totals", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty,
  CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id FROM lineitem
  GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def q_totals(spark, d):
    return _li(spark, d).transform(A.totals(["l_returnflag", "l_linestatus"], {"qty": A.sum_("l_quantity")}))


@register("agg_subtotals", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty,
  CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id FROM lineitem
  GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_subtotals(spark, d):
    return _li(spark, d).transform(A.totals(["l_returnflag", "l_linestatus"], {"qty": A.sum_("l_quantity")}, "cube"))


@register("agg_grouping_sets", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty,
  CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id FROM lineitem
  GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def q_grouping_sets(spark, d):
    return _li(spark, d).transform(A.totals(["l_returnflag", "l_linestatus"], {"qty": A.sum_("l_quantity")}, "sets",
                                            sets=[["l_returnflag"], ["l_linestatus"], []]))
