"""Registered queries: semantic layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import semantic as S
from tessera.plans.registry import register
from tessera.sources.tables import Tables

_MS_SQL = ("(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS sales "
           "FROM orders GROUP BY 1)")


def monthly(spark, d):
    return Tables(spark, d).orders.groupBy(fn.datetrunc("month", "o_orderdate", is_date=True).alias("month")).agg(
        F.sum("o_totalprice").alias("sales"))


@register("sem_calendar", """SELECT CAST(d AS DATE) AS Date, year(d) AS Year, 'Q' || quarter(d) AS Quarter,
  month(d) AS Month, monthname(d) AS MonthName, day(d) AS Day, isodow(d) AS DayOfWeek, dayname(d) AS DayName
  FROM (SELECT unnest(generate_series(CAST((SELECT min(o_orderdate) FROM orders) AS DATE),
        CAST((SELECT max(o_orderdate) FROM orders) AS DATE), INTERVAL 1 DAY)) AS d)""")
def q_calendar(spark, d):
    return S.calendar_for(Tables(spark, d).orders, "o_orderdate")


@register("sem_date_hierarchy", """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_Year,
  quarter(o_orderdate) AS o_orderdate_Quarter, month(o_orderdate) AS o_orderdate_Month,
  day(o_orderdate) AS o_orderdate_Day FROM orders""")
def q_date_hierarchy(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_orderdate").transform(
        S.date_hierarchy(["o_orderdate"])).drop("o_orderdate")


@register("sem_ytd", f"""SELECT month, round(sum(sales) OVER (PARTITION BY year(month) ORDER BY month
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS ytd FROM {_MS_SQL}""")
def q_ytd(spark, d):
    return monthly(spark, d).transform(S.ytd("sales", "month", "ytd")).select(
        "month", F.round("ytd", 2).alias("ytd"))


@register("sem_previous_year", f"""SELECT m.month, round(m.sales, 2) AS sales, round(p.sales, 2) AS py FROM {_MS_SQL} m
  LEFT JOIN {_MS_SQL} p ON CAST(p.month + INTERVAL 12 MONTH AS DATE) = m.month""")
def q_previous_year(spark, d):
    return monthly(spark, d).transform(S.previous_year("sales", "month", "py")).select(
        "month", F.round("sales", 2).alias("sales"), F.round("py", 2).alias("py"))


@register("sem_yoy_percent", f"""WITH y AS (SELECT month, sum(sales) OVER (PARTITION BY year(month) ORDER BY month
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ytd FROM {_MS_SQL})
  SELECT y.month, round(coalesce((y.ytd - p.ytd) / nullif(p.ytd, 0), 0.0), 6) AS yoy_pct FROM y
  LEFT JOIN y p ON CAST(p.month + INTERVAL 12 MONTH AS DATE) = y.month""")
def q_yoy(spark, d):
    y = monthly(spark, d).transform(S.ytd("sales", "month", "ytd")).select("month", "ytd")
    out = y.transform(S.previous_year("ytd", "month", "py_ytd")).transform(S.yoy_percent("ytd", "py_ytd"))
    return out.select("month", F.round("yoy_pct", 6).alias("yoy_pct"))


@register("sem_set_members", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS in_set FROM customer")
def q_set_members(spark, d):
    return Tables(spark, d).customer.select("c_custkey", "c_mktsegment").transform(
        S.set_members("c_mktsegment", ["BUILDING", "MACHINERY"], "in_set")).drop("c_mktsegment")


@register("sem_set_members_table", """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders
  WHERE o_orderpriority = '1-URGENT') AS urgent_buyer FROM customer""")
def q_set_members_table(spark, d):
    t = Tables(spark, d)
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return t.customer.select("c_custkey").transform(S.set_members_from(urgent, "c_custkey", "urgent_buyer", "o_custkey"))


@register("sem_set_condition", "SELECT c_custkey, coalesce(c_acctbal > 5000, false) AS rich FROM customer")
def q_set_condition(spark, d):
    return Tables(spark, d).customer.select("c_custkey", "c_acctbal").transform(
        S.set_condition(F.col("c_acctbal") > 5000, "rich")).drop("c_acctbal")


@register("sem_group_values", """SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'Big'
  WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'Budget' ELSE 'Other' END AS type_group FROM part""")
def q_group_values(spark, d):
    return Tables(spark, d).part.select("p_partkey", "p_type").transform(S.group_values(
        "p_type", {"Big": ["LARGE", "MEDIUM"], "Budget": ["SMALL", "ECONOMY"]}, "type_group")).drop("p_type")


@register("sem_group_combined", """SELECT o_orderkey, concat_ws(' | ', o_orderpriority, CAST(year(o_orderdate) AS VARCHAR))
  AS prio_year FROM orders""")
def q_group_combined(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_orderdate").transform(
        S.group_combined(["o_orderpriority", F.year("o_orderdate")], "prio_year")).select("o_orderkey", "prio_year")


@register("sem_bin", """SELECT floor(c_acctbal / 1000) * 1000 AS balance_bin, count(*) AS n FROM customer
  GROUP BY 1""")
def q_bin(spark, d):
    return Tables(spark, d).customer.transform(S.bin_("c_acctbal", 1000, "balance_bin")).groupBy("balance_bin").agg(
        F.count(F.lit(1)).alias("n")).withColumn("balance_bin", F.col("balance_bin").cast("double"))


@register("sem_hierarchy_rollup", """SELECT r_name, n_name, round(sum(c_acctbal), 2) AS balance,
  CAST(CASE WHEN grouping(r_name) = 1 THEN 0 WHEN grouping(n_name) = 1 THEN 1 ELSE 2 END AS BIGINT) AS level
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ROLLUP (r_name, n_name)""")
def q_hierarchy(spark, d):
    t = Tables(spark, d)
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = c.transform(S.hierarchy_rollup(["r_name", "n_name"], {"balance": F.sum("c_acctbal")}))
    return out.withColumn("balance", F.round("balance", 2))


@register("sem_alias", """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_name WHEN 'NATION_0' THEN 'Home market'
  WHEN 'NATION_1' THEN 'Second market' ELSE n_name END AS display FROM nation""")
def q_alias(spark, d):
    return Tables(spark, d).nation.select("n_nationkey", "n_name").transform(S.alias(
        "n_name", {"NATION_0": "Home market", "NATION_1": "Second market"}, "display")).drop("n_name")


@register("sem_param_range", """SELECT CAST(v AS DOUBLE) AS size_param FROM (SELECT unnest(generate_series(
  (SELECT min(p_size) FROM part), (SELECT max(p_size) FROM part), 5)) AS v)""")
def q_param_range(spark, d):
    lo, hi = Tables(spark, d).part.agg(F.min("p_size"), F.max("p_size")).first()
    return S.param_range(spark, float(lo), float(hi), 5.0, "size_param")


@register("sem_param_list", "SELECT DISTINCT c_mktsegment AS value FROM customer")
def q_param_list(spark, d):
    return S.param_members(Tables(spark, d).customer, "c_mktsegment")


@register("sem_param_value", """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount >= 0.05
  GROUP BY l_returnflag""")
def q_param_value(spark, d):
    threshold = S.param_value(0.05)
    return Tables(spark, d).lineitem.filter(F.col("l_discount") >= threshold).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"))


@register("sem_param_query", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def q_param_query(spark, d):
    Tables(spark, d).orders.createOrReplaceTempView("tessera_param_orders")
    return S.param_query(spark, "SELECT o_orderpriority FROM tessera_param_orders WHERE o_orderstatus = :status",
                         {"status": "F"})


@register("sem_what_if", """SELECT p AS discount_param, l_returnflag, round(sum(l_extendedprice * (1 - p)), 2) AS revenue
  FROM lineitem, (SELECT CAST(unnest([0.0, 0.05, 0.1]) AS DOUBLE) AS p) GROUP BY 1, 2""")
def q_what_if(spark, d):
    out = Tables(spark, d).lineitem.transform(S.what_if(
        [0.0, 0.05, 0.1], "discount_param", ["l_returnflag"],
        lambda p: F.sum(F.col("l_extendedprice") * (1 - p)), "revenue"))
    return out.withColumn("revenue", F.round("revenue", 2))


@register("sem_measure_switch", """SELECT l_returnflag, measure, value FROM (UNPIVOT (SELECT l_returnflag,
  CAST(sum(l_quantity) AS DOUBLE) AS total_qty, round(avg(l_extendedprice), 6) AS avg_price,
  CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY l_returnflag) ON total_qty, avg_price, lines
  INTO NAME measure VALUE value)""")
def q_measure_switch(spark, d):
    return Tables(spark, d).lineitem.transform(S.measure_switch({
        "total_qty": F.sum("l_quantity"), "avg_price": F.round(F.avg("l_extendedprice"), 6),
        "lines": F.count(F.lit(1))}, ["l_returnflag"]))


@register("sem_dimension_switch", """SELECT c_mktsegment AS dimension, count(*) AS customers,
  round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def q_dimension_switch(spark, d):
    out = Tables(spark, d).customer.transform(S.dimension_switch(
        ["c_mktsegment", "c_nationkey"], "c_mktsegment",
        {"customers": F.count(F.lit(1)), "balance": F.sum("c_acctbal")}))
    return out.withColumn("balance", F.round("balance", 2))


_CUST_REGION_SQL = ("customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")


def _cust_region(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "r_name")


# The security mapping of the row-security example (user -> region).
RLS_MAPPING = [("alice", "EUROPE"), ("alice", "ASIA"), ("bob", "AMERICA")]


@register("sem_rls_user_mapping", f"SELECT c_custkey, r_name FROM {_CUST_REGION_SQL} WHERE r_name IN ('EUROPE', 'ASIA')")
def q_rls_mapping(spark, d):
    mapping = spark.createDataFrame(RLS_MAPPING, ["user", "value"])
    return _cust_region(Tables(spark, d)).transform(S.rls_user_mapping(mapping, "alice", "r_name")).select(
        "c_custkey", "r_name")


@register("sem_rls_expression", """SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_name = 'Customer#000000042'""")
def q_rls_expression(spark, d):
    t = Tables(spark, d)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.transform(S.rls_expression(lambda user: F.col("c_name") == user, "Customer#000000042")).select("o_orderkey")


@register("sem_rls_group", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_rls_group(spark, d):
    return Tables(spark, d).orders.transform(S.rls_group(
        "managers", ["analysts"], F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


# Schema of the tables the relationship queries scan (column names only).
_REL_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}


class _Cols:
    def __init__(self, cols):
        self.columns = cols


def _rel_pairs():
    return S.relationship_candidates({t: _Cols(c) for t, c in _REL_TABLES.items()})


def _rel_sql() -> str:
    parts = []
    for lt, lc, rt, rc in _rel_pairs():
        parts.append(f"""SELECT '{lt}' AS left_table, '{lc}' AS left_column, '{rt}' AS right_table,
  '{rc}' AS right_column, (SELECT count(DISTINCT {lc}) FROM {lt}) AS left_distinct,
  (SELECT count(DISTINCT {rc}) FROM {rt}) AS right_distinct,
  (SELECT count(*) FROM (SELECT DISTINCT {lc} FROM {lt} WHERE {lc} IS NOT NULL INTERSECT
   SELECT DISTINCT {rc} FROM {rt})) AS shared""")
    body = " UNION ALL ".join(parts)
    return (f"SELECT left_table, left_column, right_table, right_column, left_distinct, right_distinct, shared, "
            f"round(shared / left_distinct, 8) AS left_in_right, round(shared / right_distinct, 8) AS right_in_left "
            f"FROM ({body})")


@register("sem_relationship_infer", _rel_sql())
def q_rel_infer(spark, d):
    t = Tables(spark, d)
    out = S.relationship_infer({n: getattr(t, n) for n in _REL_TABLES})
    return out.withColumns({"left_in_right": F.round("left_in_right", 8), "right_in_left": F.round("right_in_left", 8)})


_DISCOVER = {"nation": ["n_nationkey", "n_regionkey", "n_name"], "region": ["r_regionkey", "r_name"], "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
             "supplier": ["s_suppkey", "s_nationkey"], "orders": ["o_orderkey", "o_custkey", "o_orderpriority"],
             "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "part": ["p_partkey"]}


def _discover_sql() -> str:
    values = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, typeof({c}) = 'VARCHAR' AS f FROM {t} WHERE {c} IS NOT NULL"
                                for t, cs in _DISCOVER.items() for c in cs)
    return f"""WITH v AS ({values}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY t, c),
  s AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.f = b.f AND a.t < b.t GROUP BY ALL)
SELECT lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column, a.n AS left_distinct, b.n AS right_distinct, shared,
  round(shared / a.n, 8) AS left_in_right, round(shared / b.n, 8) AS right_in_left
FROM s JOIN n a ON a.t = lt AND a.c = lc JOIN n b ON b.t = rt AND b.c = rc WHERE shared >= 0.95 * least(a.n, b.n) AND least(a.n, b.n) >= 2"""


@register("sem_relationship_discover", _discover_sql())
def q_rel_discover(spark, d):
    # From the values alone: sketches of every column, exact counts for the pairs that survive.
    t = Tables(spark, d)
    out = S.relationship_discover({n: getattr(t, n).select(*cs) for n, cs in _DISCOVER.items()})
    return out.withColumns({"left_in_right": F.round("left_in_right", 8), "right_in_left": F.round("right_in_left", 8)})


def _card_sql() -> str:
    parts = []
    for lt, lc, rt, rc in _rel_pairs():
        parts.append(f"""SELECT '{lt}.{lc}' AS left_key, '{rt}.{rc}' AS right_key,
  (SELECT count({lc}) FROM {lt}) AS left_rows, (SELECT count(DISTINCT {lc}) FROM {lt}) AS left_distinct,
  (SELECT count({rc}) FROM {rt}) AS right_rows, (SELECT count(DISTINCT {rc}) FROM {rt}) AS right_distinct""")
    body = " UNION ALL ".join(parts)
    return (f"SELECT *, CASE WHEN left_rows = left_distinct AND right_rows = right_distinct THEN '1:1' "
            f"WHEN left_rows > left_distinct AND right_rows = right_distinct THEN 'm:1' "
            f"WHEN left_rows = left_distinct AND right_rows > right_distinct THEN '1:m' ELSE 'm:n' END AS cardinality "
            f"FROM ({body})")


@register("sem_relationship_cardinality", _card_sql())
def q_rel_card(spark, d):
    t = Tables(spark, d)
    return S.relationship_cardinalities({n: getattr(t, n) for n in _REL_TABLES})
