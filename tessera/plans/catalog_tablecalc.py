"""Registered queries: table calculations and quick table calculations.

The view: orders aggregated by priority and month (``sales``, ``n``); table
calculations partition by priority and address along the month.  Every step
uses the skew-safe plans (segmented scans, grouped aggregates joined back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import tablecalc as tc
from tessera.plans.registry import register
from tessera.sources.tables import Tables

VIEW_SQL = ("(SELECT o_orderpriority AS prio, date_trunc('month', o_orderdate) AS month, "
            "sum(o_totalprice) AS sales, count(*) AS n FROM orders GROUP BY 1, 2)")
_P = "PARTITION BY prio ORDER BY month"


def view(spark, d) -> DataFrame:
    return Tables(spark, d).orders.groupBy(
        F.col("o_orderpriority").alias("prio"), fn.datetrunc("month", "o_orderdate").alias("month")).agg(
        F.sum("o_totalprice").alias("sales"), F.count(F.lit(1)).alias("n"))


def _digits(flag) -> int:
    # True: 6 decimals; an int gives the digits.  Sums, minimums and maximums of
    # prices are rounded to cents (exact there whatever the summation order);
    # averages of prices over k rows can end exactly on a half at the 6th decimal,
    # a tie the two engines may break differently, so averages use the integer
    # count ``n``.
    return 6 if flag is True else int(flag)


def _reg(qid: str, step, out: dict[str, object], sql_exprs: dict[str, str]):
    """Register view -> step -> (prio, month, outputs); rounded where flagged."""
    def run(spark, d):
        v = view(spark, d).transform(step)
        cols = [F.round(F.col(k), _digits(r)).alias(k) if r else F.col(k).alias(k) for k, r in out.items()]
        return v.select("prio", "month", *cols)
    # Spark's statistics give null where DuckDB gives NaN (a single-row frame).
    sel = ", ".join(f"round(nullif({e}, 'NaN'::DOUBLE), {_digits(out[k])}) AS {k}" if out[k] else f"{e} AS {k}"
                    for k, e in sql_exprs.items())
    register(qid, f"SELECT prio, month, {sel} FROM {VIEW_SQL}")(run)


PART, ORD = ["prio"], ["month"]

# running
for _agg in ["sum", "avg", "count", "max", "min"]:
    _sql = {"sum": "sum(sales)", "avg": "avg(n)", "count": "count(sales)", "max": "max(sales)",
            "min": "min(sales)"}[_agg]
    _reg(f"tc_running_{_agg}", tc.running(_agg, "n" if _agg == "avg" else "sales", "r", PART, ORD),
         {"r": {"count": False, "avg": True}.get(_agg, 2)},
         {"r": f"{_sql} OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"})

# window with a row frame (2 before .. 1 after) and over the whole partition
for _agg, _sql in [("sum", "sum"), ("avg", "avg"), ("max", "max"), ("min", "min"), ("count", "count")]:
    _reg(f"tc_window_{_agg}",
         lambda df, _a=_agg: df.transform(tc.window(_a, "sales", "w", PART, ORD, -2, 1))
         .transform(tc.window(_a, "sales", "w_all", PART)),
         {"w": {"count": False, "avg": True}.get(_agg, 2), "w_all": {"count": False, "avg": True}.get(_agg, 2)},
         {"w": f"{_sql}(sales) OVER ({_P} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
          "w_all": f"{_sql}(sales) OVER (PARTITION BY prio)"})
for _agg, _sql in [("stdev", "stddev_samp"), ("stdevp", "stddev_pop"), ("var", "var_samp"), ("varp", "var_pop")]:
    _reg(f"tc_window_{_agg}",
         lambda df, _a=_agg: df.transform(tc.window(_a, "n", "w", PART, ORD, -3, 0))
         .transform(tc.window(_a, "n", "w_all", PART)),
         {"w": True, "w_all": True},
         {"w": f"{_sql}(n) OVER ({_P} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
          "w_all": f"{_sql}(n) OVER (PARTITION BY prio)"})
for _agg, _sql in [("corr", "corr"), ("covar", "covar_samp"), ("covarp", "covar_pop")]:
    _reg(f"tc_window_{_agg}",
         lambda df, _a=_agg: df.transform(tc.window(_a, "sales", "w", PART, ORD, -5, 0, y="n"))
         .transform(tc.window(_a, "sales", "w_all", PART, y="n")),
         {"w": True, "w_all": True},
         {"w": f"{_sql}(sales, n) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
          "w_all": f"{_sql}(sales, n) OVER (PARTITION BY prio)"})
_reg("tc_window_median", lambda df: df.transform(tc.window("median", "sales", "w_all", PART))
     .transform(tc.window("median", "sales", "w", PART, ORD, -2, 2)),
     {"w_all": True, "w": True},
     {"w_all": "quantile_cont(sales, 0.5) OVER (PARTITION BY prio)",
      "w": f"quantile_cont(sales, 0.5) OVER ({_P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"})
_reg("tc_window_percentile", lambda df: df.transform(tc.window("percentile_0.9", "sales", "w_all", PART)),
     {"w_all": True}, {"w_all": "quantile_cont(sales, 0.9) OVER (PARTITION BY prio)"})

# ranks (descending by sales; n has ties)
_reg("tc_rank", lambda df: df.transform(tc.rank("sales", "r", PART)).transform(tc.rank("n", "r_n", None)),
     {"r": False, "r_n": False},
     {"r": "rank() OVER (PARTITION BY prio ORDER BY sales DESC)", "r_n": "rank() OVER (ORDER BY n DESC)"})
_reg("tc_rank_dense", lambda df: df.transform(tc.rank("n", "r", PART, kind="dense")), {"r": False},
     {"r": "dense_rank() OVER (PARTITION BY prio ORDER BY n DESC)"})
_reg("tc_rank_unique", lambda df: df.transform(tc.rank("n", "r", PART, kind="unique", tie_breakers=["month"])),
     {"r": False}, {"r": "row_number() OVER (PARTITION BY prio ORDER BY n DESC, month)"})
_reg("tc_rank_modified", lambda df: df.transform(tc.rank("n", "r", PART, kind="modified")), {"r": False},
     {"r": "count(*) OVER (PARTITION BY prio ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"})
_reg("tc_rank_percentile", lambda df: df.transform(tc.rank("n", "r", PART, kind="percentile", ascending=True)),
     {"r": 8}, {"r": "percent_rank() OVER (PARTITION BY prio ORDER BY n)"})

# position
_reg("tc_index", tc.index("i", PART, ORD), {"i": False}, {"i": f"row_number() OVER ({_P})"})
_reg("tc_first", tc.first("f", PART, ORD), {"f": False}, {"f": f"1 - row_number() OVER ({_P})"})
_reg("tc_last", tc.last("l", PART, ORD), {"l": False},
     {"l": f"count(*) OVER (PARTITION BY prio) - row_number() OVER ({_P})"})
_reg("tc_size", tc.size("s", PART), {"s": False}, {"s": "count(*) OVER (PARTITION BY prio)"})
_reg("tc_lookup", lambda df: df.transform(tc.lookup("sales", -2, "back2", PART, ORD))
     .transform(tc.lookup("sales", 1, "next1", PART, ORD)),
     {"back2": True, "next1": True},
     {"back2": f"lag(sales, 2) OVER ({_P})", "next1": f"lead(sales, 1) OVER ({_P})"})
_reg("tc_previous_value", tc.previous_value("n", 0, "prev", PART, ORD), {"prev": False},
     {"prev": f"coalesce(lag(n, 1) OVER ({_P}), 0)"})


@register("tc_total", f"""SELECT prio, month, round(sales, 4) AS sales, round(t.avg_price, 4) AS total_avg FROM {VIEW_SQL} v
  JOIN (SELECT o_orderpriority AS p, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) t ON v.prio = t.p""")
def q_total(spark, d):
    base = Tables(spark, d).orders.withColumnRenamed("o_orderpriority", "prio")
    out = view(spark, d).transform(tc.total(base, ["prio"], {"total_avg": F.avg("o_totalprice")}))
    return out.select("prio", "month", F.round("sales", 4).alias("sales"), F.round("total_avg", 4).alias("total_avg"))


@register("tc_running_countd", """SELECT month, CAST(sum(first_seen) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS BIGINT) AS customers_so_far FROM (SELECT month, count(*) FILTER (WHERE rn = 1) AS first_seen FROM
  (SELECT date_trunc('month', o_orderdate) AS month, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,
  o_orderkey) AS rn FROM orders) GROUP BY month)""")
def q_running_countd(spark, d):
    base = Tables(spark, d).orders.select("o_custkey", "o_orderkey", fn.datetrunc("month", "o_orderdate").alias("month"))
    flagged = base.transform(tc.running_countd("o_custkey", "seen", None, ["month", "o_orderkey"]))
    return flagged.groupBy("month").agg(F.max("seen").alias("customers_so_far"))


# quick table calculations
_reg("qtc_percent_of_total", tc.percent_of_total("sales", "pct", PART), {"pct": 8},
     {"pct": "sales / sum(sales) OVER (PARTITION BY prio)"})
_reg("qtc_percent_difference", tc.percent_difference("sales", "pctd", PART, ORD), {"pctd": 8},
     {"pctd": f"(sales - lag(sales) OVER ({_P})) / lag(sales) OVER ({_P})"})
_reg("qtc_difference", tc.difference("sales", "diff", PART, ORD), {"diff": True},
     {"diff": f"sales - lag(sales) OVER ({_P})"})
_reg("qtc_running", tc.running("avg", "n", "run_avg", PART, ORD), {"run_avg": True},
     {"run_avg": f"avg(n) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"})
_reg("qtc_rank", tc.rank("sales", "rk", None), {"rk": False}, {"rk": "rank() OVER (ORDER BY sales DESC)"})


@register("tc_running_sum_raw", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  round(sum(l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
  l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_price FROM lineitem""")
def q_running_raw(spark, d):
    # Raw rows, three return flags: every partition group holds about a third of
    # the table -- the hot-group case the segmented scan is built for.
    # (l_orderkey, l_linenumber) is not unique in the test data: the order key
    # adds part and supplier to make the order total.
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                                          "l_shipdate", "l_extendedprice")
    out = li.transform(tc.running("sum", "l_extendedprice", "running_price", ["l_returnflag"],
                                  ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("running_price", 2).alias("running_price"))


# frames from the first row or to the last one, and distinct values in moving frames
_FROM, _TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND", "AND UNBOUNDED FOLLOWING"
for _agg, _sql in [("sum", "sum"), ("max", "max"), ("count", "count")]:
    _reg(f"tc_window_{_agg}_half_open",
         lambda df, _a=_agg: df.transform(tc.window(_a, "sales", "upto", PART, ORD, None, 2))
         .transform(tc.window(_a, "sales", "since", PART, ORD, -1, None)),
         {"upto": {"count": False}.get(_agg, 2), "since": {"count": False}.get(_agg, 2)},
         {"upto": f"{_sql}(sales) OVER ({_P} {_FROM} 2 FOLLOWING)", "since": f"{_sql}(sales) OVER ({_P} ROWS BETWEEN 1 PRECEDING {_TO})"})
for _agg, _sql in [("var", "var_samp"), ("stdevp", "stddev_pop")]:
    _reg(f"tc_window_{_agg}_half_open",
         lambda df, _a=_agg: df.transform(tc.window(_a, "n", "upto", PART, ORD, None, 0))
         .transform(tc.window(_a, "n", "since", PART, ORD, 2, None)),
         {"upto": True, "since": True},
         {"upto": f"{_sql}(n) OVER ({_P} {_FROM} CURRENT ROW)", "since": f"{_sql}(n) OVER ({_P} ROWS BETWEEN 2 FOLLOWING {_TO})"})
for _agg, _sql in [("corr", "corr"), ("covarp", "covar_pop")]:
    _reg(f"tc_window_{_agg}_half_open",
         lambda df, _a=_agg: df.withColumn("k", F.month("month"))
         .transform(tc.window(_a, "n", "upto", PART, ORD, None, -1, y="k"))
         .transform(tc.window(_a, "n", "since", PART, ORD, 0, None, y="k")),
         {"upto": 8, "since": 8},
         {"upto": f"{_sql}(n, month(month)) OVER ({_P} {_FROM} 1 PRECEDING)",
          "since": f"{_sql}(n, month(month)) OVER ({_P} ROWS BETWEEN CURRENT ROW {_TO})"})


@register("tc_window_countd", """WITH o AS (SELECT l_returnflag AS flag, l_partkey AS part, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem),
 moves AS (SELECT flag, part, p, lag(p) OVER (PARTITION BY flag, part ORDER BY p) AS q FROM o)
SELECT flag, part, p, (SELECT count(*) FROM moves b WHERE b.flag = a.flag AND b.p BETWEEN a.p - 20 AND a.p + 5
  AND (b.q IS NULL OR b.q < a.p - 20)) AS around,
 CAST(sum(CASE WHEN q IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY flag ORDER BY p) AS BIGINT) AS so_far FROM moves a""")
def q_window_countd(spark, d):
    # Three flags hold all rows: distinct parts among the 20 rows before and 5 after each row, and since the first row.
    li = Tables(spark, d).lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"), "l_shipdate", "l_orderkey",
                                          "l_linenumber", "l_suppkey")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "part", "l_suppkey"]
    out = (li.transform(tc.index("p", ["flag"], order))
           .transform(tc.window("countd", "part", "around", ["flag"], ["p"], -20, 5))
           .transform(tc.window("countd", "part", "so_far", ["flag"], ["p"], None, 0)))
    return out.select("flag", "part", "p", "around", "so_far")


_STEPS = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS i FROM {t})"


@register("tc_previous_value_recursive", f"""WITH RECURSIVE v AS {_STEPS.format(k='prio', o='month', t=VIEW_SQL)},
 r AS (SELECT prio, month, i, n, least(400::DOUBLE, greatest(0, 75 + n::DOUBLE)) AS stock, n::DOUBLE AS total FROM v WHERE i = 1
  UNION ALL SELECT v.prio, v.month, v.i, v.n, least(400::DOUBLE, greatest(0, r.stock * 0.75::DOUBLE + v.n)), r.total * 1.02::DOUBLE + v.n
  FROM r JOIN v ON v.prio = r.prio AND v.i = r.i + 1)
SELECT prio, month, round(stock, 6) AS stock, round(total, 6) AS total FROM r""")
def q_previous_recursive(spark, d):
    """Formulas on their own previous value: a decayed stock between bounds, and compounded growth."""
    out = (view(spark, d).transform(tc.recurrence("stock", 100.0, 0.75, F.col("n"), 0.0, 400.0, PART, ORD))
           .transform(tc.recurrence("total", 0.0, 1.02, F.col("n"), partition_by=PART, order_by=ORD)))
    return out.select("prio", "month", F.round("stock", 6).alias("stock"), F.round("total", 6).alias("total"))


@register("tc_running_balance_raw", f"""WITH RECURSIVE v AS {_STEPS.format(k='o_custkey', o='o_orderdate, o_orderkey', t='orders')},
 r AS (SELECT o_custkey, o_orderkey, i, least(250000.0, greatest(0.0, 1000.0 + CASE WHEN o_orderstatus = 'F' THEN -o_totalprice
   ELSE o_totalprice END)) AS b FROM v WHERE i = 1
  UNION ALL SELECT v.o_custkey, v.o_orderkey, v.i, least(250000.0, greatest(0.0, r.b + CASE WHEN v.o_orderstatus = 'F'
   THEN -v.o_totalprice ELSE v.o_totalprice END)) FROM r JOIN v ON v.o_custkey = r.o_custkey AND v.i = r.i + 1)
SELECT o_custkey, o_orderkey, round(b, 2) AS balance FROM r""")
def q_balance_raw(spark, d):
    """A balance with a floor and a ceiling over raw rows, by customer."""
    price = F.col("o_totalprice")
    out = Tables(spark, d).orders.transform(tc.recurrence(
        "b", 1000.0, flow=F.when(F.col("o_orderstatus") == "F", -price).otherwise(price), lower=0.0, upper=250000.0,
        partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"]))
    return out.select("o_custkey", "o_orderkey", F.round("b", 2).alias("balance"))
