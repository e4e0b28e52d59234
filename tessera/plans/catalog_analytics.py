"""Registered queries: analytics pane and view-shaping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import analytics as AN
from tessera.plans.registry import register
from tessera.sources.tables import Tables

# Marks: quantity per (return flag, supplier); scope (pane) = return flag.
_MARKS_SQL = "(SELECT l_returnflag, l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"


def marks(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))


@register("an_reference_line", f"""WITH m AS {_MARKS_SQL},
  mo AS (SELECT l_returnflag, qty AS mode_qty FROM (SELECT l_returnflag, qty, row_number() OVER (
         PARTITION BY l_returnflag ORDER BY count(*) DESC, qty) AS rn FROM m GROUP BY 1, 2) WHERE rn = 1)
  SELECT m.l_returnflag, l_suppkey, qty, round(avg(qty) OVER (PARTITION BY m.l_returnflag), 6) AS avg_line,
  min(qty) OVER (PARTITION BY m.l_returnflag) AS min_line, max(qty) OVER (PARTITION BY m.l_returnflag) AS max_line,
  round(quantile_cont(qty, 0.5) OVER (PARTITION BY m.l_returnflag), 6) AS median_line,
  round(quantile_cont(qty, 0.9) OVER (PARTITION BY m.l_returnflag), 6) AS p90_line, mode_qty AS mode_line,
  CAST(600.0 AS DOUBLE) AS target_line FROM m JOIN mo ON m.l_returnflag = mo.l_returnflag""")
def q_reference_line(spark, d):
    out = marks(spark, d).transform(AN.reference_lines("qty", ["l_returnflag"], {
        "avg_line": "avg", "min_line": "min", "max_line": "max", "median_line": "median",
        "p90_line": ("percentile", 0.9), "mode_line": "mode", "target_line": ("constant", 600.0)}))
    return out.withColumns({c: F.round(c, 6) for c in ["avg_line", "median_line", "p90_line"]})


@register("an_reference_line_table", f"""WITH m AS {_MARKS_SQL},
  mo AS (SELECT qty AS mode_qty FROM m GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)
  SELECT l_returnflag, l_suppkey, qty, round(avg(qty) OVER (), 6) AS avg_line,
  round(quantile_cont(qty, 0.5) OVER (), 6) AS median_line, mode_qty AS mode_line FROM m, mo""")
def q_reference_line_table(spark, d):
    # Table scope: one line for the whole view (global aggregates as scalar subqueries).
    out = marks(spark, d).transform(AN.reference_lines("qty", [], {
        "avg_line": "avg", "median_line": "median", "mode_line": "mode"}))
    return out.withColumns({c: F.round(c, 6) for c in ["avg_line", "median_line"]})


@register("an_reference_band", f"""SELECT l_returnflag, l_suppkey, qty,
  round(quantile_cont(qty, 0.25) OVER (PARTITION BY l_returnflag), 6) AS band_from,
  round(quantile_cont(qty, 0.75) OVER (PARTITION BY l_returnflag), 6) AS band_to FROM {_MARKS_SQL}""")
def q_reference_band(spark, d):
    out = marks(spark, d).transform(AN.reference_band("qty", ["l_returnflag"], 0.25, 0.75))
    return out.withColumns({c: F.round(c, 6) for c in ["band_from", "band_to"]})


@register("an_distribution", f"""SELECT l_returnflag, l_suppkey, qty,
  round(quantile_cont(qty, 0.1) OVER (PARTITION BY l_returnflag), 6) AS p10,
  round(quantile_cont(qty, 0.5) OVER (PARTITION BY l_returnflag), 6) AS p50,
  round(quantile_cont(qty, 0.9) OVER (PARTITION BY l_returnflag), 6) AS p90 FROM {_MARKS_SQL}""")
def q_distribution(spark, d):
    out = marks(spark, d).transform(AN.distribution("qty", ["l_returnflag"], [0.1, 0.5, 0.9]))
    return out.withColumns({c: F.round(c, 6) for c in ["p10", "p50", "p90"]})


_Z95 = 1.959963984540054  # two-sided 95 % normal quantile (fixed value)


@register("an_confidence_interval", f"""SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean,
  round(avg(l_extendedprice) - {_Z95} * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS ci_low,
  round(avg(l_extendedprice) + {_Z95} * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS ci_high,
  count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag""")
def q_confidence(spark, d):
    out = Tables(spark, d).lineitem.transform(AN.confidence_interval("l_extendedprice", ["l_returnflag"], 0.95))
    return out.withColumns({c: F.round(c, 6) for c in ["mean", "ci_low", "ci_high"]})


def _trend_sql(xexpr: str, yexpr: str, where: str = "") -> str:
    return (f"SELECT l_returnflag, round(regr_slope({yexpr}, {xexpr}), 6) AS slope, "
            f"round(regr_intercept({yexpr}, {xexpr}), 6) AS intercept, round(regr_r2({yexpr}, {xexpr}), 6) AS r2, "
            f"CAST(regr_count({yexpr}, {xexpr}) AS BIGINT) AS n FROM lineitem {where} GROUP BY l_returnflag")


def _trend_q(model):
    def run(spark, d):
        out = Tables(spark, d).lineitem.transform(AN.trend("l_quantity", "l_extendedprice", ["l_returnflag"], model))
        return out.withColumns({c: F.round(c, 6) for c in ["slope", "intercept", "r2"]})
    return run


register("an_trend_linear", _trend_sql("l_quantity", "l_extendedprice"))(_trend_q("linear"))
register("an_trend_exponential", _trend_sql("l_quantity", "ln(l_extendedprice)", "WHERE l_extendedprice > 0"))(
    _trend_q("exponential"))
register("an_trend_logarithmic", _trend_sql("ln(l_quantity)", "l_extendedprice", "WHERE l_quantity > 0"))(
    _trend_q("logarithmic"))
register("an_trend_power", _trend_sql("ln(l_quantity)", "ln(l_extendedprice)",
                                      "WHERE l_quantity > 0 AND l_extendedprice > 0"))(_trend_q("power"))


@register("an_trend_polynomial", """WITH d AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x,
    CAST(l_extendedprice AS DOUBLE) AS y, avg(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_returnflag) AS m FROM lineitem),
  s AS (SELECT l_returnflag, any_value(m) AS m, CAST(count(*) AS DOUBLE) AS n, sum(x - m) AS a1, sum((x - m) ** 2) AS a2,
    sum((x - m) ** 3) AS a3, sum((x - m) ** 4) AS a4, sum(y) AS b0, sum((x - m) * y) AS b1, sum((x - m) ** 2 * y) AS b2
    FROM d GROUP BY l_returnflag),
  t AS (SELECT *, n * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a2 * a3) + a2 * (a1 * a3 - a2 * a2) AS det FROM s),
  k AS (SELECT l_returnflag, m,
    (b0 * (a2 * a4 - a3 * a3) - a1 * (b1 * a4 - a3 * b2) + a2 * (b1 * a3 - a2 * b2)) / det AS k0,
    (n * (b1 * a4 - a3 * b2) - b0 * (a1 * a4 - a3 * a2) + a2 * (a1 * b2 - b1 * a2)) / det AS k1,
    (n * (a2 * b2 - b1 * a3) - a1 * (a1 * b2 - b1 * a2) + b0 * (a1 * a3 - a2 * a2)) / det AS k2 FROM t)
  SELECT l_returnflag, round(k0 - k1 * m + k2 * m * m, 4) AS c0, round(k1 - 2 * k2 * m, 4) AS c1, round(k2, 4) AS c2 FROM k""")
def q_trend_poly(spark, d):
    # Quadratic fit of price on quantity per return flag.
    out = Tables(spark, d).lineitem.transform(
        AN.trend_polynomial("l_quantity", "l_extendedprice", 2, ["l_returnflag"]))
    return out.withColumns({c: F.round(c, 4) for c in ["c0", "c1", "c2"]})


_MONTHLY_SQL = ("(SELECT o_orderpriority AS prio, date_trunc('month', o_orderdate) AS month, count(*) AS n "
                "FROM orders GROUP BY 1, 2)")


def _monthly(spark, d):
    return Tables(spark, d).orders.groupBy(F.col("o_orderpriority").alias("prio"),
                                           fn.datetrunc("month", "o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@register("an_trend_moving_average", f"""SELECT prio, month, round(avg(n) OVER (PARTITION BY prio ORDER BY month
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma3 FROM {_MONTHLY_SQL}""")
def q_moving_average(spark, d):
    out = _monthly(spark, d).transform(AN.moving_average("n", 3, "ma3", ["prio"], ["month"]))
    return out.select("prio", "month", F.round("ma3", 6).alias("ma3"))


@register("an_forecast")
def q_forecast(spark, d):
    # Monthly order counts per priority -> 6 months ahead with a 95 % interval.
    m = _monthly(spark, d).withColumn("t", (F.year("month") * 12 + F.month("month")).cast("long"))
    out = m.transform(AN.forecast(["prio"], "t", "n", periods=6, interval=0.95))
    return out.withColumns({c: F.round(c, 6) for c in ["forecast", "low", "high"]})


_SERIES_SQL = f"""s AS (SELECT prio, year(month) * 12 + month(month) AS t, n FROM {_MONTHLY_SQL} WHERE month(month) <> 7),
 grid AS (SELECT prio, unnest(range(min(t), max(t) + 1)) AS t FROM s GROUP BY prio),
 v AS (SELECT g.prio, g.t, coalesce(s.n, 0)::DOUBLE AS y, row_number() OVER (PARTITION BY g.prio ORDER BY g.t) AS i
  FROM grid g LEFT JOIN s ON s.prio = g.prio AND s.t = g.t),
 ends AS (SELECT prio, max(t) AS t, max(i) AS i FROM v GROUP BY prio)"""


def _gapped(spark, d):
    # No July: the missing months count as zero.
    m = _monthly(spark, d).where(F.month("month") != 7)
    return m.withColumn("t", (F.year("month") * 12 + F.month("month")).cast("long"))


@register("an_forecast_level", f"""WITH {_SERIES_SQL} SELECT v.prio, e.t + h AS t,
  round(sum(CASE WHEN v.i = 1 THEN 1 ELSE 0.3 END * pow(0.7, e.i - v.i) * y), 6) AS forecast
  FROM v JOIN ends e ON e.prio = v.prio, range(1, 4) r(h) GROUP BY v.prio, e.t + h""")
def q_forecast_level(spark, d):
    # Simple smoothing has a closed form.
    out = _gapped(spark, d).transform(AN.forecast(["prio"], "t", "n", 3, model="level", missing="zero", params=(0.3, None, None)))
    return out.select("prio", "t", F.round("forecast", 6).alias("forecast"))


@register("an_forecast_seasonal", f"""WITH RECURSIVE {_SERIES_SQL},
 st AS (SELECT prio, avg(y) FILTER (i <= 12) AS l1, avg(y) FILTER (i BETWEEN 13 AND 24) AS l2, list(y ORDER BY i) FILTER (i <= 12) AS y1
  FROM v GROUP BY prio),
 r AS (SELECT prio, 12::BIGINT AS i, l1 AS l, (l2 - l1) / 12 AS b, list_transform(y1, lambda x: x - l1) AS s FROM st
  UNION ALL SELECT r.prio, v.i, 0.3::DOUBLE * (y - s[1]) + 0.7::DOUBLE * (l + b),
   0.1::DOUBLE * (0.3::DOUBLE * (y - s[1]) + 0.7::DOUBLE * (l + b) - l) + 0.9::DOUBLE * b,
   list_append(s[2:], 0.2::DOUBLE * (y - 0.3::DOUBLE * (y - s[1]) - 0.7::DOUBLE * (l + b)) + 0.8::DOUBLE * s[1])
  FROM r JOIN v ON v.prio = r.prio AND v.i = r.i + 1)
SELECT r.prio, e.t + h AS t, round(l + h * b + s[h], 6) AS forecast FROM r JOIN ends e ON e.prio = r.prio AND e.i = r.i, range(1, 7) x(h)""")
def q_forecast_seasonal(spark, d):
    # Trend and season of 12 months with fixed parameters, against the same recursion in SQL.
    out = _gapped(spark, d).transform(AN.forecast(["prio"], "t", "n", 6, model="seasonal", season=12, missing="zero", params=(0.3, 0.1, 0.2)))
    return out.select("prio", "t", F.round("forecast", 6).alias("forecast"))


# Three centres in 64 dimensions.
_CENTRES = [[round(0.1 * ((i * (k + 2)) % 5 - 2), 1) for i in range(64)] for k in range(3)]


@register("an_cluster_assign", "WITH d AS (SELECT vec_id, [" + ", ".join(
    f"list_sum(list_transform(list_zip(embedding, {c}::DOUBLE[]), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))" for c in _CENTRES) +
    "] AS far FROM embeddings) SELECT vec_id, CAST(list_position(far, list_min(far)) - 1 AS BIGINT) AS cluster, round(list_min(far), 6) AS distance FROM d")
def q_cluster_assign(spark, d):
    # The assignment step of k-means, with given centres.
    out = Tables(spark, d).embeddings.transform(AN.nearest_centre("embedding", _CENTRES, distance="distance"))
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@register("an_cluster")
def q_cluster(spark, d):
    # Embedding vectors clustered with k chosen by silhouette.
    e = Tables(spark, d).embeddings
    return e.transform(AN.cluster("embedding", k=None, seed=42, k_range=range(2, 6))).select("vec_id", "label", "cluster")


@register("an_histogram", """SELECT floor(l_extendedprice / 10000) * 10000 AS bin, count(*) AS count FROM lineitem
  GROUP BY 1""")
def q_histogram(spark, d):
    return Tables(spark, d).lineitem.transform(AN.histogram("l_extendedprice", 10000)).withColumn(
        "bin", F.col("bin").cast("double"))


@register("an_box_plot", """SELECT l_returnflag, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3,
  max(l_extendedprice) AS max,
  round(greatest(min(l_extendedprice), quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75)
    - quantile_cont(l_extendedprice, 0.25))), 6) AS whisker_low,
  round(least(max(l_extendedprice), quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75)
    - quantile_cont(l_extendedprice, 0.25))), 6) AS whisker_high FROM lineitem GROUP BY l_returnflag""")
def q_box_plot(spark, d):
    out = Tables(spark, d).lineitem.transform(AN.box_plot("l_extendedprice", ["l_returnflag"]))
    return out.withColumns({c: F.round(c, 6) for c in ["whisker_low", "whisker_high"]})


@register("an_pareto", """SELECT l_suppkey, round(value, 2) AS value, round(sum(value) OVER (ORDER BY value DESC, l_suppkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(value) OVER (), 8) AS cumulative_share FROM
  (SELECT l_suppkey, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1)""")
def q_pareto(spark, d):
    out = Tables(spark, d).lineitem.transform(AN.pareto("l_suppkey", F.sum("l_extendedprice")))
    return out.select("l_suppkey", F.round("value", 2).alias("value"),
                      F.round("cumulative_share", 8).alias("cumulative_share"))


@register("an_waterfall", """SELECT month, n, CAST(sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
  AS step_end, CAST(sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT)
  AS step_start FROM
  (SELECT date_trunc('month', o_orderdate) AS month, count(*) - 190 AS n FROM orders GROUP BY 1)""")
def q_waterfall(spark, d):
    v = Tables(spark, d).orders.groupBy(fn.datetrunc("month", "o_orderdate").alias("month")).agg(
        (F.count(F.lit(1)) - 190).alias("n"))
    return v.transform(AN.waterfall("n", ["month"]))


@register("an_sparkline", """SELECT o_custkey, list(struct_pack(period := y, value := round(v, 2)) ORDER BY y) AS series
  FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")
def q_sparkline(spark, d):
    return Tables(spark, d).orders.transform(AN.sparkline(
        ["o_custkey"], F.year("o_orderdate").cast("long"), F.round(F.sum("o_totalprice"), 2)))


@register("an_calendar_heatmap", "SELECT year, week, " + ", ".join(
    f'count(*) FILTER (WHERE dayofweek(ts) + 1 = {i}) AS "{i}"' for i in range(1, 8)) + """ FROM (SELECT ts,
  year(ts) AS year, CAST(floor((dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) / 7) + 1 AS BIGINT) AS week
  FROM events) GROUP BY year, week""")
def q_heatmap(spark, d):
    out = Tables(spark, d).events.transform(AN.calendar_heatmap("ts", F.count(F.lit(1))))
    return out.fillna(0, subset=[str(i) for i in range(1, 8)])
