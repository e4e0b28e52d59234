"""Registered queries: incremental refresh, streaming KPIs, diff and merge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.sources.tables import Tables
from tessera.streaming import incremental as inc
from tessera.streaming import kpi

_DAILY_SQL = ("(SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS revenue, count(*) AS n "
              "FROM orders GROUP BY 1)")


def _daily(t):
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("order_day")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n"))


@register("inc_refresh_policy", f"""SELECT day, round(revenue, 2) AS revenue, n FROM {_DAILY_SQL}
  WHERE day >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 364 DAY""")
def q_refresh(spark, d):
    t = Tables(spark, d)
    daily = _daily(t)
    path = inc.scratch_path(spark, "refresh")
    newest = daily.agg(F.max("order_day")).first()[0]
    # State before the refresh: every day loaded, the newest days still stale.
    stale = daily.withColumn("revenue", F.when(F.col("order_day") > F.lit(newest - dt.timedelta(days=3)), F.lit(0.0))
                             .otherwise(F.col("revenue")))
    inc.initial_load(stale, "order_day", path)
    # the policy finds the date column itself (order_day)
    out = inc.refresh_policy(daily, None, path, refresh_days=3, keep_days=365)
    return out.select(F.col("order_day").alias("day"), F.round("revenue", 2).alias("revenue"), "n")


@register("inc_append_stream", "SELECT * FROM events")
def q_append_stream(spark, d):
    schema = Tables(spark, d).events.schema
    sink = inc.scratch_path(spark, "append-sink")
    inc.append_stream(spark, d, "events.parquet", schema, "event_id", "ts", sink, sink + "-checkpoint")
    return spark.read.parquet(sink)


@register("str_kpi_tumbling", """SELECT date_trunc('day', ts) AS window_start,
  date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS events, round(sum(value), 2) AS total
  FROM events GROUP BY 1, 2, 3""")
def q_kpi_tumbling(spark, d):
    schema = Tables(spark, d).events.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    agg = kpi.kpi_stream(stream, "ts", "day", ["event_type"],
                         {"events": F.count(F.lit(1)), "total": F.sum("value")}, delay="1 day")
    sink = inc.scratch_path(spark, "kpi-sink")
    out = kpi.run_to_table(spark, agg, sink, sink + "-checkpoint", ["window_start", "window_end", "event_type"])
    return out.withColumn("total", F.round("total", 2))


# Arrival in three files: the first third of the time span, the second third, and the rest; every tenth event comes in
# the last file whatever its time, and every seventh event of the first file comes again in the second.
_SPAN = "(SELECT min(ts) AS lo, max(ts) - min(ts) AS span FROM events)"
_ARRIVALS_SQL = f"""arrivals AS (SELECT e.*, CASE WHEN event_id % 10 = 0 OR ts >= lo + span * 2 / 3 THEN 2 WHEN ts >= lo + span / 3 THEN 1
  ELSE 0 END AS b FROM events e, {_SPAN}), files AS (SELECT * FROM arrivals UNION ALL SELECT * REPLACE (1 AS b) FROM arrivals
  WHERE b = 0 AND event_id % 7 = 0), marks AS (SELECT b, max(epoch_ms(ts)) - 86400000 AS top FROM files GROUP BY b),
 timed AS (SELECT f.*, epoch_ms(ts) AS ms, coalesce((SELECT max(top) FROM marks m WHERE m.b < f.b), 0) AS wm FROM files f)"""


FILE_ROWS = 1_000_000


def _arrivals(spark, d) -> tuple[str, int]:
    """Folder of the three arrivals, and the number of files that each has: one task writes about ``FILE_ROWS`` rows."""
    e = Tables(spark, d).events
    lo, hi, n = e.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    files = max(1, -(-n // (3 * FILE_ROWS)))
    at = lambda k: F.lit(lo + (hi - lo) * k / 3)
    b = F.when((F.col("event_id") % 10 == 0) | (F.col("ts") >= at(2)), 2).when(F.col("ts") >= at(1), 1).otherwise(0)
    path = inc.scratch_path(spark, "arrivals")
    for k in range(3):
        again = e.where((b == 0) & (F.col("event_id") % 7 == 0)) if k == 1 else e.limit(0)
        rows, folder = e.where(b == k).unionByName(again), f"{path}/file{k}"
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.parquet(folder)
        # Partitions without rows have no file: as many files without rows instead, so that each arrival is one batch.
        for _ in range(files - len(spark.read.schema(e.schema).parquet(folder).inputFiles())):
            e.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return path, files


def _arriving(spark, d):
    path, files = _arrivals(spark, d)
    return spark.readStream.schema(Tables(spark, d).events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


@register("inc_append_late", f"""WITH {_ARRIVALS_SQL} SELECT event_id, CASE WHEN ms < wm THEN 'late'
  WHEN row_number() OVER (PARTITION BY event_id, ms < wm ORDER BY b) > 1 THEN 'duplicate' ELSE 'new' END AS status,
  round(value, 6) AS value FROM timed""")
def q_append_late(spark, d):
    """Three arrivals with late and repeated rows: written and quarantined rows together are all rows."""
    sink = inc.scratch_path(spark, "checked-sink")
    inc.append_checked(_arriving(spark, d), "event_id", "ts", sink, sink + "-checkpoint", "1 day", "400 days")
    cols = ["event_id", F.round("value", 6).alias("value")]
    return inc.appended(spark, sink).select(*cols, F.lit("new").alias("status")).unionByName(
        inc.quarantined(spark, sink).select(*cols, F.col(inc.STATUS).alias("status"))).select("event_id", "status", "value")


@register("str_kpi_calendar", f"""WITH {_ARRIVALS_SQL} SELECT date_trunc('month', ts) AS window_start,
  date_trunc('month', ts) + INTERVAL 1 MONTH AS window_end, event_type, count(*) AS events, round(sum(value), 2) AS total,
  max(value) AS top, epoch_ms(date_trunc('month', any_value(ts)) + INTERVAL 1 MONTH) <= (SELECT max(top) FROM marks) AS closed
  FROM timed WHERE epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY) > (SELECT coalesce(max(top), 0) FROM marks m WHERE m.b < timed.b - 1)
  GROUP BY 1, 2, 3""")
def q_kpi_calendar(spark, d):
    """Monthly KPIs of the three arrivals; a row whose day an earlier batch has closed does not count (a batch closes days by
    the events of the batches before it)."""
    sink = inc.scratch_path(spark, "calendar-sink")
    out, _ = kpi.calendar_stream(spark, _arriving(spark, d), "ts", "month", ["event_type"], {
        "events": ("count", F.lit(1)), "total": ("sum", F.col("value")), "top": ("max", F.col("value"))}, sink, sink + "-checkpoint")
    return out.withColumn("total", F.round("total", 2))


@register("kpi_vs_target", """SELECT date_trunc('month', o_orderdate) AS period, round(sum(o_totalprice), 2) AS actual,
  CAST(3000000.0 AS DOUBLE) AS target, round(sum(o_totalprice) - 3000000.0, 2) AS variance,
  round(sum(o_totalprice) / 3000000.0, 8) AS attainment,
  CASE WHEN sum(o_totalprice) >= 3000000.0 THEN 'on track' ELSE 'behind' END AS status
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def q_kpi_vs_target(spark, d):
    out = kpi.kpi_vs_target(Tables(spark, d).orders, "o_orderdate", "month", F.sum("o_totalprice"), 3_000_000.0,
                            filters=F.col("o_orderstatus") == "F")
    return out.withColumns({"actual": F.round("actual", 2), "variance": F.round("variance", 2),
                            "attainment": F.round("attainment", 8)})


_OLD_SQL = ("(SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '2000-06-01' THEN 'O' "
            "ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders "
            "WHERE o_orderdate < TIMESTAMP '2001-01-01')")
_NEW_SQL = ("(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders "
            "WHERE o_orderdate >= TIMESTAMP '1995-06-01')")


def _snapshots(t):
    o = t.orders
    old = o.filter(F.col("o_orderdate") < F.lit(dt.datetime(2001, 1, 1))).select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderdate") >= F.lit(dt.datetime(2000, 6, 1)), F.lit("O"))
        .otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", "o_orderpriority")
    new = o.filter(F.col("o_orderdate") >= F.lit(dt.datetime(1995, 6, 1))).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return old, new


@register("inc_table_diff", f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
  WHEN a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus
   AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority
  THEN 'unchanged' ELSE 'modified' END AS change FROM {_OLD_SQL} a FULL JOIN {_NEW_SQL} b ON a.o_orderkey = b.o_orderkey""")
def q_table_diff(spark, d):
    old, new = _snapshots(Tables(spark, d))
    return inc.table_diff(old, new, ["o_orderkey"])


@register("inc_row_diff", f"""SELECT o_custkey, o_orderstatus, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new FROM (
  SELECT nullif(o_custkey % 50, 0) AS o_custkey, o_orderstatus, 1 AS o, 0 AS n FROM {_OLD_SQL}
  UNION ALL SELECT nullif(o_custkey % 50, 0), o_orderstatus, 0, 1 FROM {_NEW_SQL}) GROUP BY 1, 2""")
def q_row_diff(spark, d):
    # Repeated rows and null keys on both sides.
    some = lambda t: t.select(F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("o_custkey"), "o_orderstatus")
    old, new = _snapshots(Tables(spark, d))
    return inc.row_diff(some(old), some(new), ["o_custkey"])


@register("inc_merge_preserve", f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_custkey ELSE a.o_custkey END AS o_custkey,
  CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus,
  CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice,
  CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_orderpriority ELSE a.o_orderpriority END AS o_orderpriority,
  a.user_note AS user_note
  FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'call customer' END AS user_note FROM {_OLD_SQL}) a
  FULL JOIN {_NEW_SQL} b ON a.o_orderkey = b.o_orderkey""")
def q_merge_preserve(spark, d):
    old, new = _snapshots(Tables(spark, d))
    target = old.withColumn("user_note", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("call customer")))
    return inc.merge_preserve(target, new, ["o_orderkey"], keep=["user_note"])
