"""KPI jobs: tumbling-window KPIs on a stream, KPI versus target in batch.

Streams need a TIMESTAMP event time (``withWatermark`` rejects TIMESTAMP_NTZ),
so the event column is cast first.  ``window()`` takes fixed durations only:
``kpi_stream`` has hour, day and week grains, ``calendar_stream`` adds up days to
months, quarters and years.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Streaming grains and their window durations.
GRAINS = {"hour": "1 hour", "day": "1 day", "week": "7 days"}


def kpi_stream(stream: DataFrame, event_time: str, grain: str, group_by: list[str],
               measures: Mapping[str, Column], delay: str = "1 day") -> DataFrame:
    """Tumbling-window KPI aggregation; rows past the watermark are not added (see ``late_rows``).

    Weeks start on Sunday (the 7-day windows are offset from the Thursday epoch).
    """
    dur = GRAINS[grain]
    start = "3 days" if grain == "week" else None
    ts = F.col(event_time).cast("timestamp")
    s = stream.withColumn("_et", ts).withWatermark("_et", delay)
    win = F.window("_et", dur, dur, start) if start else F.window("_et", dur)
    agg = s.groupBy(win.alias("w"), *group_by).agg(*[m.alias(n) for n, m in measures.items()])
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), *group_by, *measures)


def run(spark: SparkSession, stream_df: DataFrame, sink_path: str, checkpoint: str, keys: list[str]) -> tuple[DataFrame, StreamingQuery]:
    """Run a streaming aggregate (availableNow); every window, closed or still open, and the finished query.

    The stream runs in update mode; each micro-batch writes the windows that it
    changed to a folder of its own (overwritten if the batch is repeated), and
    the table is the latest version of each key.  :func:`late_rows` of the query
    counts the rows that came after the watermark had passed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/_batch={batch_id}")

    # The query keeps the progress of its last batches only; all of them are counted later.
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept, None)
    spark.conf.set(kept, str(10**6))
    try:
        q = (stream_df.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(kept)
        else:
            spark.conf.set(kept, before)
    versions = spark.read.parquet(sink_path)
    rest = [c for c in stream_df.columns if c not in keys]
    latest = versions.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("_v"))
    return latest.select(*[F.col(c) if c in keys else F.col("_v")[c].alias(c) for c in stream_df.columns]), q


def run_to_table(spark: SparkSession, stream_df: DataFrame, sink_path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """The table of :func:`run`."""
    return run(spark, stream_df, sink_path, checkpoint, keys)[0]


def late_rows(query: StreamingQuery) -> int:
    """Rows that the finished query's stateful operators dropped because they came after the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


# Calendar grains and their months.
CALENDAR = {"month": 1, "quarter": 3, "year": 12}
# Mergeable measures: what a day keeps, and how days add up.
_MERGE = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def calendar_stream(spark: SparkSession, stream: DataFrame, event_time: str, grain: str, group_by: list[str],
                    measures: Mapping[str, tuple[str, Column]], sink_path: str, checkpoint: str,
                    delay: str = "1 day") -> tuple[DataFrame, StreamingQuery]:
    """KPIs by month, quarter or year of a stream, which windows of a fixed duration cannot cut.

    Days are: the stream keeps one row per day and group (partial sums map-side, state bounded by the delay), and the
    calendar periods add up the days, so ``measures`` are mergeable: name -> (``sum``, ``count``, ``min`` or
    ``max``, column).  ``closed`` tells that no later row can change a period: the watermark is past its end.
    Returns every period, closed or open, and the finished query.
    """
    days = kpi_stream(stream, event_time, "day", group_by, {n: _MERGE[k][0](c) for n, (k, c) in measures.items()}, delay)
    table, q = run(spark, days, sink_path, checkpoint, ["window_start", "window_end", *group_by])
    start = F.date_trunc(grain, F.col("window_start")).cast("timestamp_ntz")
    out = table.where(F.col("window_start").isNotNull()).groupBy(start.alias("window_start"), *group_by).agg(
        *[_MERGE[k][1](n).alias(n) for n, (k, _) in measures.items()])
    end = F.col("window_start") + F.make_ym_interval(F.lit(0), F.lit(CALENDAR[grain]))
    ms = watermark_ms(q, delay)
    closed = F.lit(False) if ms is None else F.unix_millis(end.cast("timestamp")) <= ms
    return out.select("window_start", end.cast("timestamp_ntz").alias("window_end"), *group_by, *measures, closed.alias("closed")), q


def watermark_ms(query: StreamingQuery, delay: str) -> int | None:
    """Watermark after the finished query's last batch, in milliseconds; None if it saw no event time."""
    spark = SparkSession.getActiveSession()
    seen = [p["eventTime"] for p in query.recentProgress if p["eventTime"]]
    marks = [t["watermark"] for t in seen if "watermark" in t]
    tops = [t["max"] for t in seen if "max" in t]
    if not marks and not tops:
        return None
    # A batch reports the watermark that it ran with; its own latest event moves the next one.
    values = [F.unix_millis(F.lit(m).cast("timestamp")) for m in marks] + [
        F.unix_millis(F.lit(m).cast("timestamp") - F.expr(f"interval '{delay}'")) for m in tops]
    return spark.range(1).select(F.greatest(*values, values[0]).alias("ms")).first()["ms"]


def kpi_vs_target(df: DataFrame, date_col: str, grain: str, measure: Column, target: float | Column,
                  filters: Column | None = None, group_by: list[str] | None = None) -> DataFrame:
    """KPI value per period with target, variance, attainment and status."""
    d = df.filter(filters) if filters is not None else df
    period = F.date_trunc(grain, F.col(date_col)).cast("timestamp_ntz")
    agg = d.groupBy(period.alias("period"), *(group_by or [])).agg(measure.alias("actual"))
    tgt = target if isinstance(target, Column) else F.lit(float(target))
    return agg.withColumns({
        "target": tgt, "variance": F.col("actual") - tgt,
        "attainment": F.try_divide(F.col("actual"), tgt),
    }).withColumn("status", F.when(F.col("actual") >= F.col("target"), "on track").otherwise("behind"))
