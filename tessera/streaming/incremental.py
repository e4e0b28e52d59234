"""Incremental refresh, stream ingest, table diff and merge that keeps user edits.

Every job writes under the shared folder named by ``spark.checkpoint.dir``
(``tessera.session.checkpoint_dir``), never a machine-local temp folder, so a
lost executor only re-runs tasks and a restarted stream resumes from its
checkpoint.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tessera.operators import reshape
from tessera.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the Hadoop file system of the path (HDFS, S3, local)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p, True)


def _list_partitions(spark: SparkSession, path: str, col: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p)
            if s.isDirectory() and s.getPath().getName().startswith(f"{col}=")]


def best_date_column(df: DataFrame) -> str:
    """The date column an incremental policy keys on when none is named: the
    first DATE or TIMESTAMP column, preferring names that mention a date."""
    from pyspark.sql import types as T
    cands = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not cands:
        raise ValueError("no date or timestamp column")
    named = [c for c in cands if "date" in c.lower() or "day" in c.lower()]
    return (named or cands)[0]


def _period(col: Column, granularity: str) -> Column:
    return F.date_trunc(granularity, col).cast("date")


def refresh_policy(source: DataFrame, date_col: str | None, table_path: str, refresh_days: int = 3,
                   keep_days: int = 365, partition_col: str = "period", granularity: str = "month") -> DataFrame:
    """Incremental refresh of a period-partitioned parquet table.

    * rows of the last ``refresh_days`` days (relative to the newest source
      date) are recomputed: the partitions holding them are rebuilt from the
      source with a dynamic partition overwrite, which touches only those
      partitions;
    * rows older than ``keep_days`` are dropped: whole partitions before the
      cutoff are deleted and the partition holding the cutoff is rewritten
      without its older rows.

    Partitions are ``granularity`` periods (month by default, or day).
    Returns the refreshed table.
    """
    import datetime as _dt

    spark = source.sparkSession
    date_col = date_col or best_date_column(source)
    newest = source.agg(F.max(F.col(date_col).cast("date"))).first()[0]
    if newest is None:
        return spark.read.parquet(table_path)
    keep_from = newest - _dt.timedelta(days=keep_days - 1)
    refresh_from = max(newest - _dt.timedelta(days=refresh_days - 1), keep_from)
    day = F.col(date_col).cast("date")
    rebuild = (_period(day, granularity) >= _period(F.lit(refresh_from), granularity)) | \
              (_period(day, granularity) == _period(F.lit(keep_from), granularity))
    fresh = source.filter(rebuild & (day >= F.lit(keep_from))).withColumn(partition_col, _period(day, granularity))
    (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(table_path))
    cutoff_period = spark.range(1).select(_period(F.lit(keep_from), granularity)).first()[0]
    for part in _list_partitions(spark, table_path, partition_col):
        if _dt.date.fromisoformat(part) < cutoff_period:
            _delete_path(spark, f"{table_path.rstrip('/')}/{partition_col}={part}")
    return spark.read.parquet(table_path)


def initial_load(source: DataFrame, date_col: str, table_path: str, partition_col: str = "period",
                 granularity: str = "month") -> None:
    """Full load of a period-partitioned table (the state before incremental refreshes)."""
    (source.withColumn(partition_col, _period(F.col(date_col).cast("date"), granularity))
     .write.mode("overwrite").partitionBy(partition_col).parquet(table_path))


def append_stream(spark: SparkSession, source_dir: str, file_glob: str, schema, key: str, event_time: str,
                  sink_path: str, checkpoint: str, delay: str = "1 day"):
    """Stream ingest of only-new rows: file source -> event-time watermark ->
    de-duplication of the key within the watermark -> parquet file sink with a
    checkpoint (exactly-once file sink).  Runs with ``availableNow`` and
    returns the finished query; ``kpi.late_rows`` tells how many rows came after
    the watermark had passed and were not written (:func:`append_checked` keeps them)."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(source_dir)
              .withColumn("_event_time", F.col(event_time).cast("timestamp"))
              .withWatermark("_event_time", delay)
              .dropDuplicatesWithinWatermark([key])
              .drop("_event_time"))
    q = (stream.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _name(key):
    """A key as a dictionary takes it: equal for equal keys, not-a-number and arrays too."""
    try:
        hash(key)
    except TypeError:
        return repr(key)
    return key if key == key else repr(key)


class _Sorter(StatefulProcessor):
    """Marks the rows of a group of keys: ``new``, ``duplicate`` (within the horizon of the key's last new one), ``late`` or ``no_time``.

    The state is the event time of each key's last new row, all keys of the group in one value: it is read and written
    once a batch, not once a key.  What is past its horizon is dropped on the next batch, or by an event-time timer.
    """

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at binary")

    def _read(self, watermark: int) -> tuple[int, dict]:
        held = self.kept.get()
        before = pickle.loads(held[0]) if held else {}
        return len(before), {k: at for k, at in before.items() if at + self.horizon > watermark}

    def _write(self, kept: dict) -> None:
        if kept:
            self.kept.update((pickle.dumps(kept, 4),))
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        on_time = []
        for row in rows:
            if row["ms"] is None:
                yield Row(row=row["row"], status="no_time")
            elif row["ms"] < watermark:
                yield Row(row=row["row"], status="late")
            else:
                on_time.append((row["ms"], row["row"], _name(row["key"])))
        if not on_time:
            return
        times = {}
        for ms, _, k in on_time:
            times[k, ms] = times.get((k, ms), 0) + 1
        _, kept = self._read(watermark)
        # Within a batch the earliest row of a key is the new one, whatever the order of arrival.
        on_time.sort(key=lambda r: (r[0], str(r[1]) if times[r[2], r[0]] > 1 else ""))
        latest = None
        for ms, row, k in on_time:
            last = kept.get(k)
            new = last is None or abs(ms - last) >= self.horizon
            if new:
                kept[k] = latest = ms
            yield Row(row=row, status="new" if new else "duplicate")
        if latest is not None:
            self._write(kept)
            self.handle.registerTimer(latest + self.horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before, kept = self._read(expiredTimerInfo.getExpiryTimeInMs())
        if len(kept) < before:
            self._write(kept)
        return iter([])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "_status"


def append_checked(stream: DataFrame, key: str, event_time: str, sink_path: str, checkpoint: str, delay: str = "1 day",
                   horizon: str = "30 days", groups: int = 1 << 11):
    """Stream ingest that keeps every row: new rows of each key, and beside them those that are not.

    A row whose event time is before the watermark (the latest event time of earlier batches less ``delay``) is
    ``late``; one of a key that already has a new row less than ``horizon`` away in event time is a ``duplicate``;
    one without event time is ``no_time``.  All go to ``sink_path``, by batch and status; a batch that is repeated
    overwrites its own folder.  Read them with :func:`appended` and :func:`quarantined`: together they are all
    rows.  Null keys are one key.  Keyed state is one number, dropped by an event-time timer; it lives in RocksDB, so
    it may outgrow memory.  Keys are dealt to ``groups`` by a hash, and a batch reads and writes the state of each group
    that it touches once; a checkpoint keeps its number of groups, about one for each ten thousand keys within the horizon.
    The rows that a group has in one batch are sorted in one task: key by something that identifies a row.  Runs with ``availableNow`` and returns the finished query.
    """
    spark = stream.sparkSession
    horizon_ms = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00+00:00' + interval '{horizon}') AS ms").first()["ms"]
    fields = [f.name for f in stream.schema.fields]
    timed = stream.withColumn("_event_time", F.col(event_time).cast("timestamp")).withWatermark("_event_time", delay)
    # Without the event-time column itself the engine passes late rows on instead of dropping them.
    rows = timed.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("part"), F.col(key).alias("key"), F.unix_millis("_event_time").alias("ms"), F.struct(*fields).alias("row"))
    schema = T.StructType([T.StructField("row", stream.schema), T.StructField("status", T.StringType())])
    marked = rows.groupBy("part").transformWithState(_Sorter(horizon_ms), schema, "append", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("row.*", F.col("status").alias(STATUS)).write.mode("overwrite").partitionBy(STATUS).parquet(f"{sink_path}/_batch={batch_id}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKS)
    try:
        q = marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    q.awaitTermination()
    return q


def _checked(spark: SparkSession, sink_path: str) -> DataFrame:
    return spark.read.option("basePath", sink_path).parquet(f"{sink_path}/_batch=*")


def appended(spark: SparkSession, sink_path: str) -> DataFrame:
    """The new rows that :func:`append_checked` wrote."""
    return _checked(spark, sink_path).where(F.col(STATUS) == "new").drop("_batch", STATUS)


def quarantined(spark: SparkSession, sink_path: str) -> DataFrame:
    """The rows that it did not take, with their ``_status`` and ``_batch``."""
    return _checked(spark, sink_path).where(F.col(STATUS) != "new")


def row_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multiset difference of two tables: every distinct row with how often it occurs in each (``n_old``, ``n_new``).

    Rows are compared null-safe and as a whole; a column that one table lacks is null there, a column of another
    type is compared as text.  Maps, which cannot be grouped, are compared as sorted entries.  One shuffle, with
    partial counts, so a row or key that fills the table costs one row per task.
    """
    sides = reshape.union([new.withColumn("_side", F.lit(1))])(old.withColumn("_side", F.lit(0)))
    value = {f.name: F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
             for f in sides.schema.fields if f.name != "_side"}
    rows = sides.select(*[v.alias(c) for c, v in value.items()], "_side")
    return rows.groupBy(*[F.col(f"`{c}`") for c in value]).agg(
        F.count_if(F.col("_side") == 0).alias("n_old"), F.count_if(F.col("_side") == 1).alias("n_new"))


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], name: str = "change") -> DataFrame:
    """One row per key: added / removed / modified / unchanged.

    A key's rows are compared as a multiset (:func:`row_diff`), in any order: repeated rows count, null keys are a
    key like any other, and a column that one table lacks is null there.
    """
    keys = list(keys)
    per_key = row_diff(old, new, keys).groupBy(*keys).agg(
        F.sum("n_old").alias("_o"), F.sum("n_new").alias("_n"), F.sum(F.abs(F.col("n_new") - F.col("n_old"))).alias("_d"))
    change = F.when(F.col("_o") == 0, "added").when(F.col("_n") == 0, "removed").when(F.col("_d") == 0, "unchanged").otherwise("modified")
    return per_key.select(*keys, change.alias(name))


def merge_preserve(target: DataFrame, source: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Upsert ``source`` into ``target``: source values win, except the ``keep``
    columns (user edits) which come from the target when it has the row.
    Target rows missing from the source stay.  Null keys match each other."""
    keys = list(keys)
    keep = list(keep)
    cols = [c for c in source.columns if c not in keys]
    t = target.select(*[F.col(k).alias(f"_tk_{k}") for k in keys], *[F.col(c).alias(f"_t_{c}") for c in target.columns if c not in keys],
                      F.lit(True).alias("_in_t"))
    s = source.select(*[F.col(k).alias(f"_sk_{k}") for k in keys], *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_s"))
    j = t.join(s, reduce(and_, [F.col(f"_tk_{k}").eqNullSafe(F.col(f"_sk_{k}")) for k in keys]), "full")
    out_cols: list[Column] = [F.when(F.col("_in_t").isNotNull(), F.col(f"_tk_{k}")).otherwise(F.col(f"_sk_{k}")).alias(k) for k in keys]
    for c in dict.fromkeys(cols + [c for c in target.columns if c not in keys]):
        has_t = f"_t_{c}" in j.columns
        has_s = f"_s_{c}" in j.columns
        if c in keep and has_t:
            val = F.when(F.col("_in_t").isNotNull(), F.col(f"_t_{c}")).otherwise(
                F.col(f"_s_{c}") if has_s else F.lit(None))
        elif has_s:
            val = F.when(F.col("_in_s").isNotNull(), F.col(f"_s_{c}")).otherwise(
                F.col(f"_t_{c}") if has_t else F.lit(None))
        else:
            val = F.col(f"_t_{c}")
        out_cols.append(val.alias(c))
    return j.select(*out_cols)
