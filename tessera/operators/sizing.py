"""Plan-size checks used to choose between plans: an estimate where it is far below the budget, else the rows' measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark conf key and default for the per-task budget below which an ordered
# operator may use a single window plan: the whole input (an upper-bound
# estimate) fits one task, so no group can exceed it.
SINGLE_TASK_CONF = "tessera.scan.singleTaskBytes"
DEFAULT_SINGLE_TASK_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes, compressed, scaled by the
    columns read); no job runs.  Above joins it can be far too large."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


# Fixed value: files are taken to unpack to at most this many times their size, so a smaller estimate decides alone.
UNPACKED = 16


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows themselves: lengths of texts and arrays are added up by one job, whose answer is kept with ``df``."""
    known = df.__dict__.get("_tsr_bytes")
    if known is None:
        flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        row = sum((_bytes(F.col(f.name), f.dataType) for f in flat.schema.fields), F.lit(8).cast("bigint"))
        known = df.__dict__["_tsr_bytes"] = int(flat.agg(F.sum(row).alias("n")).first()["n"] or 0)
    return known


def _bytes(c: Column, t: T.DataType) -> Column:
    """Bytes of one value, as an expression."""
    size = lambda n: F.coalesce(n, F.lit(0)).cast("bigint")
    if isinstance(t, (T.StringType, T.BinaryType)):
        return size(F.octet_length(c)) + 8
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return size(F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + _bytes(x, t.elementType))) + 8
        return size(F.size(c)) * 8 + 8
    if isinstance(t, T.MapType):
        return _bytes(F.map_keys(c), T.ArrayType(t.keyType)) + _bytes(F.map_values(c), T.ArrayType(t.valueType))
    if isinstance(t, T.StructType) and len({n.lower() for n in t.names}) == len(t.names):
        return sum((_bytes(c.getField(f.name), f.dataType) for f in t.fields), F.lit(8).cast("bigint"))
    return F.lit(16 if isinstance(t, (T.DecimalType, T.CalendarIntervalType)) else 8).cast("bigint")


def task_bytes(df: DataFrame) -> int:
    """The budget of one task (``SINGLE_TASK_CONF``)."""
    return int(df.sparkSession.conf.get(SINGLE_TASK_CONF, str(DEFAULT_SINGLE_TASK_BYTES)))


def fits_one_task(df: DataFrame) -> bool:
    """True if the whole input fits one task: by the estimate if that is far smaller, else by measuring the rows."""
    limit = task_bytes(df)
    return UNPACKED * estimated_bytes(df) <= limit or measured_bytes(df) <= limit


def resolve_skew_safe(df: DataFrame, skew_safe: bool | None) -> bool:
    """``None`` (the default everywhere): segmented plan unless the whole input
    fits one task.  Both plans give the same rows and types; only the cost differs."""
    if skew_safe is not None:
        return bool(skew_safe)
    return not fits_one_task(df)


# Spark conf key for the target size of one range segment of an ordered scan;
# by default Spark's advisory shuffle partition size (64 MiB).
SEGMENT_BYTES_CONF = "tessera.scan.segmentBytes"


def num_segments(df: DataFrame, requested: int | None = None) -> int:
    """Range segments for an ordered scan: one per segment-size of input, as many as that takes."""
    if requested:
        return int(requested)
    conf = df.sparkSession.conf
    target = conf.get(SEGMENT_BYTES_CONF, None) or conf.get(
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864")
    target = max(_parse_bytes(target), 1)
    size = UNPACKED * estimated_bytes(df)
    if size > target:
        size = measured_bytes(df)
    return max(1, -(-size // target))


def _parse_bytes(v: str) -> int:
    v = str(v).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    for suffix in ("b", ""):
        if suffix and v.endswith(suffix):
            v = v[: -len(suffix)]
    if v and v[-1] in units:
        return int(float(v[:-1]) * units[v[-1]])
    return int(float(v))
