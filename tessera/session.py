"""Session helpers.

``get_spark`` builds a session with the settings every operator assumes:
UTC session time zone (date semantics are wall-clock), AQE on (runtime
coalescing, skew-join splitting, broadcast conversion by measured size) and
the UI off.  On a cluster the caller's existing session is reused untouched.

``checkpoint_dir`` returns the shared folder named by ``spark.checkpoint.dir``;
only in local mode without one does it pick a fresh scratch folder, elsewhere it
raises an error.  ``stored`` writes rows there once and reads them back.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "tessera",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the session's ``spark.checkpoint.dir`` if set.

    Only when nothing is configured (local runs, tests) is a fresh local
    scratch folder created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def stored(df, name: str):
    """The rows of ``df``, written once to the shared checkpoint folder and read from there: every later
    use sees the same rows, and a lost executor costs no recomputation.

    Columns that files cannot hold as they are come back all the same: names that differ by case only or occur
    twice, intervals (written as text) and void columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    plain = len({c.lower() for c in df.columns}) == len(df.columns) and not {"void", "interval"} & set(kinds)
    flat = df if plain else df.toDF(*[f"c{i}" for i in range(len(kinds))])
    if not plain:
        flat = flat.select(*[F.col(c).cast("string") if k == "interval" else F.col(c) for c, k in zip(flat.columns, kinds) if k != "void"],
                           *([F.lit(0).alias("rows")] if set(kinds) == {"void"} else []))
    flat.write.parquet(path)
    back = spark.read.schema(flat.schema).parquet(path)
    if plain:
        return back
    restored = [F.lit(None) if k == "void" else F.col(f"c{i}").cast("interval") if k == "interval" else F.col(f"c{i}")
                for i, k in enumerate(kinds)]
    return back.select(*[c.alias(f"c{i}") for i, c in enumerate(restored)]).toDF(*df.columns)


def discard(spark: SparkSession, older_than_hours: float = 0.0) -> int:
    """Remove the tables that :func:`stored` left in the shared checkpoint folder, if they were last written more than
    ``older_than_hours`` ago; returns how many.  For the caller, once no DataFrame that reads them is used any more."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("tessera-")
           and s.getModificationTime() <= time.time() * 1000 - older_than_hours * 3_600_000]
    for path in old:
        fs.delete(path, True)
    return len(old)
