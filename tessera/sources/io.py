"""Sources and sinks.

Readers take an explicit schema where one is known (no inference pass over
the data); file readers split by ``spark.sql.files.maxPartitionBytes``;
relational reads are partitioned on a numeric column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.logic import to_integer

# Delimiters tried by the CSV delimiter detector, in order.
CANDIDATE_DELIMITERS = [",", ";", "\t", "|"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
             sep: str = ",", encoding: str = "UTF-8", glob: str | None = None, **options) -> DataFrame:
    r = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    if glob:
        r = r.option("pathGlobFilter", glob)
    for k, v in options.items():
        r = r.option(k, v)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", False).csv(path)


def detect_delimiter(spark: SparkSession, path: str, glob: str | None = None) -> str:
    """Pick the delimiter from the header line: the candidate that occurs most
    (ties: the earlier candidate).  Reads one line."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    first = r.text(path).limit(1).collect()
    if not first:
        return ","
    line = first[0][0] or ""
    counts = [(line.count(d), -i, d) for i, d in enumerate(CANDIDATE_DELIMITERS)]
    best = max(counts)
    return best[2] if best[0] > 0 else ","


def read_csv_auto(spark: SparkSession, path: str, schema=None, header: bool = True, glob: str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, header, detect_delimiter(spark, path, glob), glob=glob)


def read_json(spark: SparkSession, path: str, schema=None, multiline: bool = False) -> DataFrame:
    """JSON records: one per line, or (``multiline``) files holding one record or an
    array of records — each array element becomes a row."""
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_geojson(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """GeoJSON FeatureCollections: one row per feature, the properties as columns and
    the geometry kept as JSON text.  ``multiline=True`` reads one (pretty-printed)
    document per file; ``False`` reads one document per line."""
    raw = spark.read.option("multiLine", multiline).json(path)
    feats = raw.select(F.explode("features").alias("f"))
    return feats.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema is not None else r).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None,
              fetch_size: int = 10_000) -> DataFrame:
    """Relational read (any JDBC driver on the classpath).  With a partition
    column the read is split into ``num_partitions`` range queries that run in
    parallel; filters and projections are pushed into the SQL sent."""
    props = dict(properties or {})
    props.setdefault("fetchsize", str(fetch_size))
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                               upperBound=upper_bound, numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def custom_sql(spark: SparkSession, query: str, args: Mapping | None = None) -> DataFrame:
    """Native SQL with bound named parameters (``:name``), never string-spliced."""
    return spark.sql(query, args=dict(args or {}))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table (Hive / Spark catalog / lakehouse)."""
    return spark.table(name)


def read_files(spark: SparkSession, folder: str, fmt: str = "csv", glob: str = "*", recursive: bool = True,
               source_col: str | None = "source_file", schema=None, **options) -> DataFrame:
    """Every file of a folder whose name matches ``glob`` (object stores too),
    optionally recording the file each row came from."""
    r = spark.read.format(fmt).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    if schema is not None:
        r = r.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    df = r.load(folder)
    if source_col:
        df = df.withColumn(source_col, F.col("_metadata.file_path"))
    return df


def wildcard_union(spark: SparkSession, folder: str, ext: str = "csv", sep: str = ",", schema=None,
                   header: bool = True) -> DataFrame:
    """All ``*.ext`` files of a folder as one table plus the source file path."""
    opts = {"header": header, "sep": sep}
    if schema is not None:
        r = spark.read.schema(schema)
    else:
        r = spark.read
    df = r.options(**opts).option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", True) \
        .format(ext).load(folder)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def or_empty(read: Callable[[], DataFrame], schema: T.StructType, spark: SparkSession) -> DataFrame:
    """The source, or an empty table with the schema when the source is missing."""
    try:
        df = read()
        df.schema  # resolve now: a missing path fails here
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def apply_types(schema: T.StructType) -> Callable[[DataFrame], DataFrame]:
    """Cast every column to the declared type; values that do not convert become null."""
    def step(df: DataFrame) -> DataFrame:
        out = []
        for f in schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
                c = to_integer(c, f.dataType.simpleString())
            else:
                c = c.try_cast(f.dataType)
            out.append(c.alias(f.name))
        return df.select(*out)
    return step


# ----------------------------------------------------------------- sinks

def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Overwrite a catalog table; with ``path`` it is an external table stored there."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def create_table_ddl(name: str, schema: T.StructType, fmt: str = "parquet", location: str | None = None) -> str:
    """CREATE TABLE text with types and NOT NULL for non-nullable fields."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}"
                     for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING {fmt}{loc}"


def materialise_calcs(df: DataFrame, calcs: Mapping, path: str, fmt: str = "parquet") -> DataFrame:
    """Add calculated columns and rewrite the table to ``path``."""
    out = df.withColumns(dict(calcs))
    out.write.mode("overwrite").format(fmt).option("overwriteSchema", "true").save(path)
    return df.sparkSession.read.format(fmt).load(path)


def write_file(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", **options) -> None:
    w = df.write.mode(mode).format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)
