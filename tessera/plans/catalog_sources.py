"""Registered queries: sources and sinks and the UDF surface (2.14).

File sources are exercised as round trips: a given table is written in the
format under the shared checkpoint folder, then read back by the source
operator; the oracle is the table itself.
"""

from __future__ import annotations

import sys as _sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import udf as U
from tessera.plans.registry import register
from tessera.sources import io
from tessera.sources.tables import Tables
from tessera.streaming.incremental import scratch_path

# Functions of this module run inside Python workers; pickle them by value so
# executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

_CUST_SQL = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _customer(spark, d):
    return Tables(spark, d).customer


@register("src_csv", _CUST_SQL)
def q_csv(spark, d):
    c = _customer(spark, d)
    path = scratch_path(spark, "csv")
    io.write_file(c, path, "csv", header=True, sep=";", encoding="UTF-8")
    return io.read_csv(spark, path, schema=c.schema, header=True, sep=";")


@register("src_csv_auto_delimiter", _CUST_SQL)
def q_csv_auto(spark, d):
    c = _customer(spark, d)
    path = scratch_path(spark, "csv-pipe")
    io.write_file(c, path, "csv", header=True, sep="|")
    return io.read_csv_auto(spark, path, schema=c.schema, glob="*.csv")


@register("src_json", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_json(spark, d):
    o = Tables(spark, d).orders.drop("o_orderdate")
    path = scratch_path(spark, "json")
    io.write_file(o, path, "json")
    return io.read_json(spark, path, schema=o.schema)


@register("src_geojson", """SELECT c_custkey, c_mktsegment, '{"coordinates":[' ||
  CAST(CAST(c_custkey * 7 % 340 - 170 AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(c_custkey % 170 - 85 AS DOUBLE) AS VARCHAR)
  || '],"type":"Point"}' AS geometry FROM customer""")
def q_geojson(spark, d):
    c = _customer(spark, d)
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("c_custkey"), F.col("c_mktsegment")).alias("properties"),
        F.struct(F.lit("Point").alias("type"),
                 F.array((F.col("c_custkey") * 7 % 340 - 170).cast("double"),
                         (F.col("c_custkey") % 170 - 85).cast("double")).alias("coordinates")).alias("geometry"))
    # FeatureCollection documents of about 1,000 features each.
    groups = max(1, c.count() // 1000)
    docs = (c.groupBy(F.pmod(F.xxhash64("c_custkey"), F.lit(groups)).alias("_doc")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                                    F.collect_list(feature).alias("features"))).alias("value")))
    path = scratch_path(spark, "geojson")
    docs.select("value").write.mode("overwrite").text(path)
    g = io.read_geojson(spark, path, multiline=False)
    # The reader infers the geometry struct with fields in name order.
    return g.select("c_custkey", "c_mktsegment", "geometry")


@register("src_xml", _CUST_SQL)
def q_xml(spark, d):
    c = _customer(spark, d)
    path = scratch_path(spark, "xml")
    c.write.mode("overwrite").format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path)
    return io.read_xml(spark, path, "customer", schema=c.schema)


@register("src_custom_sql", """SELECT o_orderpriority, count(*) AS n FROM orders
  WHERE o_totalprice >= 100000 AND o_orderstatus = 'F' GROUP BY 1""")
def q_custom_sql(spark, d):
    Tables(spark, d).orders.createOrReplaceTempView("tessera_src_orders")
    return io.custom_sql(spark, "SELECT o_orderpriority, count(*) AS n FROM tessera_src_orders "
                                "WHERE o_totalprice >= :min_total AND o_orderstatus = :status GROUP BY 1",
                         {"min_total": 100000, "status": "F"})


@register("src_catalog", _CUST_SQL)
def q_catalog(spark, d):
    spark.sql("DROP TABLE IF EXISTS tessera_customer_copy")
    io.write_table(_customer(spark, d), "tessera_customer_copy", path=scratch_path(spark, "table-copy"))
    return io.read_table(spark, "tessera_customer_copy")


@register("src_object_store_files", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag
  FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def q_object_store(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    path = scratch_path(spark, "files")
    for flag in ["A", "N", "R"]:
        io.write_file(li.filter(F.col("l_returnflag") == flag), f"{path}/flag_{flag}", "csv", header=True)
    schema = "l_orderkey BIGINT, l_linenumber INT, l_returnflag STRING"
    # pick the folders by name: only flags A and R
    a = io.read_files(spark, f"{path}/flag_A", "csv", glob="*.csv", source_col=None, header=True, schema=schema)
    r = io.read_files(spark, f"{path}/flag_R", "csv", glob="*.csv", source_col=None, header=True, schema=schema)
    return a.unionByName(r)


@register("src_wildcard_union", _CUST_SQL.replace(" FROM customer", ", c_mktsegment AS from_folder FROM customer"))
def q_wildcard(spark, d):
    c = _customer(spark, d)
    path = scratch_path(spark, "wild")
    c.write.mode("overwrite").partitionBy("c_mktsegment").option("header", True).csv(path)
    schema = T.StructType([f for f in c.schema.fields if f.name != "c_mktsegment"])
    u = io.wildcard_union(spark, path, "csv", schema=schema)
    seg = F.regexp_extract("source_file", r"c_mktsegment=([^/]+)/", 1)
    return u.select(*schema.names, seg.alias("c_mktsegment"), seg.alias("from_folder"))


@register("src_or_empty", _CUST_SQL)
def q_or_empty(spark, d):
    c = _customer(spark, d)
    missing = io.or_empty(lambda: spark.read.schema(c.schema).parquet(scratch_path(spark, "missing")), c.schema, spark)
    present = io.or_empty(lambda: _customer(spark, d), c.schema, spark)
    return present.unionByName(missing)


@register("src_apply_types", _CUST_SQL)
def q_apply_types(spark, d):
    c = _customer(spark, d)
    text = c.select(*[F.col(f).cast("string").alias(f) for f in c.columns])
    return text.transform(io.apply_types(c.schema))


@register("snk_table", _CUST_SQL)
def q_snk_table(spark, d):
    c = _customer(spark, d)
    schema = T.StructType([T.StructField(f.name, f.dataType, f.name != "c_custkey") for f in c.schema.fields])
    spark.sql("DROP TABLE IF EXISTS tessera_customer_ddl")
    spark.sql(io.create_table_ddl("tessera_customer_ddl", schema, location=scratch_path(spark, "table-ddl")))
    c.write.mode("overwrite").insertInto("tessera_customer_ddl")
    return spark.table("tessera_customer_ddl")


@register("snk_materialise_calcs", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, "
          "round(l_extendedprice * (1 - l_discount), 4) AS revenue, l_quantity > 25 AS big FROM lineitem")
def q_materialise(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return io.materialise_calcs(li, {"revenue": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4),
                                     "big": F.col("l_quantity") > 25}, scratch_path(spark, "materialised")
                                ).drop("l_extendedprice", "l_discount")


@register("snk_file", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_snk_file(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "out-parquet")
    io.write_file(o, path, "parquet")
    return spark.read.parquet(path)


# ------------------------------------------------------------------ UDF surface (2.14)

def _revenue(price: pd.Series, disc: pd.Series) -> pd.Series:
    return (price * (1 - disc)).round(4)


@register("udf_script_scalar", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
          "round(l_extendedprice * (1 - l_discount), 4) AS revenue, l_quantity > 25 AS big FROM lineitem")
def q_script_scalar(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     U.script("real", _revenue, "l_extendedprice", "l_discount").alias("revenue"),
                     U.script("bool", lambda q: q > 25, "l_quantity").alias("big"))


def _price_band(pdf: pd.DataFrame) -> pd.DataFrame:
    band = np.where(pdf["o_totalprice"] >= 300000, "large", np.where(pdf["o_totalprice"] >= 100000, "medium", "small"))
    return pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "band": band,
                         "price_k": (pdf["o_totalprice"] // 1000).astype("int64")})


@register("udf_script_table", """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large'
  WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS band, CAST(floor(o_totalprice / 1000) AS BIGINT)
  AS price_k FROM orders""")
def q_script_table(spark, d):
    # A table script over Arrow batches of each partition (mapInPandas): no
    # grouping, so no key can concentrate rows in one Python worker.
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    return o.transform(U.script_table(_price_band, "o_orderkey long, band string, price_k long"))


@register("udf_predict", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(s.b + s.a * l_quantity, 4)
  AS predicted FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS a,
  regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) s""")
def q_predict(spark, d):
    li = Tables(spark, d).lineitem
    # Fit in Spark (two numbers), score with a model object built once per task.
    a, b = li.agg(F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")).first()

    def factory():
        return lambda X: (b + a * X["l_quantity"]).round(4)
    return li.select("l_orderkey", "l_linenumber", U.predict(factory, ["l_quantity"]).alias("predicted"))


@register("op_cache_boundary", """SELECT c_custkey, count(o_orderkey) AS orders FROM customer
  LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def q_cache_boundary(spark, d):
    t = Tables(spark, d)
    cust = U.cache_boundary(t.customer.select("c_custkey"), mode="checkpoint")
    return cust.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("orders"))
