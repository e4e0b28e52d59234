"""Registered queries: one per operator id, each with an optional DuckDB oracle.

``@register("id", sql)`` records a ``(spark, sf_dir) -> DataFrame`` callable.
Results pass through ``canon``: integral columns become BIGINT and floating
columns DOUBLE, so the Spark and SQL schemas compare by family.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def canon(df: DataFrame) -> DataFrame:
    out = []
    changed = False
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
            changed = True
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
            changed = True
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out) if changed else df


def ensure_utc(spark: SparkSession) -> None:
    """Date semantics are wall-clock: the library runs with a UTC session time
    zone (streaming windows and NTZ -> TIMESTAMP casts depend on it)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(qid: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if qid in REGISTRY:
            raise ValueError(f"duplicate query id {qid}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return canon(fn(spark, sf_dir))
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        REGISTRY[qid] = (wrapped, sql)
        return fn
    return deco


def _load_all() -> None:
    # Importing the catalogue modules fills REGISTRY.
    from tessera.plans import (  # noqa: F401
        flagship, catalog_sources, catalog_prep, catalog_joins, catalog_functions,
        catalog_aggregates, catalog_lod, catalog_tablecalc, catalog_semantic,
        catalog_analytics, catalog_streaming,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


# SQL snippets shared by oracles (DuckDB has no initcap).
def sql_initcap(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({expr}), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")
