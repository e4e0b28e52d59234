"""Tables in the shared checkpoint folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored as materialise  # noqa: F401  write once, read back


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column, measured (size estimates of plans can be far off)."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("bigint")).alias("n")).first()["n"] or 0
