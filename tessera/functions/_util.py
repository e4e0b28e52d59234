from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    """Column from a name or a Column."""
    return x if isinstance(x, Column) else F.col(x)


def lit_or_col(x) -> Column:
    """Column as is; anything else becomes a literal (strings too)."""
    return x if isinstance(x, Column) else F.lit(x)
