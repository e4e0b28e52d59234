"""UDF surface: script functions, table scripts, model scoring, cache boundaries.

Python runs only where the user brings Python: vectorised through Arrow
(``pandas_udf``, ``mapInPandas``, ``applyInPandas``), never row by row.
"""

from __future__ import annotations

import sys as _sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions of this module run inside Python workers; pickle them by value so
# executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

# SCRIPT_* result types.
SCRIPT_TYPES = {"bool": "boolean", "int": "bigint", "real": "double", "str": "string"}


def script(kind: str, fn: Callable[..., pd.Series], *cols) -> Column:
    """SCRIPT_BOOL / _INT / _REAL / _STR: a vectorised Python function of
    pandas Series returning a Series of the declared type."""
    udf = F.pandas_udf(fn, SCRIPT_TYPES[kind])
    return udf(*[F.col(c) if isinstance(c, str) else c for c in cols])


def script_table(fn: Callable[[pd.DataFrame], pd.DataFrame], schema, by: Sequence[str] | None = None):
    """Table script step: per partition batch (``mapInPandas``) or per group
    (``groupBy(by).applyInPandas``) with a declared output schema."""
    def step(df: DataFrame) -> DataFrame:
        if by:
            return df.groupBy(*by).applyInPandas(fn, schema)

        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield fn(pdf)
        return df.mapInPandas(batches, schema)
    return step


def predict(model_factory: Callable[[], Callable[[pd.DataFrame], pd.Series]], features: Sequence[str],
            return_type: str = "double") -> Column:
    """Model scoring: the model is built once per task (iterator pandas UDF)
    and applied to Arrow batches of the feature columns."""
    names = list(features)

    @F.pandas_udf(return_type)
    def score(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = model_factory()
        for batch in it:
            cols = batch if isinstance(batch, tuple) else (batch,)
            yield model(pd.DataFrame(dict(zip(names, cols))))

    return score(*[F.col(c) for c in names])


def cache_boundary(df: DataFrame, mode: str = "persist") -> DataFrame:
    """Materialise before reuse: ``persist`` (memory and disk, recomputed from
    lineage if an executor is lost) or ``checkpoint`` (written to the shared
    ``spark.checkpoint.dir``, lineage cut)."""
    if mode == "checkpoint":
        from tessera.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
