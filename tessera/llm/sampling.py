"""Folds, and the bounded labelled sample that the classifiers are fitted on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labelled(labels: DataFrame, label: str, folds: int = 3, held_out: int = 1, doc: str = "doc_id") -> DataFrame:
    """(k, y): the label of every id outside the held-out fold; null ids and labels are left out."""
    return (labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & (fold(F.col(doc), folds) != held_out))
            .groupBy(F.col(doc).alias("k")).agg(F.max(label).cast("int").alias("y")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int,
                    folds: int = 3, held_out: int = 1, doc: str = "doc_id", text: str = "text", extra: list[str] = ()) -> pa.Table:
    """At most ``per_class`` rows for each label value outside the held-out fold, as (text, label, *extra).

    Rows are taken in the order of a hash of the id, so the choice is the same
    in every run; texts over ``max_bytes`` bytes are not learnt from.  Exact
    copies of a text are learnt once.  Null ids, labels and texts are left out.
    Both sides of the join are bounded: the ids by ``per_class``, the result
    by ``2 * per_class * max_bytes``.
    """
    known = labelled(labels, label, folds, held_out, doc)
    picks = None
    for value in (0, 1):
        one = known.where(F.col("y") == value).orderBy(F.xxhash64("k"), "k").limit(per_class)
        picks = one if picks is None else picks.unionByName(one)
    short = docs.where(F.octet_length(F.col(text)) <= max_bytes).select(F.col(doc).alias("k"), F.col(text).alias("t"), *extra)
    found = short.join(F.broadcast(picks), "k").groupBy("t").agg(
        F.max("y").alias("y"), *[F.max(e).alias(e) for e in extra])
    return found.orderBy(F.xxhash64("t"), "t").toArrow()
