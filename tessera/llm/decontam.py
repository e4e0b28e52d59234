"""Benchmark decontamination by size-partitioned MinHash containment search.

Method: the test items are partitioned by their number of shingles (powers of
two).  For a partition with at most ``u`` shingles an item, documents are cut
into windows of ``2u`` shingles that start every ``u``, so every run of ``u``
shingles lies whole in one window and a long document is never compared as one
huge set.  Items and windows get MinHash values; a window and an item that
share one of them are a candidate (bands of one row: at containment 0.8 the
Jaccard similarity of item and window is at least 0.19, so 32 bands miss one in
800 at worst, and a whole item far less).  Every candidate is verified against
the whole document: the share of the item's shingles that the document has.

Window values are minima over blocks, and those of a larger partition minima
over the blocks of a smaller one, so each shingle is hashed once per band.

Documents are only scanned: no shuffle.  The index of the test items is
broadcast in blocks of at most ``BLOCK_ITEMS`` items, one pass each, so its
size is bounded whatever the benchmark's.

Shingles are five words; words are runs of letters and digits, A-Z
lower-cased.  Rows: a null text counts as empty; an item or document with
fewer than five words has no shingle and never matches.  Repeated documents
are searched one by one, repeated items (same id and text) count once, and an
empty table gives no pairs.  ``leaks`` replaces an input column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import materialise
from tessera.llm.textops import chunks, lower_table, non_alnum_table, permutation_constants, shingles, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
BLOCK_ITEMS = 20_000
FILTER_BITS = 16


def text_shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, per_row = word_hashes(data, offs, non_alnum_table(), lower_table())
    return shingles(words, per_row, SHINGLE)


def build_index(texts: pa.Array) -> dict:
    """Shingle sets of the items and, by size partition, their MinHash values."""
    a, b = permutation_constants(BANDS, 11)
    sets: list[np.ndarray] = []
    for _, _, data, offs in chunks(texts):
        h, counts = text_shingles(data, offs)
        sets += [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]
    parts: dict[int, dict] = {}
    for i, s in enumerate(sets):
        if len(s):
            part = parts.setdefault(int(len(s)).bit_length(), {"keys": [{} for _ in range(BANDS)]})
            for p in range(BANDS):
                part["keys"][p].setdefault(int((s * a[p] + b[p]).min()), []).append(i)
    for part in parts.values():
        seen = np.zeros((BANDS, 1 << FILTER_BITS), bool)
        for p, keys in enumerate(part["keys"]):
            seen[p, np.array([k & ((1 << FILTER_BITS) - 1) for k in keys], np.int64)] = True
        part["seen"] = seen
    return {"sets": sets, "parts": parts}


def _halve(mins: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima over pairs of neighbouring blocks of a row."""
    out = (per_row + 1) // 2
    first = np.repeat(np.cumsum(per_row) - per_row, out)
    at = np.arange(len(first)) - np.repeat(np.cumsum(out) - out, out)
    return (np.minimum.reduceat(mins, first + 2 * at, axis=0) if len(first) else mins), out


def _candidates(h: np.ndarray, counts: np.ndarray, parts: dict, a: np.ndarray, b: np.ndarray) -> set[tuple[int, int]]:
    """(row, item) pairs of which a window and the item share a MinHash value."""
    found: set[tuple[int, int]] = set()
    if not len(h) or not parts:
        return found
    bits = min(parts)
    per_row = (counts + (1 << bits) - 1) >> bits
    first = np.repeat(np.cumsum(counts) - counts, per_row)
    starts = first + ((np.arange(len(first)) - np.repeat(np.cumsum(per_row) - per_row, per_row)) << bits)
    mins = np.empty((len(starts), BANDS), np.uint64)
    for p in range(BANDS):
        mins[:, p] = np.minimum.reduceat(h * a[p] + b[p], starts)
    while True:
        if bits in parts:
            row = np.repeat(np.arange(len(per_row)), per_row)
            windows = mins.copy()
            same = np.flatnonzero(row[:-1] == row[1:])
            windows[same] = np.minimum(mins[same], mins[same + 1])
            low = (windows & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            hit = parts[bits]["seen"][np.arange(BANDS)[None, :], low]
            for w, p in zip(*np.nonzero(hit)):
                for item in parts[bits]["keys"][p].get(int(windows[w, p]), ()):
                    found.add((int(row[w]), item))
        if bits >= max(parts):
            return found
        mins, per_row = _halve(mins, per_row)
        bits += 1


def _search(col: pa.Array, index: dict) -> Iterator[tuple[int, int, list[list[tuple[int, int, int]]]]]:
    """For runs of rows: the items of every row as (item, its shingles, shared shingles)."""
    a, b = permutation_constants(BANDS, 11)
    for first, rows, data, offs in chunks(col):
        h, counts = text_shingles(data, offs)
        at = np.concatenate([[0], np.cumsum(counts)])
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
        sorted_row, sorted_set = -1, None
        for row, item in sorted(_candidates(h, counts, index["parts"], a, b)):
            if row != sorted_row:
                sorted_row, sorted_set = row, np.unique(h[at[row]:at[row + 1]])
            s = index["sets"][item]
            place = np.minimum(np.searchsorted(sorted_set, s), len(sorted_set) - 1)
            shared = int((sorted_set[place] == s).sum())
            if shared >= THRESHOLD * len(s):
                out[row].append((item, len(s), shared))
        yield first, rows, out


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         keep: list[str] | None = None) -> DataFrame:
    """Add ``leaks``: an array of (item_id, n_item, n_shared) of the items that a document holds.

    ``keep`` names the columns to return besides ``leaks`` (all by default).
    """
    spark = docs.sparkSession
    kept = [c for c in (keep if keep is not None else docs.columns) if c != "leaks"]
    items = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).dropDuplicates()
    id_type = items.schema["i"].dataType
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    leak = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("n_item", T.LongType()),
                                     T.StructField("n_shared", T.LongType())]))
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "leaks"]).withColumn("leaks", F.array().cast(leak))
    for k in range(blocks):
        one = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").toArrow().combine_chunks()
        texts = one["t"].combine_chunks() if one.num_rows else pa.array([], pa.string())
        names = one["i"].to_pylist()
        index = spark.sparkContext.broadcast((build_index(texts), names))
        columns = [c for c in out.columns if c in kept or c == text or c == "leaks"] if k < blocks - 1 else [*kept, "leaks"]
        schema = T.StructType([out.schema[c] for c in columns])

        def run(batches: Iterator[pa.RecordBatch], index=index, columns=columns) -> Iterator[pa.RecordBatch]:
            built, ids = index.value
            for batch in batches:
                col = batch.column(batch.schema.names.index(text))
                before = batch.column(batch.schema.names.index("leaks"))
                for first, rows, found in _search(col, built):
                    old = before.slice(first, rows)
                    if any(found):
                        old = pa.array([(o or []) + [{"item_id": ids[i], "n_item": n, "n_shared": m} for i, n, m in f]
                                        for o, f in zip(old.to_pylist(), found)], before.type)
                    part = batch.slice(first, rows)
                    yield pa.RecordBatch.from_arrays(
                        [old if c == "leaks" else part.column(batch.schema.names.index(c)) for c in columns], names=columns)

        out = out.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text, "leaks"])]).mapInArrow(run, schema)
        if k < blocks - 1:
            # Written before the next block: one index and one Python worker at a time.
            out = materialise(out, "marked")
            index.unpersist()
    return out


def search(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: ids, shingles of the item, those shared, containment."""
    marked = mark(docs, benchmark, text, item, item_text, keep=[doc])
    return marked.select(F.col(doc), F.explode("leaks").alias("x")).select(
        F.col(doc), F.col("x.item_id").alias(item), F.col("x.n_item").alias("n_item"), F.col("x.n_shared").alias("n_shared"),
        (F.col("x.n_shared") / F.col("x.n_item")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents that hold no item."""
    return mark(docs, benchmark, **names).where(F.size("leaks") == 0).drop("leaks")
