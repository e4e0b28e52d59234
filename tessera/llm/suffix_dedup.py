"""Removal of repeated passages over sparse suffix orders.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts
anywhere else in the corpus.

Method: a window of ``LENGTH`` bytes has an anchor, the start of its smallest
hashed ``GRAM``-byte string; equal windows have equal anchors at the same
place.  Only suffixes at anchors are kept (about one in fifty), with their
context: the bytes before (to the left end of any window of the anchor) and
after.  Anchors whose string occurs once are dropped.  If all occurrences of an
anchor share one context, the whole context repeats.  Else the contexts of the
anchor are put in suffix order, to the right and, reversed, to the left, by
deep-shallow sorting: multikey quicksort up to a shallow depth, then a blind
trie for every group that still shares a prefix.  The common prefixes of
neighbours give the longest common stretch of two contexts and so the repeated
bytes, without looking at all pairs of a large group.

Hot anchors: occurrences are counted with map-side partial sums, the blocks of
the hottest anchors found by a broadcast of bounded size, and an anchor with more than
``MAX_GROUP`` contexts is divided by longer strings (``GRID``), at last by whole
windows, which need only be counted.

Rows: a null text counts as empty; texts under ``LENGTH`` bytes stay whole.
Repeated rows are repeats of each other.  An empty table gives no rows.
``spans`` and ``kept`` replace input columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import materialise, text_bytes
from tessera.llm.textops import chunks, mix, prefix_hash, span_hash

LENGTH = 200
GRAM = 96
REACH = LENGTH - GRAM  # bytes before an anchor that its windows can reach
SHALLOW = 24
SMALL_GROUP = 24
MAX_GROUP = 50_000
GRID = 34
BLOCK_BYTES = 16 << 20
HOT_LEAST, HOT_SHARE = 1000, 10_000
CUT_BYTES = 1 << 21  # texts cut at a time


# Deep-shallow sorting.

def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Patricia trie over strings: inner nodes know only a depth and the branching bytes."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent to some leaf
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[0]]
        lcp = common_prefix(s, other)
        if lcp == len(s) == len(other):
            node.append(i)
            return
        parent, branch, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            parent, branch = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][branch]
        mine = s[lcp] if lcp < len(s) else -1
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][mine] = [i]
            return
        fork = (lcp, {(other[lcp] if lcp < len(other) else -1): node, mine: [i]})
        if parent is None:
            self.root = fork
        else:
            parent[1][branch] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out += node
        return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices in the order of the strings: multikey quicksort by single bytes up to the shallow
    depth, then a blind trie for each group with a longer common prefix."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            out += trie.order()
            continue
        key = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = sorted(key[:: max(1, len(key) // 3)])[len(key[:: max(1, len(key) // 3)]) // 2]
        low = [i for i, c in zip(group, key) if c < pivot]
        same = [i for i, c in zip(group, key) if c == pivot]
        high = [i for i, c in zip(group, key) if c > pivot]
        if high:
            stack.append((high, depth))
        if pivot < 0:
            stack.extend(([i], depth) for i in reversed(same))  # ended strings are equal
        else:
            stack.append((same, depth + 1))
        if low:
            stack.append((low, depth))
    return out


def neighbour_prefixes(strings: list[bytes], order: list[int]) -> list[int]:
    """Common prefix of each string in the order with the one before (the first: 0)."""
    return [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def shared_stretches(left: list[bytes], right: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """For each context, the bytes before and after its anchor that lie in a string of ``length``
    bytes shared with another context of the group, or (0, 0).  ``left`` is reversed."""
    n = len(left)
    best = [[-1, -1] for _ in range(n)]
    ro, lo = deep_shallow_order(right), deep_shallow_order(left)
    rp, lp = neighbour_prefixes(right, ro), neighbour_prefixes(left, lo)
    if n <= SMALL_GROUP:
        before = {}
        for x in range(n):
            run = 1 << 30
            for y in range(x + 1, n):
                run = min(run, lp[y])
                before[(lo[x], lo[y]) if lo[x] < lo[y] else (lo[y], lo[x])] = run
        for x in range(n):
            run = 1 << 30
            for y in range(x + 1, n):
                run = min(run, rp[y])
                i, j = ro[x], ro[y]
                b = before[(i, j) if i < j else (j, i)]
                if b + run >= length:
                    for k in (i, j):
                        best[k][0] = max(best[k][0], b)
                        best[k][1] = max(best[k][1], run)
    else:
        # Runs of the orders at each depth: two contexts share [-a, length - a) if they are in one
        # run to the left at depth a and in one run to the right at depth length - a.
        rrank, lrank = np.empty(n, np.int64), np.empty(n, np.int64)
        rrank[ro], lrank[lo] = np.arange(n), np.arange(n)
        rp, lp = np.array(rp), np.array(lp)
        top = np.full((n, 2), -1)
        llen, rlen = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        for a in range(0, REACH + 1):
            key = np.cumsum(lp < a)[lrank] * n + np.cumsum(rp < length - a)[rrank]
            key = np.where((llen >= a) & (rlen >= length - a), key, -1 - np.arange(n))
            _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
            hit = cnt[inv] > 1
            top[hit, 0] = a
            top[hit & (top[:, 1] < 0), 1] = length - a
        best = top.tolist()
    return [(max(a, 0), max(b, 0)) for a, b in best]


# Anchors.

def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i + width] for every i that has so many elements."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


def anchors(data: np.ndarray, offs: np.ndarray):
    """(row, place in data, key, context hash, bytes before, bytes after) of all anchors."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix = prefix_hash(data)
    m = n - GRAM + 1
    start = np.arange(m)
    h = span_hash(prefix, start, start + GRAM) | np.uint64(1)
    del start
    ends = offs[1:]
    sizes = np.diff(offs)
    # A string that reaches over the end of its row is never the smallest; a window that does is none.
    over = np.zeros(n + 1, np.int8)
    np.add.at(over, np.maximum(ends - GRAM + 1, offs[:-1]), 1)
    np.add.at(over, ends, -1)
    h[np.cumsum(over[:m]) > 0] = np.uint64((1 << 64) - 1)
    low = _slide(h, REACH + 1, np.minimum)  # one for each window start
    bad = np.zeros(n + 1, np.int8)
    np.add.at(bad, np.maximum(ends - LENGTH + 1, offs[:-1]), 1)
    np.add.at(bad, ends, -1)
    low[np.cumsum(bad[:len(low)]) > 0] = 0
    pad = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), REACH + 1, np.maximum) == h)
    row = np.searchsorted(ends, at, side="right")
    rel = at - offs[row]
    left = np.minimum(rel, REACH)
    right = np.minimum(LENGTH, sizes[row] - rel)
    ctx = mix(span_hash(prefix, at - left, at + right) + (left * 1024 + right).astype(np.uint64))
    return row, at, h[at], ctx, left, right


def _keyed(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    k = F.unhex(F.md5(t.cast("binary")))
    return docs.select(t.alias("text"), k.alias("k")).withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))


def _anchor_rows(keyed: DataFrame) -> DataFrame:
    """(block, akey, ctx) of all anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            parts = [(blocks[first + row], key, ctx) for first, _, data, offs in chunks(batch.column("text"))
                     for row, _, key, ctx, _, _ in [anchors(data, offs)]]
            if parts:
                block, key, ctx = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))],
                                                 names=["block", "akey", "ctx"])

    return keyed.select("text", "block").mapInArrow(run, "block int, akey bigint, ctx bigint")


def _repeated_by_block(rows: DataFrame) -> DataFrame:
    """(block, akey, uniform), each once, of the anchors that occur at least twice; uniform: all contexts are equal.

    Anchors with over 1 / ``HOT_SHARE`` of all rows are fewer than ``HOT_SHARE``, so they are broadcast and their rows
    reduced to one a block within each task; the others are joined by a shuffle.
    """
    counted = materialise(
        rows.groupBy("akey").agg(F.count("*").alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b"))
        .where("n > 1").select("akey", "n", (F.col("a") == F.col("b")).alias("uniform")), "repeated")
    hot = counted.where(F.col("n") > max(HOT_LEAST, rows.count() // HOT_SHARE)).select("akey", "uniform")
    marked = rows.select("block", "akey").join(F.broadcast(hot), "akey", "left")
    cold = marked.where("uniform IS NULL").select("block", "akey").join(counted.select("akey", "uniform"), "akey")
    return cold.unionByName(marked.where("uniform IS NOT NULL")).distinct()


def _twice_per_task(keyed: DataFrame) -> DataFrame:
    """Drop the third and further copies of a text within a task: a hot group of copies is small before
    the shuffle, and still seen to be more than one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            few = []
            for k in batch.column("k").to_pylist():
                seen[k] = n = min(seen.get(k, 0) + 1, 3)
                few.append(n < 3)
            yield batch.filter(pa.array(few, pa.bool_()))

    return keyed.mapInArrow(run, keyed.schema)


FOUND = "k binary, s bigint, e bigint, gkey bigint, ctx bigint, lft binary, rgt binary"
FOUND_ARROW = pa.schema([("k", pa.binary()), ("s", pa.int64()), ("e", pa.int64()), ("gkey", pa.int64()), ("ctx", pa.int64()),
                         ("lft", pa.binary()), ("rgt", pa.binary())])


def _merge(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each row."""
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    if not len(row):
        return row, s, e
    shift = row * (1 << 40)
    top = np.maximum.accumulate(e + shift)
    new = np.ones(len(row), bool)
    new[1:] = s[1:] + shift[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], s[first], top[last] - shift[first]


def _local_finds(texts: pa.Table, repeated: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of ``FOUND`` for one block: spans of uniform anchors (no gkey), and contexts of the others."""
    first_of: dict[bytes, int] = {}
    copied: set[bytes] = set()
    for i, k in enumerate(texts["k"].to_pylist()):
        if first_of.setdefault(k, i) != i:
            copied.add(k)
    keys = list(first_of)
    texts = texts.take(pa.array(list(first_of.values()), pa.int64()))
    rk = repeated["akey"].to_numpy().view(np.uint64)
    order = np.argsort(rk)
    rk, uniform = rk[order], repeated["uniform"].to_numpy()[order]
    for first, _, data, offs in chunks(texts["text"]):
        row, at, key, ctx, left, right = anchors(data, offs)
        if len(rk):
            place = np.minimum(np.searchsorted(rk, key), len(rk) - 1)
            hit = (rk[place] == key) & (left + right >= LENGTH)
        else:
            place = hit = np.zeros(len(key), bool)
        row, at, key, ctx, left, right, same = row[hit], at[hit], key[hit], ctx[hit], left[hit], right[hit], uniform[place[hit]]
        rel = at - offs[row]
        r, s, e = _merge(row[same], (rel - left)[same], (rel + right)[same])
        whole = [i for i, n in enumerate(np.diff(offs).tolist()) if n >= LENGTH and keys[first + i] in copied]  # repeated by its copies
        k = [keys[first + x] for x in r] + [keys[first + i] for i in whole]
        s, e = s.tolist() + [0] * len(whole), e.tolist() + np.diff(offs)[whole].tolist()
        none = [None] * len(k)
        buf = data.tobytes()
        x = np.flatnonzero(~same)
        k += [keys[first + i] for i in row[x]]
        s += (rel - left)[x].tolist()
        e += (rel + right)[x].tolist()
        lft = [buf[p - n:p][::-1] for p, n in zip(at[x].tolist(), left[x].tolist())]
        rgt = [buf[p:p + n] for p, n in zip(at[x].tolist(), right[x].tolist())]
        yield pa.RecordBatch.from_arrays([
            pa.array(k, pa.binary()), pa.array(s, pa.int64()), pa.array(e, pa.int64()),
            pa.array(none + key[x].view(np.int64).tolist(), pa.int64()), pa.array(none + ctx[x].view(np.int64).tolist(), pa.int64()),
            pa.array(none + lft, pa.binary()), pa.array(none + rgt, pa.binary())], schema=FOUND_ARROW)


def _compare(rows: DataFrame) -> DataFrame:
    """Different contexts (gkey, k, s, lft, rgt) that meet in groups to spans (k, s, e)."""
    def group_spans(ks, starts, left, right):
        for i, (a, b) in enumerate(shared_stretches(left, right)):
            if a + b >= LENGTH:
                at = starts[i] + len(left[i])
                yield ks[i], at - a, at + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        out: list[tuple[bytes, int, int]] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()),
                                               pa.array([x[2] for x in out], pa.int64())], names=["k", "s", "e"])

        def cut(t: pa.Table, last: bool):
            g = t["gkey"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            stop = len(edges) - 1 if last else len(edges) - 2
            cols = [t[c].to_pylist() for c in ("k", "s", "lft", "rgt")]
            for a, b in zip(edges[:stop], edges[1:stop + 1]):
                if b - a > 1:
                    out.extend(group_spans(*[c[a:b] for c in cols]))
            return t.slice(int(edges[stop])).combine_chunks()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None or not rest.num_rows else pa.concat_tables([rest, t])
            rest = cut(rest, False)
            if len(out) >= 8192:
                yield flush()
                out.clear()
        if rest is not None and rest.num_rows:
            cut(rest, True)
        yield flush()

    return (rows.select("gkey", "k", "s", "lft", "rgt").repartition("gkey").sortWithinPartitions("gkey")
            .mapInArrow(run, "k binary, s bigint, e bigint"))


def _divide(rows: DataFrame, starts, step: int) -> DataFrame:
    """Deal the contexts of large groups to smaller ones: a shared window that starts ``a`` bytes before
    the anchor also shares the bytes from ``g`` before it to ``LENGTH - g - step + 1`` after, where g is a
    rounded down to the step.  With step 1 these are whole windows."""
    size = LENGTH - step + 1
    out = rows.withColumn("g", F.explode(F.filter(starts, lambda g: (g <= REACH) & (F.length("lft") >= g) & (
        F.length("rgt") >= F.lit(size) - g))))
    part = F.concat(F.hex("lft").substr(F.lit(1), 2 * F.col("g")), F.hex("rgt").substr(F.lit(1), 2 * (F.lit(size) - F.col("g"))))
    return out.withColumn("gkey", F.xxhash64("gkey", "g", part))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k, spans): for each distinct text with repeated bytes, by its 16-byte key, the maximal runs to remove."""
    spark = docs.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text) // BLOCK_BYTES))
    keyed = _keyed(docs, text, blocks)
    rows = materialise(_anchor_rows(keyed), "anchors")
    here = _repeated_by_block(rows)
    found = materialise(_twice_per_task(keyed).groupBy("block").cogroup(here.groupBy("block")).applyInArrow(
        lambda texts, anchors: pa.Table.from_batches(_local_finds(texts, anchors), FOUND_ARROW), FOUND), "found")
    spans = found.where("gkey IS NULL").select("k", "s", "e")
    # A context that occurs twice repeats as a whole; each context that occurs once is compared with one row of every other.
    mixed = found.where("gkey IS NOT NULL")
    classes = materialise(mixed.groupBy("gkey", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k", "s")).alias("one")), "contexts")
    twice = classes.where("n > 1").select("gkey", "ctx")
    spans = spans.unionByName(mixed.select("gkey", "ctx", "k", "s", "e").join(twice, ["gkey", "ctx"]).select("k", "s", "e"))
    sizes = classes.groupBy("gkey").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 AND least = 1")
    chosen = classes.join(sizes, "gkey").select("gkey", "ctx", "d", F.col("one.k").alias("k"), F.col("one.s").alias("s"))
    rows = mixed.select("gkey", "ctx", "k", "s", "lft", "rgt").join(chosen, ["gkey", "ctx", "k", "s"])
    spans = spans.unionByName(materialise(_compare(rows.where(F.col("d") <= MAX_GROUP)), "spans"))
    if sizes.where(F.col("d") > MAX_GROUP).limit(1).count():
        parts = _divide(rows.where(F.col("d") > MAX_GROUP).drop("d"), F.array(*[F.lit(g) for g in range(0, REACH + 1, GRID)]), GRID)
        counts = parts.groupBy("gkey").agg(F.count("*").alias("d")).where("d > 1")
        parts = materialise(parts.join(counts, "gkey"), "parts")
        spans = spans.unionByName(materialise(_compare(parts.where(F.col("d") <= MAX_GROUP)), "spans"))
        # Windows of what is still large: only to be counted.
        windows = _divide(parts.where(F.col("d") > MAX_GROUP).drop("d").withColumnRenamed("g", "g0"),
                          F.sequence(F.col("g0"), F.col("g0") + GRID - 1), 1)
        equal = windows.groupBy("gkey").agg(F.count("*").alias("n")).where("n > 1").select("gkey")
        at = F.col("s") + F.length("lft") - F.col("g")
        spans = spans.unionByName(windows.join(equal, "gkey").select("k", at.alias("s"), (at + LENGTH).alias("e")))
    return _union_spans(spans)


def _union_spans(spans: DataFrame) -> DataFrame:
    """Maximal runs of each key, as an array of (s, e)."""
    w = Window.partitionBy("k").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.distinct().withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """The columns by number (``c0``, ``c1``, ...), the text as ``t`` and its ``spans``."""
    spans = repeated_spans(docs, text).withColumnRenamed("k", "key")
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{text}`").alias("t"),
                        F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).alias("key"))
    return keyed.join(spans, "key", "left").drop("key")


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of about ``CUT_BYTES``, and what is left of their texts."""
    for first, rows, data, offs in chunks(batch.column(batch.num_columns - 2), CUT_BYTES):
        part = batch.slice(first, rows)
        kept = []
        for r, cuts in enumerate(part.column(batch.num_columns - 1).to_pylist()):
            b = data[offs[r]:offs[r + 1]]
            if cuts:
                keep = np.ones(len(b), bool)
                for c in cuts:
                    keep[c["s"]:c["e"]] = False
                b = b[keep]
            kept.append(b.tobytes())
        yield part, kept


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans`` (removed runs of the text's UTF-8 bytes; null: none) and ``kept`` (the bytes that remain)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("spans", "kept")])
    out = _with_spans(docs, text)
    schema = T.StructType([*docs.schema.fields, out.schema["spans"], T.StructField("kept", T.BinaryType())])
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kept in _kept(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:n], part.column(n + 1), pa.array(kept, pa.binary())], names=schema.names)

    return out.mapInArrow(run, schema)


def clean_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their texts cut: a character that a removed run splits goes with it."""
    place = docs.columns.index(text)
    # Only the columns beside the text travel, and the text once.
    out = _with_spans(docs, text).drop(f"c{place}")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kept in _kept(batch):
                cols = part.columns[:-2]
                cols.insert(place, pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return out.mapInArrow(run, schema)
