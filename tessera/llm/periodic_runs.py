"""Runs of periodic words, found as maximal pairs of the LCP-interval tree, and texts with each run cut to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``min_length`` words and ``exponent * q`` words long, that no
neighbouring word extends keeping period q.

Method: the suffixes of a text's words are ordered by prefix doubling and their
LCP values taken from the doubling ranks.  The LCP-interval tree is walked bottom
up; a node of depth l holds its positions in text order, each in the class of its
left word.  Two positions that first meet in a node share exactly l words; if
their left words differ too they are a maximal pair, and with distance q <= l /
(exponent - 1) it is a run of q + l words: nothing is extended.  Within such a
distance all positions of a node but the first have one left word (they are one
progression), so for the smallest period only the nearest position on either side
is asked; the smaller child is always put into the larger one.  A pair at a
multiple of the period spans the same words as the pair at the period, which is
kept.

Only texts that can hold a run get a tree: by hash, positions whose first
``min_length - 1`` words (or fewer, see ``least_depth``) recur at a distance that the
stretch of recurring positions allows.  Equal words hash alike, so none is lost;
the tree works on word numbers, not hashes, so none is made up.

What runs at scale: documents are only scanned, no shuffle; a text is worked on
by one task.  The tree of a text with m candidate words takes m log m list steps.

Rows: a null or empty text, or one of white space only, has no words, no runs and
an empty ``collapsed``.  Very long texts take memory in proportion to the longest
text (some 60 bytes a byte of text while it is scanned).  Repeated rows give equal rows; an empty table gives no
rows.  ``n_words runs collapsed`` replace input columns of those names; other
columns stay as they are, null ids too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textops import chunks, mix, prefix_hash, shingles, space_table, span_hash, word_spans

MIN_LENGTH, EXPONENT = 6, 4
PIECE_BYTES = 1 << 18
ADDED = ("n_words", "runs", "collapsed")
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
WORDS = r"[^\x20\x09-\x0D]+"


def least_depth(min_length: int, exponent: int) -> int:
    """The fewest words that the two ends of a run share."""
    if min_length < 3 or exponent < 2:
        raise ValueError("runs need min_length >= 3 and exponent >= 2")
    return min(max((exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))


def candidates(words: np.ndarray, per_row: np.ndarray, depth: int, exponent: int) -> np.ndarray:
    """Word positions (over all rows) that a run's maximal pair can use."""
    grams, counts = shingles(words, per_row, depth)
    if not len(grams):
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(per_row)), counts)
    at = np.arange(len(grams)) + np.repeat(np.cumsum(per_row) - per_row - (np.cumsum(counts) - counts), counts)
    key = mix(grams + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return np.zeros(0, np.int64)
    twice = np.append(same, False) | np.append(False, same)
    group = np.cumsum(np.append(True, ~same))[twice]
    pos = at[order[twice]]
    o = np.lexsort((pos, group))
    pos, group = pos[o], group[o]
    linked = group[1:] == group[:-1]
    gap = np.diff(pos)
    keep = np.zeros(len(pos), bool)
    for has, dist in ((np.append(linked, False), np.append(gap, 0)), (np.append(False, linked), np.append(0, gap))):
        # Positions with a later (then: an earlier) occurrence, and how many follow each other from each of them on.
        p, d = pos[has], dist[has]
        by = np.argsort(p)
        p, d = p[by], d[by]
        last = np.append(np.diff(p) != 1, True)
        stretch = p[last][np.searchsorted(np.flatnonzero(last), np.arange(len(p)))] - p + 1
        fine = stretch >= (exponent - 1) * d - depth + 1
        keep |= np.isin(pos, p[fine])
    return np.unique(pos[keep])


def suffix_order(ids: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``pick`` by the order of their suffixes, and the number of words that each shares with the next.

    Prefix doubling: a rank is the place of the first suffix with the same first 1, 2, 4, ... words; only suffixes
    that still share theirs are sorted again.
    """
    n = len(ids)
    _, inv, count = np.unique(ids, return_inverse=True, return_counts=True)
    rank = np.append((np.cumsum(count) - count)[inv], -1).astype(np.int32)
    active = np.flatnonzero(count[inv] > 1)
    levels, reach = [], 1
    while len(active):
        levels.append(rank)
        after = rank[np.minimum(active + reach, n)]
        o = np.lexsort((after, rank[active]))
        at, r, after = active[o], rank[active[o]], after[o]
        old = np.append(True, r[1:] != r[:-1])
        new = old | np.append(True, after[1:] != after[:-1])
        place = r + np.arange(len(at)) - np.flatnonzero(old)[np.cumsum(old) - 1]
        rank = rank.copy()
        rank[at] = place[new][np.cumsum(new) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        active = at[np.repeat(size, size) > 1]
        reach *= 2
    order = pick[np.argsort(rank[pick])]
    i, j = order[:-1], order[1:]
    shared = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared[levels[k][np.minimum(i + shared, n)] == levels[k][np.minimum(j + shared, n)]] += 1 << k
    return order, shared


def maximal_pairs(order: list[int], shared: list[int], left: list[int], depth: int, min_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, distance, words shared) of the maximal pairs that are runs, bottom up over the LCP intervals.

    ``left`` has the class of the word before each position.
    """
    nodes: list[list] = []  # open intervals from the root down: depth, positions in text order

    def meet(a: list[int], b: list[int], l: int) -> tuple[list[int], list[tuple[int, int, int]]]:
        if len(a) < len(b):
            a, b = b, a
        reach, found, at = l // (exponent - 1), [], 0
        for p in b:
            at = bisect_left(a, p)
            if at < len(a) and a[at] - p <= reach and left[a[at]] != left[p]:
                found.append((p, a[at] - p, l))
            if at and p - a[at - 1] <= reach and left[a[at - 1]] != left[p]:
                found.append((a[at - 1], p - a[at - 1], l))
        if len(b) == 1:
            a.insert(at, b[0])
        else:
            a += b
            a.sort()  # two sorted runs: a merge
        return a, found

    for p, l in zip(order, [*shared, 0]):
        node = [p]
        while nodes and nodes[-1][0] > l:
            d, held = nodes.pop()
            node, found = meet(held, node, d)
            yield from found
        if l >= depth:
            if nodes and nodes[-1][0] == l:
                nodes[-1][1], found = meet(nodes[-1][1], node, l)
                yield from found
            else:
                nodes.append([l, node])


def runs_of(ids: np.ndarray, pick: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's word numbers, by start, then period; ``pick`` has both ends of all pairs."""
    depth = least_depth(min_length, exponent)
    order, shared = suffix_order(ids, pick)
    left = [-1, *ids.tolist()]
    period: dict[tuple[int, int], int] = {}
    for s, q, l in maximal_pairs(order.tolist(), shared.tolist(), left, depth, min_length, exponent):
        if q + l >= min_length and q < period.get((s, q + l), q + 1):
            period[s, q + l] = q
    return sorted((s, n, q) for (s, n), q in period.items())


def _numbers(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each word: equal words only have equal numbers."""
    raw, known = data.tobytes(), {}
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(s.tolist(), e.tolist())], np.int64)


def find(data: np.ndarray, offs: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, list[list], np.ndarray, np.ndarray]:
    """Words of every row, its runs, and the collapsed texts as bytes and offsets."""
    s, e, per_row = word_spans(data, offs, space_table())
    n_rows, depth = len(per_row), least_depth(min_length, exponent)
    runs: list[list] = [[] for _ in range(n_rows)]
    keep = np.ones(len(s), bool)
    if len(s):
        pick = candidates(span_hash(prefix_hash(data), s, e), per_row, depth, exponent)
        begin = np.cumsum(per_row) - per_row
        for r in np.unique(np.searchsorted(begin, pick, side="right") - 1).tolist():
            a, b = int(begin[r]), int(begin[r] + per_row[r])
            ids = _numbers(data[s[a]:e[b - 1]], s[a:b] - s[a], e[a:b] - s[a])
            runs[r] = runs_of(ids, pick[slice(*np.searchsorted(pick, (a, b)))] - a, min_length, exponent)
            for start, length, q in runs[r]:
                keep[a + start + q:a + start + length] = False
    # Kept words, and the byte behind each but the last of a row, which becomes a space.
    s, e = s[keep], e[keep]
    row = np.repeat(np.arange(n_rows), per_row)[keep]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] = 1
    edge[e] -= 1  # ends differ; an end may be the start of the next row's word
    inner = e[:-1][row[1:] == row[:-1]] if len(row) else e
    out = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out[inner] = True
    text = data.copy()
    text[inner] = 32
    return per_row, runs, text[out], np.append(0, np.cumsum(out))[offs]


def collapse(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period in words) and ``collapsed``: the words outside every run's later
    periods, joined by one space."""
    least_depth(min_length, exponent)
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ADDED]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
                           T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, rows, data, offs in chunks(texts, PIECE_BYTES):
                n, runs, out, ends = find(data, offs, min_length, exponent)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
                cuts = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
                collapsed = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(first, rows) for k in range(len(names))], pa.array(n, pa.int64()),
                                                  pa.ListArray.from_arrays(cuts, spans), collapsed], names=schema.names)

    inputs = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate([*names, text])]
    return docs.select(*inputs).mapInArrow(run, schema)


def strongest(runs) -> F.Column:
    """The run of greatest length / period (compared exactly); ties: smallest start, then period; null without runs."""
    def order(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, order), F.lit(0))


def with_planted_tail(text: str, number) -> F.Column:
    """``text`` with its words from ``a`` on replaced by repetitions of the ``p`` words there, for every tenth ``number``:
    a = g % n and p = 1 + (n - a) / (3 + g % 8) for n words and g = number / 10.  Other texts stay as they are."""
    g = F.floor(number / 10).cast("int")

    def tail(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.when(n > 0, F.concat(F.slice(w, 1, a), F.slice(again, 1, n - a))), " ")
    # The words are bound once, as the element of an array of one.
    planted = F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(f"({WORDS})"))), tail)[0]
    return F.when((number % 10 == 0) & F.col(text).rlike(WORDS), planted).otherwise(F.col(text))


