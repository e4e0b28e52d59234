"""Language-model scoring by online logistic context mixing.

A text (A-Z lower-cased) is a sequence of words and of the white space between
them.  The byte string of a word ends in an end mark, that of white space in a
mark for "a word follows" or "end of text", so the product over all of them is
a probability of the whole text.

Texts fall into ``CLASSES`` classes by their byte pairs (k-means over
every distinct training text), which in practice are languages; the class is
coded first and is part of some contexts.

Method: every byte is coded as a path of binary decisions, shorter for bytes
that are more common in the training words.  Several predictors,
each with bit counts found by a hashed context (the last 1, 2, 3, 4 or 6
bytes of the word, or all its bytes so far), give a probability each; their
logits are added with weights that a gate picks by how often the two longest
contexts were seen; an adaptive map refines the sum from what happened at the
same predicted probability.  Counts come from all training texts: every context
of every training word has its own, words seen once too.  Weights and map are
learnt online, batch by batch in one pass over all training words, predicting
each word without its own occurrence; the weights of the blocks of words are
averaged by the bits that they saw.

At scale: texts are dealt to blocks by a hash; a block sends its distinct words
once, so counting and looking up are one shuffle of words per block, not of
tokens.  Distinct (class, word) pairs are dealt to blocks of about ``UNITS`` by
a hash; each sends the sums of its (predictor, context, byte) keys to shards of
the key range, which add all blocks up and send back the whole counts of the
block's contexts.  No task holds a table of the whole model.  The task that gets a
block's counts learns from them and keeps, for every key of the block, the count
of its context and those of the sides that its path does not take; scoring reads
these.  Words and scores travel between blocks of texts and the vocabulary's parts
in one packed row per pair of both.

Words are ``[^\\x20\\x09-\\x0D]+``.  Rows: a null text counts as empty; an empty
text is scored for its end.  Repeated rows are learnt and scored one by one; a
null id falls into fold 0 (training).  An empty table gives no rows, and without
training texts every count is 0.  The result has its own columns only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import fold
from tessera.llm.storage import materialise, text_bytes
from tessera.llm.textops import SPACE_BYTES, chunks, lower_table, mix, prefix_hash, space_table, span_hash, string_bytes, word_spans

END_WORD, MORE, END_TEXT = 0xFE, 0xFE, 0xFF  # bytes that UTF-8 never uses
ORDERS = (1, 2, 3, 4, 6, 255)  # bytes of context; 255: all of the word
WITH_CLASS = (0, 1, 2, 5)  # predictors whose context holds the class
CLASSES, PAIRS = 6, 512
PACK, STARTS, STILL = 512, 4, 1e-3  # texts of a row of pair counts; sets of starts; change of a centre at which k-means ends
GATES = 8
GATE_OF = np.log2(np.arange(1, (1 << GATES - 1) + 1)).astype(np.int8)  # the gate of counts up to the first of the last gate
MAP_STEPS = 33
BATCH_WORDS = 256
MIX_BITS, MIX_BYTES = 1 << 16, 1 << 13
PATH_KEYS = 1 << 13  # keys whose paths are counted together, in a core's cache
UNITS = 20_000  # (class, word) pairs of a block of the model
KEYS_OF_UNIT, SHARD_KEYS = 20, 1_000_000  # guess of the keys that a unit sends; keys of a shard
RATE = 0.05
BLOCK_BYTES = 16 << 20
RUN_BYTES = 1 << 18
DEALT_WORDS = 100_000  # scored words that are dealt to blocks together


# Classes of texts.

def _pair_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of hashed byte pairs, a row for each text."""
    rows = len(offs) - 1
    cell = np.repeat(np.arange(rows) * PAIRS, np.diff(offs))
    pair = data.astype(np.uint16)
    cell[1:] += (pair[:-1] * np.uint16(31) + pair[1:] * np.uint16(7)) % np.uint16(PAIRS)
    starts = offs[:-1][offs[1:] > offs[:-1]]  # the first byte of a row has no pair
    counts = np.bincount(cell, minlength=rows * PAIRS)
    counts[cell[starts]] -= 1
    return counts.reshape(rows, PAIRS)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the pairs, as unit rows."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _pair_shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return _shares(_pair_counts(data, offs))


def _pair_table(texts: DataFrame) -> DataFrame:
    """(h, v): pair counts of every distinct text, ``PACK`` texts a row."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offs in chunks(batch.column("text")):
                v = [_narrow(x).tobytes() for x in _pair_counts(lower_table()[data], offs)]
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(first, rows), pa.array(v, pa.binary())], names=["h", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, PACK):
            h = b"".join(x[:8] for x in batch.column("h").to_pylist())
            v = _pack(_narrow(np.concatenate([np.frombuffer(x, f"u{len(x) // PAIRS}") for x in batch.column("v").to_pylist()])))
            yield pa.RecordBatch.from_arrays([pa.array([h], pa.binary()), pa.array([v], pa.binary())], names=["h", "v"])

    keyed = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), "text")
    distinct = keyed.mapInArrow(count, "h binary, v binary").groupBy("h").agg(F.first("v").alias("v"))
    return materialise(distinct.mapInArrow(pack, "h binary, v binary"), "pairs")


def fit_classes(texts: DataFrame, rounds: int = 8) -> np.ndarray:
    """Centres of the classes: k-means over every distinct text, with far-apart starts.

    A start is drawn with its squared distance as weight, by a hash of the text;
    a round adds up the vectors of each class.  Of ``STARTS`` sets of centres
    that go through the same passes, the one that fits all texts best is taken.
    """
    table = _pair_table(texts)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for h, v in zip(batch.column("h").to_pylist(), batch.column("v").to_pylist()):
                yield np.frombuffer(h, np.uint64), _shares(_counts(v, len(h) // 8 * PAIRS).reshape(-1, PAIRS))

    def start(sets: np.ndarray) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, bytes]] = {}
            for h, x in rows_of(batches):
                for r, centres in enumerate(sets):
                    far = np.maximum(1 - (x @ centres.T).max(1), 0).astype(np.float64) ** 2 + 1e-12 if len(centres) else np.ones(len(x))
                    u = (mix(h + np.uint64(r * CLASSES + len(centres))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54
                    draw = np.log(u) / far
                    i = int(draw.argmax())
                    if r not in best or draw[i] > best[r][0]:
                        best[r] = (float(draw[i]), x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.float64()),
                                              pa.array([v[1] for v in best.values()], pa.binary())], names=["r", "draw", "x"])

        found = table.mapInArrow(run, "r int, draw double, x binary").toArrow().to_pylist()  # a row per task and set
        found.sort(key=lambda f: (f["draw"], f["x"]))
        last = {f["r"]: np.frombuffer(f["x"], np.float32) for f in found}
        return np.stack([last[r] for r in range(STARTS)])[:, None] if last else None

    def sums(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, fit = np.zeros((STARTS, CLASSES, PAIRS)), np.zeros(STARTS)
            for _, x in rows_of(batches):
                near = (sets.reshape(-1, PAIRS) @ x.T).reshape(STARTS, CLASSES, -1)
                best, of = near[:, 0].copy(), np.zeros((STARTS, len(x)), np.int8)
                for k in range(1, CLASSES):
                    of[near[:, k] > best] = k
                    np.maximum(best, near[:, k], out=best)
                total += ((of[:, None] == np.arange(CLASSES)[:, None]).astype(np.float32).reshape(-1, len(x)) @ x).reshape(total.shape)
                fit += best.sum(1)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), fit).tobytes()], pa.binary())], names=["x"])

        found = table.mapInArrow(run, "x binary").toArrow().to_pylist()  # a row per task
        total = sum((np.frombuffer(f["x"]) for f in found), np.zeros(STARTS * (CLASSES * PAIRS + 1)))
        return total[:-STARTS].reshape(STARTS, CLASSES, PAIRS), total[-STARTS:]

    sets = np.zeros((STARTS, 0, PAIRS), np.float32)
    while sets.shape[1] < CLASSES:
        x = start(sets)
        if x is None:
            return np.zeros((CLASSES, PAIRS), np.float32)
        sets = np.concatenate([sets, x], 1)
    for _ in range(rounds):
        total, fit = sums(sets)
        norm = np.linalg.norm(total, axis=2, keepdims=True)
        new = np.where(norm > 0, np.round(total / np.maximum(norm, 1e-9), 6), sets).astype(np.float32)
        still, sets = np.abs(new - sets).max() < STILL, new
        if still:
            break
    return sets[int(np.round(fit / max(fit.max(), 1e-9), 6).argmax())]


def classes_of(centres: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return (_pair_shares(data, offs) @ centres.T).argmax(1)


# Words of a block.

def _pieces(data: np.ndarray, offs: np.ndarray):
    """Spans of the words, row of each, the row and the byte before each single space between words, and the other
    white space before the first and after each word as (row, key): key is the byte before (0 at the start), the
    white space and a mark."""
    s, e, per_row = word_spans(data, offs, space_table())
    row = np.repeat(np.arange(len(per_row)), per_row)
    buf = data.tobytes()
    tails: list[tuple[int, bytes]] = []
    single = row[:0], data[:0]
    last = np.ones(len(s), bool)
    if len(s):
        last[:-1] = row[1:] != row[:-1]
        nxt = np.append(s[1:], 0)
        plain = ~last & (nxt - e == 1) & (data[np.minimum(e, len(data) - 1)] == 0x20)
        single = row[plain], data[e[plain] - 1]
        for i in np.flatnonzero(~plain):
            stop = int(offs[row[i] + 1]) if last[i] else int(nxt[i])
            tails.append((int(row[i]), buf[e[i] - 1:stop] + bytes([END_TEXT if last[i] else MORE])))
    first = np.full(len(per_row), -1)
    if len(s):
        f = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        first[row[f]] = s[f]
    for r in range(len(per_row)):
        stop, mark = (int(first[r]), MORE) if first[r] >= 0 else (int(offs[r + 1]), END_TEXT)
        tails.append((r, b"\0" + buf[int(offs[r]):stop] + bytes([mark])))
    return s, e, row, single, tails


def _space_after(byte: int) -> bytes:
    """The key of a single space after that byte, before a word."""
    return bytes([byte, 0x20, MORE])


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The spans of ``data`` as a binary column."""
    ends = np.concatenate([[0], np.cumsum(size)])
    out = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _block_words(t: pa.Table, centres: np.ndarray, parts: int) -> pa.Table:
    """Distinct (class, word) of a block (kind 0), white space keys (kind 1, class 0), classes of texts (kind 2)
    and coded bytes (kind 3) with their training counts, dealt to ``parts`` by the word: a packed row for each part."""
    train = ~t["held"].to_numpy()
    found: list[tuple] = []  # per run: hashes, place, size, class and training count of its words
    texts: list[np.ndarray] = []
    others: dict[tuple[int, bytes], int] = {}
    coded = np.zeros(256, np.int64)
    base = 0
    for first, rows, data, offs in chunks(t["text"], RUN_BYTES):
        data = lower_table()[data]
        z = classes_of(centres, data, offs)
        s, e, row, single, tails = _pieces(data, offs)
        if len(s):
            h = span_hash(prefix_hash(data), s, e) + z[row].astype(np.uint64)
            order = np.argsort(h)
            at = np.flatnonzero(_heads(h[order]))
            c = np.add.reduceat(train[first + row[order]].astype(np.int64), at)
            at = order[at]
            found.append((h[at], base + s[at], (e - s)[at], z[row[at]], c))
            texts.append(data)
            base += len(data)
        after = np.bincount(single[1], train[first + single[0]], 256)
        for b in np.flatnonzero(np.bincount(single[1], minlength=256)).tolist():
            others[1, _space_after(b)] = others.get((1, _space_after(b)), 0) + int(after[b])
        for r, key in tails:
            others[1, key] = others.get((1, key), 0) + int(train[first + r])
        for k in range(CLASSES):
            key = (2, bytes([k]))
            others[key] = others.get(key, 0) + int(train[first:first + rows][z == k].sum())
        coded += np.bincount(data[np.repeat(train[first:first + rows], np.diff(offs))], minlength=256)
    coded[list(SPACE_BYTES)] = 0  # those of words; white space follows
    coded[END_WORD] = sum(int(f[4].sum()) for f in found)
    for (k, key), c in others.items():
        if k == 1:
            coded += c * np.bincount(np.frombuffer(key, np.uint8)[1:], minlength=256)
    others |= {(3, bytes([b])): int(coded[b]) for b in np.flatnonzero(coded)}
    keys = list(others)
    word, kind, z, n = pa.array([k[1] for k in keys], pa.binary()), [k[0] for k in keys], [0] * len(keys), list(others.values())
    if found:
        h, place, size, cls, c = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h)
        at = np.flatnonzero(_heads(h[order]))
        c = np.add.reduceat(c[order], at)
        at = order[at]
        word = pa.concat_arrays([_cut(np.concatenate(texts), place[at], size[at]), word])
        kind, z = np.concatenate([np.zeros(len(at)), kind]), np.concatenate([cls[at], z])
        n = np.concatenate([c, n])
    kind, z, n = np.asarray(kind).astype(np.uint8), np.asarray(z).astype(np.uint8), np.asarray(n).astype(np.int64)
    part = (_word_hashes(word, kind) >> np.uint64(32)).astype(np.int64) * parts >> 32
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    use = np.flatnonzero(np.diff(at))
    data, offs = string_bytes(word.take(pa.array(order)))
    ends = np.append(at[use], len(order))
    return pa.table({"part": pa.array(use, pa.int32()), "block": pa.array(np.full(len(use), t["block"][0].as_py()), pa.int32()),
                     "word": _slices(data, offs[ends]), "size": _slices(np.diff(offs).astype(np.int32)[:len(order)], ends),
                     **{c: _slices(x[order], ends) for c, x in (("kind", kind), ("z", z), ("n", n))}})


PACKED = "part int, block int, word binary, size binary, kind binary, z binary, n binary"


def _slices(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of an array, cut at ``ends``, as a binary column."""
    at = (ends * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _joined(column: pa.ChunkedArray, dtype=np.uint8) -> np.ndarray:
    """All the rows of a column of ``_slices``, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _word_hashes(words: pa.Array, kind: np.ndarray) -> np.ndarray:
    """64-bit hash of every (kind, word)."""
    return mix(_hashes(words) + kind)


def _hashes(words: pa.Array) -> np.ndarray:
    h = [span_hash(prefix_hash(data), offs[:-1], offs[1:]) for _, _, data, offs in chunks(words, RUN_BYTES)]
    return np.concatenate([*h, np.zeros(0, np.uint64)])


VOCABULARY = "kind byte, z byte, word binary, new boolean, c bigint, cz bigint, blocks array<int>"


def _part_words(t: pa.Table) -> pa.Table:
    """One row per (kind, word, class) of a part: the word's training count in all and in the class, the blocks that
    hold it; ``new`` in one row of each word."""
    kind, z, n, size = (_joined(t[c], d) for c, d in (("kind", np.uint8), ("z", np.uint8), ("n", np.int64), ("size", np.int32)))
    words = _binaries(_joined(t["word"]), size)
    block = np.repeat(t["block"].to_numpy(), [len(k.as_buffer()) for k in t["kind"]])
    low = np.uint64(15)  # holds the class
    key = _word_hashes(words, kind) & ~low | z
    order = np.argsort(key)
    same = _heads(key[order] >> np.uint64(4))
    sorted_words = words.take(pa.array(order))
    equal = pc.equal(sorted_words[1:], sorted_words[:-1]).to_numpy(zero_copy_only=False) & (kind[order][1:] == kind[order][:-1])
    if not (equal | same[1:]).all():  # two words with one hash
        order = np.lexsort((z, kind, pc.rank(words, tiebreaker="min").to_numpy()))
        sorted_words = words.take(pa.array(order))
        equal = pc.equal(sorted_words[1:], sorted_words[:-1]).to_numpy(zero_copy_only=False) & (kind[order][1:] == kind[order][:-1])
        same = np.append(True, ~equal)
    kind, z, n = kind[order], z[order], n[order]
    unit = np.flatnonzero(same | _heads(z))
    whole = np.add.reduceat(n, np.flatnonzero(same))
    return pa.table({"kind": pa.array(kind[unit].astype(np.int8)), "z": pa.array(z[unit].astype(np.int8)), "word": sorted_words.take(pa.array(unit)),
                     "new": pa.array(same[unit]), "c": pa.array(whole[(np.cumsum(same) - 1)[unit]]), "cz": pa.array(np.add.reduceat(n, unit)),
                     "blocks": pa.ListArray.from_arrays(pa.array(np.append(unit, len(n)), pa.int32()), pa.array(block[order], pa.int32()))})


# The model.

def _strings(words: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coded bytes, their offsets, and for every byte the place from which its context may begin.
    A word is coded with its end mark; white space after the byte it follows, which is context only."""
    data, offs = string_bytes(words)
    data, offs = data[offs[0]:offs[-1]], offs - offs[0]
    n = np.diff(offs) + (kind == 0)
    out_offs = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(out_offs[-1]), END_WORD, np.uint8)
    row = np.repeat(np.arange(len(kind)), np.diff(offs))
    out[np.arange(len(data)) + (out_offs[:-1] - offs[:-1])[row]] = data
    return out, out_offs, np.repeat(np.arange(len(kind)), n)


def _contexts(data: np.ndarray, offs: np.ndarray, row: np.ndarray, kind: np.ndarray, z: np.ndarray):
    """Hash of every predictor's context at every coded byte, with the bytes and their rows."""
    prefix = prefix_hash(data)
    at = np.arange(len(data))
    start = offs[:-1][row]
    coded = (kind[row] == 0) | (at > start)
    at, start, row = at[coded], start[coded], row[coded]
    salt = (kind[row] * 7919 + 1).astype(np.uint64)
    with_class = salt + (z[row] * 104729).astype(np.uint64)
    ctx = [span_hash(prefix, np.maximum(start, at - o), at) + (with_class if k in WITH_CLASS else salt) * np.uint64(0x2545F4914F6CDD1D)
           + (at - np.maximum(start, at - o)).astype(np.uint64) for k, o in enumerate(ORDERS)]
    return ctx, data[at].astype(np.int64), row


def byte_code(counts: np.ndarray) -> dict[str, np.ndarray]:
    """A binary tree over the 256 bytes, with short paths for common ones: for each byte the number of
    its decisions and where they start in the lists of nodes passed and turns taken.  ``rank`` numbers
    the leaves from left to right; ``parted`` is, for two ranks, the number of decisions that both share."""
    heap = [(float(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    new = 256
    while len(heap) > 1:
        (x, _, left), (y, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left], parent[right] = (new, 0), (new, 1)
        heapq.heappush(heap, (x + y, new, new))
        new += 1
    size, start, node, turn, paths = [], [], [], [], []
    for b in range(256):
        path, at = [], b
        while at in parent:
            path.append(parent[at])
            at = parent[at][0]
        start.append(len(node))
        size.append(len(path))
        node += [p[0] for p in reversed(path)]
        turn += [p[1] for p in reversed(path)]
        paths.append(turn[start[-1]:])
    leaves, rank = sorted(range(256), key=paths.__getitem__), [0] * 256
    passed = np.full((256, max(size)), -1)
    for r, b in enumerate(leaves):
        rank[b] = r
        passed[r, :size[b]] = node[start[b]:start[b] + size[b]]
    parted = np.zeros((256, 256), np.uint8)
    for d in range(1, passed.shape[1]):
        parted += (passed[:, None, d] == passed[:, d]) & (passed[:, None, d] >= 0)  # a node has one way to it
    return {"parted": parted, **{k: np.array(v, np.int64) for k, v in (("size", size), ("start", start), ("node", node), ("turn", turn), ("rank", rank))}}


def _runs(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of so many rows."""
    held, n = [], 0
    for b in batches:
        for i in range(0, b.num_rows, words):
            held.append(b.slice(i, words))
            n += held[-1].num_rows
            if n >= words:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _one_batch(t: pa.Table) -> pa.RecordBatch:
    return (t.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], t.schema)])[0]


def _columns(batch: pa.RecordBatch, count: str = "c"):
    col = lambda c: batch.column(batch.schema.names.index(c))
    kind = col("kind").to_numpy().astype(np.int64)
    words = _contexts(*_strings(col("word"), kind), kind, col("z").to_numpy().astype(np.int64))
    return words, kind, col(count).to_numpy().astype(np.float64)


def _pair_keys(ctx: list[np.ndarray], byte: np.ndarray) -> np.ndarray:
    """For every predictor and coded byte: 56 bits of hash of (predictor, context), then the byte."""
    return np.concatenate([(mix(x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & ~np.uint64(255)) | byte.astype(np.uint64)
                           for k, x in enumerate(ctx)])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n


def _pack(x: np.ndarray) -> bytes:
    """An array by byte planes, compressed, after its length."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(raw: bytes, dtype) -> np.ndarray:
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True) if raw[:8] != bytes(8) else b""
    planes = np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the least bytes that hold all of them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _counts(raw: bytes, n: int) -> np.ndarray:
    """A packed array of ``n`` counts, in as many bytes as they took."""
    return _unpack(raw, f"u{int.from_bytes(raw[:8], 'little') // n}") if n else np.zeros(0, np.uint8)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a new value begins, in order."""
    return np.append(True, x[1:] != x[:-1])[:len(x)]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_heads(x)]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them.  The upper bits of the hash, the byte and the
    place are sorted as one number; where such bits of two contexts are the same, the keys themselves are."""
    bits = np.uint64(len(keys).bit_length())
    low = bits + np.uint64(8)
    order = (keys >> low << low) | (keys & np.uint64(255)) << bits | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    in_order = keys[order]
    if (in_order[1:] < in_order[:-1]).any():
        order = np.argsort(keys)
        in_order = keys[order]
    new = _heads(in_order)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return in_order[new], place


def _asked(units: pa.RecordBatch) -> dict:
    """The coded bytes of units: each one's row and, for every predictor, its place among the distinct keys."""
    (ctx, byte, row), _, c = _columns(units, "cz")
    found = [_ranked(k) for k in _pair_keys(ctx, byte).reshape(len(ORDERS), -1)]  # a predictor at a time stays in the cache
    keys, place = _ranked(np.concatenate([k for k, _ in found]))
    ends = np.cumsum([len(k) for k, _ in found])
    return {"keys": keys, "inv": np.stack([place[e - len(k):e][inv] for e, (k, inv) in zip(ends, found)]), "byte": byte, "row": row, "c": c}


def _own_keys(units: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block's units, in order, and their training counts in it."""
    asked = _asked(_one_batch(units))
    keys, c = asked["keys"], asked["c"][asked["row"]]
    return keys, sum(np.bincount(inv, c, len(keys)).astype(np.int64) for inv in asked["inv"])


ANSWER = ("m", np.uint16), ("b", np.uint8), ("n", np.int64)  # bytes seen in each context, those bytes, their counts


def context_counts(units: DataFrame, shards: int) -> DataFrame:
    """(block, shard, m, b, n): for every block of (kind, z, word, cz), the whole counts over all blocks of every
    (predictor, context, byte) of the contexts that occur in it, in the order of its contexts.

    A block sends the sums of its own keys, zeros too, to the shards of the key
    range; a shard adds all blocks up and answers each block with its contexts.
    """
    def ask(t: pa.Table) -> pa.Table:
        keys, n = _own_keys(t)
        shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(shard, np.arange(shards + 1))
        use = np.flatnonzero(np.diff(at))
        return pa.table({"shard": pa.array(use, pa.int32()), "block": pa.array(np.full(len(use), t["mb"][0].as_py()), pa.int32()),
                         "keys": pa.array([_pack(np.diff(keys[at[i]:at[i + 1]], prepend=np.uint64(0))) for i in use], pa.binary()),
                         "n": pa.array([_pack(n[at[i]:at[i + 1]]) for i in use], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        asked = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in t["keys"].to_pylist()]
        keys, n = _summed(np.concatenate(asked), np.concatenate([_unpack(x, np.int64) for x in t["n"].to_pylist()]))
        keys, n = keys[n > 0], n[n > 0]
        ctx, out = keys >> np.uint64(8), []
        for x in asked:
            want = x >> np.uint64(8)
            want = want[_heads(want)]
            lo = np.searchsorted(ctx, want)
            m = np.searchsorted(ctx, want, "right") - lo
            at = np.arange(m.sum()) + np.repeat(lo - (np.cumsum(m) - m), m)
            out.append((m, keys[at] & np.uint64(255), n[at]))
        return pa.table({"block": t["block"], "shard": t["shard"],
                         **{c: pa.array([_pack(x[i].astype(d)) for x in out], pa.binary()) for i, (c, d) in enumerate(ANSWER)}})

    asked = units.select("mb", "kind", "z", "word", "cz").groupBy("mb").applyInArrow(ask, "shard int, block int, keys binary, n binary")
    return asked.groupBy("shard").applyInArrow(answer, "block int, shard int, m binary, b binary, n binary")


def block_models(units: DataFrame, shards: int, use: Callable[..., pa.Table] | None = None,
                 schema: str = "units binary, m binary, b binary, n binary") -> DataFrame:
    """One row per block: its units in a fixed order (an Arrow stream), and the counts of their contexts; or what
    ``use`` makes of the units and those counts, in the task that has them."""
    def run(u: pa.Table, a: pa.Table) -> pa.Table:
        u = u.drop_columns(["mb"]).combine_chunks().sort_by([("kind", "ascending"), ("word", "ascending"), ("z", "ascending")])
        a = a.sort_by("shard")
        counts = [np.concatenate([_unpack(x, d) for x in a[c].to_pylist()]) for c, d in ANSWER]
        if use:
            return use(u, *counts)
        return pa.table({"units": pa.array([_stream(u)], pa.binary()), **{c: pa.array([_pack(x)], pa.binary()) for (c, _), x in zip(ANSWER, counts)}})

    return units.groupBy("mb").cogroup(context_counts(units, shards).groupBy("block")).applyInArrow(run, schema)


def _stream(units: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, units.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(units)
    return sink.getvalue().to_pybytes()


def _units_of(row: dict) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(row["units"])).read_all().combine_chunks()


def _context_keys(own: np.ndarray, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All keys of the contexts of a block's ``own`` keys, in order."""
    ctx = own >> np.uint64(8)
    return np.repeat(ctx[_heads(ctx)], m) << np.uint64(8) | b.astype(np.uint64)


def _whole_counts(row: dict) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Units of a block, all keys of their contexts in order, and the counts."""
    units = _units_of(row)
    m, b, n = (_unpack(row[c], d) for c, d in ANSWER)
    return units, _context_keys(_asked(_one_batch(units))["keys"], m, b), n


def _bit_counts(keys: np.ndarray, n: np.ndarray, code: dict) -> dict:
    """Counts of all contexts: where each one's bytes begin, their ranks and counts."""
    ctx = keys >> np.uint64(8)
    new = _heads(ctx)
    return {"ctx": ctx[new], "starts": np.append(np.flatnonzero(new), len(keys)), "ranks": code["rank"].astype(np.uint8)[(keys & np.uint64(255)).astype(np.int64)],
            "counts": n.astype(np.float64), "total": np.append(0, np.cumsum(n)), "code": code}


def _path_counts(model: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key the count of its context, and for every decision of it the count of the side not taken;
    that of the side taken is what the decisions before it left of the context's."""
    size = model["code"]["size"]
    found = [_paths(model, keys[i:i + PATH_KEYS], size) for i in range(0, len(keys), PATH_KEYS)]
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (list(zip(*found)) or [(), ()]))


def _paths(model: dict, keys: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, starts = model["code"], model["starts"]
    want, byte = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
    left = size[byte]
    out = np.cumsum(left) - left
    whole, other = np.zeros(len(keys), np.int64), np.zeros(int(left.sum()), np.int64)
    if not len(model["ctx"]):
        return whole, other
    new = _heads(want)
    at, want = np.cumsum(new) - 1, want[new]
    spot = np.minimum(np.searchsorted(model["ctx"], want), len(model["ctx"]) - 1)
    live = np.flatnonzero((model["ctx"][spot] == want)[at])
    at, byte = spot[at[live]], byte[live]
    low, n = starts[at], starts[at + 1] - starts[at]
    whole[live] = model["total"][starts[at + 1]] - model["total"][low]
    # Every byte of the context counts where its path leaves the key's; the key's own byte never does.
    to = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
    rank, seen = np.repeat(code["rank"][byte], n), model["ranks"][to]
    count = model["counts"][to]
    count[seen == rank] = 0
    rank <<= 8
    rank |= seen
    slot = np.repeat(out[live], n)
    slot += code["parted"].ravel()[rank]
    return whole, np.bincount(slot, count, len(other)).astype(np.int64)


def _key_inputs(code: dict, keys: np.ndarray, whole: np.ndarray, other: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the decisions of every key begin, and at each of them the logit and the gate of its context."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    size = code["size"][byte]
    first = np.cumsum(size) - size
    logit, gate = np.empty(len(other), np.float32), np.empty(len(other), np.int8)
    for i in range(0, len(keys), PATH_KEYS):
        n, o = size[i:i + PATH_KEYS], first[i:i + PATH_KEYS]
        here = slice(int(o[0]), int(o[-1] + n[-1]))
        off = other[here]
        gone = np.append(0, np.cumsum(off))
        o = o - o[0]
        on = np.repeat(whole[i:i + PATH_KEYS] + gone[o], n) - gone[1:]
        if own:
            on = np.maximum(on - 1, 0)
        turn = code["turn"][np.repeat(code["start"][byte[i:i + PATH_KEYS]] - o, n) + np.arange(len(off))] == 1
        n1, n0 = np.where(turn, on, off), np.where(turn, off, on)
        gate[here] = _gate(n0 + n1)
        logit[here] = np.log((n1.astype(np.float32) + LEAST) / (n0.astype(np.float32) + LEAST))
    return first, logit, gate


def _byte_inputs(code: dict, asked: dict, inputs: tuple, i: int, j: int):
    """Logits of all predictors, the gate, the turn and the row at every decision of the coded bytes i to j."""
    first, logit, gate = inputs
    byte, inv = asked["byte"][i:j], asked["inv"][:, i:j]
    size = code["size"][byte]
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    y = code["turn"][np.repeat(code["start"][byte] - begin, size) + at]
    x = np.empty((len(ORDERS) + 1, len(at)), np.float32)
    x[-1] = 0.3
    seen = {}
    for k in range(len(ORDERS)):
        spot = np.repeat(first[inv[k]] - begin, size)
        spot += at
        np.take(logit, spot, out=x[k], mode="clip")
        if k >= 3:
            seen[k] = gate[spot]
    return x, _gates(seen), y, np.repeat(asked["row"][i:j], size)


def _exact_inputs(model: dict, batch: pa.RecordBatch, own: bool):
    """Logits of all predictors and the gate at every decision, from whole counts; ``own``: without the
    word's own occurrence.  With the turns, the row of each decision and the training counts of the rows."""
    asked, code = _asked(batch), model["code"]
    inputs = _key_inputs(code, asked["keys"], *_path_counts(model, asked["keys"]), own)
    return *_byte_inputs(code, asked, inputs, 0, len(asked["byte"])), asked["c"]


def _gate(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context up to 7 for one seen often: whole part of log2(n + 1)."""
    return GATE_OF[np.minimum(n, len(GATE_OF) - 1)]


def _gates(g: dict[int, np.ndarray]) -> np.ndarray:
    eight, sixteen = np.int8(GATES), np.int8(2 * GATES)
    return np.where(g[5] > 0, eight + g[5], np.where(g[4] > 0, sixteen + g[4], g[3])).astype(np.int64)


LEAST = np.float32(0.05)  # added to both counts of a bit


SETS = 3 * GATES


def _place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower step of the map and the share of the next one."""
    at = (np.clip(z, -7.99, 7.99) + 8) * (MAP_STEPS - 1) / 16
    low = at.astype(np.int64)
    return low, at - low


def _refined(p: np.ndarray, z: np.ndarray, gate: np.ndarray, table: np.ndarray) -> np.ndarray:
    low, share = _place(z)
    m = table[gate, low] * (1 - share) + table[gate, low + 1] * share
    return np.clip((p + m) / 2, 1e-6, 1 - 1e-6)


LEARNT = "units binary, whole binary, other binary, w binary, bits binary, hits binary, tries binary"


def _learn_block(units: pa.Table, m: np.ndarray, b: np.ndarray, n: np.ndarray, code: dict) -> pa.Table:
    """One row: the units of a block, the counts on the paths of their keys, and the weights and the map learnt
    online from the units that training saw, in a random order."""
    order = np.random.default_rng(7).permutation(units.num_rows)
    seen = units["cz"].to_numpy()[order] > 0
    asked = _asked(_one_batch(units.take(pa.array(np.concatenate([order[seen], order[~seen]])))))
    keys, c, rows = asked["keys"], asked["c"], int(seen.sum())
    whole, other = _path_counts(_bit_counts(_context_keys(keys, m, b), n, code), keys)
    inputs = _key_inputs(code, keys, whole, other, True)
    k1 = len(ORDERS) + 1
    w = np.full((SETS, k1), 0.3)
    power = np.full((SETS, k1), 1e-3)
    hits, tries = np.zeros((SETS, MAP_STEPS)), np.zeros((SETS, MAP_STEPS))
    bits = np.zeros(SETS)
    ends = np.searchsorted(asked["row"], np.minimum(np.arange(0, rows + BATCH_WORDS, BATCH_WORDS), rows))
    for i, j in zip(ends[:-1], ends[1:]):
        x, gate, y, row = _byte_inputs(code, asked, inputs, i, j)
        weight = c[row]
        z = _mixed(x, gate, w)
        err = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * weight
        low, share = _place(z)
        cell = gate * MAP_STEPS + low + (share > 0.5)
        hits += np.bincount(cell, weight * y, SETS * MAP_STEPS).reshape(SETS, -1)
        tries += np.bincount(cell, weight, SETS * MAP_STEPS).reshape(SETS, -1)
        mass = np.bincount(gate, weight, SETS)
        grad = np.stack([np.bincount(gate, err * x[k], SETS) for k in range(k1)], 1) / np.maximum(mass, 1)[:, None]
        power += grad * grad
        w += RATE * grad / np.sqrt(power) * (mass > 0)[:, None]
        bits += mass
    learnt = (w * bits[:, None], bits, hits, tries) if bits.any() else (None,) * 4
    return pa.table({"units": pa.array([_stream(units)], pa.binary()), "whole": pa.array([_pack(_narrow(whole))], pa.binary()),
                     "other": pa.array([_pack(_narrow(other))], pa.binary()),
                     **{k: pa.array([None if x is None else x.tobytes()], pa.binary()) for k, x in zip(("w", "bits", "hits", "tries"), learnt)}})


def learn_blocks(units: DataFrame, shards: int, code: dict) -> DataFrame:
    """One row per block of (kind, z, word, cz, ...): ``LEARNT``."""
    def learn(u: pa.Table, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.Table:
        return _learn_block(u, m, b, n, code)

    return block_models(units, shards, learn, LEARNT)


def mean_mixing(models: DataFrame, code: dict) -> dict:
    """Mixing weights, averaged over the blocks by the bits that they saw, and the adaptive map of all blocks."""
    k1 = len(ORDERS) + 1
    rows = models.where("bits IS NOT NULL").select("w", "bits", "hits", "tries").toArrow().to_pylist()  # a row per block
    rows.sort(key=lambda r: (r["bits"], r["w"]))  # sums in one order
    total = {c: sum((np.frombuffer(r[c]) for r in rows), np.zeros(s)) for c, s in
             (("w", SETS * k1), ("bits", SETS), ("hits", SETS * MAP_STEPS), ("tries", SETS * MAP_STEPS))}
    bits = total["bits"][:, None]
    w = np.where(bits > 0, total["w"].reshape(SETS, k1) / np.maximum(bits, 1), 0.3)
    steps = 1 / (1 + np.exp(-(np.arange(MAP_STEPS) * 16 / (MAP_STEPS - 1) - 8)))
    hits, tries = total["hits"].reshape(SETS, -1), total["tries"].reshape(SETS, -1)
    return {"code": code, "w": w, "map": (hits + 8 * steps) / (tries + 8)}


def _mixed(x: np.ndarray, gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the logits, with the weights that the gate picks."""
    out = x[0] * w[:, 0][gate]
    for k in range(1, len(x)):
        out += x[k] * w[:, k][gate]
    return out


def _log_mix(model: dict, x: np.ndarray, gate: np.ndarray, y: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows)
    for i in range(0, len(y), MIX_BITS):
        here = slice(i, i + MIX_BITS)
        logit = _mixed(x[:, here], gate[here], model["w"])
        p = _refined(1 / (1 + np.exp(-np.clip(logit, -30, 30))), logit, gate[here], model["map"])
        out += np.bincount(row[here], np.log10(np.where(y[here] == 1, p, 1 - p)), rows)
    return out


def score_units(models: DataFrame, mixing: dict) -> DataFrame:
    """(kind, z, word, c, blocks, lp): lp is the log10 probability of the word in the class."""
    names = ["kind", "z", "word", "c", "blocks"]

    def score(units: pa.RecordBatch, whole: bytes, other: bytes) -> np.ndarray:
        asked, code, lp = _asked(units), mixing["code"], np.zeros(units.num_rows)
        keys = asked["keys"]
        decisions = int(code["size"][(keys & np.uint64(255)).astype(np.int64)].sum())
        inputs = _key_inputs(code, keys, _counts(whole, len(keys)).astype(np.int64), _counts(other, decisions).astype(np.int64), False)
        for i in range(0, len(asked["byte"]), MIX_BYTES):
            lp += _log_mix(mixing, *_byte_inputs(code, asked, inputs, i, i + MIX_BYTES), units.num_rows)
        return lp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                units = _one_batch(_units_of(row))
                lp = score(units, row["whole"], row["other"])
                yield pa.RecordBatch.from_arrays([*[units.column(units.schema.names.index(c)) for c in names], pa.array(lp)], names=[*names, "lp"])

    return models.select("units", "whole", "other").mapInArrow(run, "kind byte, z byte, word binary, c bigint, blocks array<int>, lp double")


DEALT = "block int, h binary, c binary, lp binary, space binary, size binary, space_lp binary"


def _deal(scored: pa.RecordBatch) -> pa.RecordBatch:
    """A packed row for each block that holds some of the words: hash, count and lp of (word, class), and white space with its lp."""
    kind, z, word, c, blocks, lp = (scored.column(scored.schema.names.index(x)) for x in ("kind", "z", "word", "c", "blocks", "lp"))
    kind, c, lp = kind.to_numpy(), c.to_numpy(), lp.to_numpy()
    h = _hashes(word) + z.to_numpy().astype(np.uint64)
    block = blocks.flatten().to_numpy()
    order = np.argsort(block, kind="stable")
    row, block = np.repeat(np.arange(len(kind)), pc.list_value_length(blocks).to_numpy())[order], block[order]
    use, plain = block[_heads(block)], kind[row] == 0
    ends = [np.append(np.searchsorted(block[x], use), x.sum()) for x in (plain, ~plain)]
    plain, space = row[plain], row[~plain]
    data, offs = string_bytes(word.take(pa.array(space)))
    return pa.RecordBatch.from_arrays(
        [pa.array(use, pa.int32()), *[_slices(x[plain], ends[0]) for x in (h, c, lp)], _slices(data, offs[ends[1]]),
         _slices(np.diff(offs).astype(np.int32), ends[1]), _slices(lp[space], ends[1])], names=[c.split()[0] for c in DEALT.split(", ")])


def deal_scores(scored: DataFrame) -> DataFrame:
    """(kind, z, word, c, blocks, lp) dealt to the blocks of texts: ``DEALT``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, DEALT_WORDS):
            yield _deal(batch)

    return scored.mapInArrow(run, DEALT)


def _block_scores(docs: pa.Table, words: pa.Table, centres: np.ndarray, class_lp: np.ndarray, n_train: int, n_types: int, n_ends: int) -> pa.Table:
    """Scores of a block's texts from the probabilities and counts of its words."""
    h, c, lp = (_joined(words[x], d) for x, d in (("h", np.uint64), ("c", np.int64), ("lp", np.float64)))
    order = np.argsort(h)
    h, c, lp = h[order], c[order], lp[order]
    space = _binaries(_joined(words["space"]), _joined(words["size"], np.int32))
    space_lp = dict(zip(space.to_pylist(), _joined(words["space_lp"], np.float64).tolist()))
    after = np.array([space_lp.get(_space_after(b), 0.0) for b in range(256)])
    base_of = lambda n: np.log10((n + 0.5) / (n_train + 0.5 * (n_types + 1)))
    n = docs.num_rows
    tokens, known, base, score = np.ones(n, np.int64), np.full(n, n_ends > 0, np.int64), np.full(n, base_of(n_ends)), np.zeros(n)
    n_bytes = np.zeros(n, np.int64)
    for first, rows, data, offs in chunks(docs["text"]):
        data = lower_table()[data]
        z = classes_of(centres, data, offs)
        s, e, row, single, tails = _pieces(data, offs)
        here = slice(first, first + rows)
        n_bytes[here] = np.diff(offs)
        score[here] += class_lp[z]
        if len(s):
            want = span_hash(prefix_hash(data), s, e) + z[row].astype(np.uint64)
            near = np.argsort(want)  # sorted look-ups stay in the cache
            at = np.empty(len(want), np.int64)
            at[near] = np.searchsorted(h, want[near])
            tokens[here] += np.bincount(row, minlength=rows)
            known[here] += np.bincount(row, c[at] > 0, rows).astype(np.int64)
            base[here] += np.bincount(row, base_of(c[at]), rows)
            score[here] += np.bincount(row, lp[at], rows)
        score[here] += np.bincount(single[0], after[single[1]], rows)
        for r, key in tails:
            score[first + r] += space_lp[key]
    bits = np.where(n_bytes > 0, -score * np.log2(10) / np.maximum(n_bytes, 1), 0)
    return pa.table({"doc_id": docs["d"], "held_out": docs["held"], "n_tokens": tokens, "n_known": known,
                     "train_tokens": np.full(n, n_train), "base_score": base, "score": score, "bits_per_byte": bits})


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """Learn from the texts outside the held-out fold and score all: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (unigram), score (log10 probability), bits_per_byte."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, -(-text_bytes(docs, text) // BLOCK_BYTES))
    rows = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold(F.col(doc), folds) == held_out).alias("held"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("d", "text"), F.lit(blocks)).cast("int"))
    centres = fit_classes(rows.where(~F.col("held")).select("text"))

    def words(t: pa.Table) -> pa.Table:
        return _block_words(t, centres, blocks)

    found = rows.select("block", "text", "held").groupBy("block").applyInArrow(words, PACKED)
    vocab = materialise(found.groupBy("part").applyInArrow(_part_words, VOCABULARY), "vocabulary")
    ends = docs.where(fold(F.col(doc), folds) != held_out).count()
    trained = F.expr("kind = 0 AND new AND c > 0")
    sums = vocab.agg(F.coalesce(F.sum(F.when(trained, F.col("c"))), F.lit(0)).alias("n"), F.count_if(trained).alias("v"),
                     F.count_if(F.col("kind") < 2).alias("units")).first()
    n_train, n_types, n_units = sums["n"] + ends, sums["v"] + (1 if ends else 0), sums["units"]
    class_n, byte_n = np.zeros(CLASSES), np.zeros(256)
    for r in vocab.where("kind >= 2").select("kind", "word", "c").collect():  # at most one row per class and byte
        (class_n if r["kind"] == 2 else byte_n)[r["word"][0]] = r["c"]
    class_lp = np.log10((class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES))
    code = byte_code(byte_n)
    model_blocks = max(1, -(-n_units // UNITS), min(12, n_units // 5_000))
    shards = max(1, -(-n_units * KEYS_OF_UNIT // SHARD_KEYS), min(12, model_blocks))
    units = vocab.where("kind < 2").select(F.pmod(F.xxhash64("kind", "word"), F.lit(model_blocks)).cast("int").alias("mb"),
                                           "kind", "z", "word", "c", "cz", "blocks")
    models = materialise(learn_blocks(units, shards, code), "models")
    scored = materialise(score_units(models, mean_mixing(models, code)), "scored")
    kind = docs.schema[doc].dataType.simpleString()

    def score(t: pa.Table, w: pa.Table) -> pa.Table:
        return _block_scores(t, w, centres, class_lp, n_train, n_types, ends)

    return rows.groupBy("block").cogroup(deal_scores(scored).groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
               "base_score double, score double, bits_per_byte double")
