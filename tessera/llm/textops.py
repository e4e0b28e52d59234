"""Numpy helpers over the bytes of Arrow text columns.

All functions work on runs of whole rows of about ``CHUNK_BYTES`` bytes, so
their scratch arrays stay small whatever the batch size.  A longer row is a
run of its own.  Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 17  # scratch arrays of about 1 MB, which stay in a core's cache
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# The white space that separates words (space, \t \n \v \f \r).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(SPACE_BYTES)] = True
    return t


def non_alnum_table() -> np.ndarray:
    """True for ASCII bytes that are no letter or digit (bytes of non-ASCII characters count as letters)."""
    t = np.zeros(256, bool)
    for b in range(128):
        t[b] = not chr(b).isalnum()
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def string_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its row offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
        col = pc.fill_null(col, b"" if binary else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(col, target: int = CHUNK_BYTES):
    """Yield ``(first row, rows, bytes, offsets from 0)`` for runs of whole rows."""
    data, offs = string_bytes(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + target, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j - i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    if _powers["n"] < n:
        n = max(n, CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(z: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix64 finaliser)."""
    z = z ^ (z >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``P`` with ``(P[e] - P[s]) * down[s]`` the polynomial hash of bytes s..e."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of every row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    word = ~sep[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first] |= word[first]
    end[last] |= word[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.diff(np.searchsorted(s, offs))


def word_hashes(data: np.ndarray, offs: np.ndarray, sep: np.ndarray, fold: np.ndarray | None = None):
    """64-bit hash of every word and the number of words of every row; ``fold`` maps bytes first."""
    if fold is not None:
        data = fold[data]
    s, e, per_row = word_spans(data, offs, sep)
    if not len(s):
        return np.zeros(0, np.uint64), per_row
    return span_hash(prefix_hash(data), s, e), per_row


def shingles(words: np.ndarray, per_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, and their number in every row (0 under k words)."""
    counts = np.maximum(per_row - k + 1, 0)
    if len(words) < k or not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(len(per_row), np.int64)
    m = len(words) - k + 1
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = h * _BASE + words[j:j + m]
    row = np.repeat(np.arange(len(per_row)), per_row)
    return mix(h[row[:m] == row[k - 1:]]), counts


def permutation_constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1),
            rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
