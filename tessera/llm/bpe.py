"""Byte-level BPE encoding and decoding.

Method: bytes are mapped to Latin-1 so that an Aho-Corasick automaton
(pyahocorasick) over the vocabulary finds, for every position, the longest
token that starts there.  Encoding walks forward with longest matches and
backtracks to shorter ones where two neighbours could not stay unmerged under
the merge ranks.  Whether two tokens can be neighbours is memoised, as are the
parts between spaces, so each distinct part is cut and encoded once per task.
The result equals merging the lowest rank first, in time linear in the piece.

Rows: a null text counts as empty; an empty text has no ids.  Ties, repeated
rows and further columns pass through.  ``token_ids`` and ``decoded`` replace
input columns of the same names.  A piece that is a whole token is that token,
as in the tiktoken library.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.textops import chunks

# Parts and pieces remembered by a task: two generations of so many; what is used again moves to the new one.
PIECE_MEMORY = 150_000
PAIR_MEMORY = 2_000_000
# Fixed value: a pattern under which a text may be cut in front of every single space
# (a space either starts a piece or is a piece).  Only a space between two white-space
# characters, or between one and the end, belongs to a run that must stay whole.
SPACE_CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHOLE_RUN = r"\s (\s|$)"


def read_ranks(path: str) -> bytes:
    """The rank file as it is: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in raw.splitlines() if line)}


def merge(ranks: dict[bytes, int], piece: bytes, below: float = float("inf")) -> list[bytes]:
    """Plain merging, lowest rank first, with ranks under ``below``."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def token_tables(ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """For each rank: ``left`` and ``right``, the tokens whose merge makes it (-1: a single byte; -2: no
    merge reaches it), and ``shorter``, the longest reachable token that is a proper prefix (-1: none)."""
    n = max(ranks.values(), default=-1) + 1
    out = {k: [-1] * n for k in ("left", "right", "shorter")}
    for tok, rank in ranks.items():
        if len(tok) > 1:
            parts = merge(ranks, tok, rank)
            whole = len(parts) == 2
            out["left"][rank], out["right"][rank] = (ranks[parts[0]], ranks[parts[1]]) if whole else (-2, -2)
    for tok, rank in ranks.items():
        for k in range(len(tok) - 1, 0, -1):
            r = ranks.get(tok[:k])
            if r is not None and out["left"][r] != -2:
                out["shorter"][rank] = r
                break
    return out


class BacktrackingEncoder:
    """Exact BPE for single pieces by longest match and backtracking."""

    def __init__(self, ranks: dict[bytes, int], tables: dict[str, list[int]] | None = None):
        import ahocorasick

        self.ranks = ranks
        self.tables = tables or token_tables(ranks)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.sizes = [len(self.bytes_of.get(r, b"")) for r in range(len(self.tables["left"]))]
        self.automaton = ahocorasick.Automaton()
        for tok, rank in ranks.items():
            if self.tables["left"][rank] != -2:
                self.automaton.add_word(tok.decode("latin-1"), (len(tok) - 1, rank))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """True if merging by rank would leave these two tokens as neighbours.

        The last merges inside both are undone step by step, the later one
        first.  At each step the two parts that touch must not form a token of
        a rank lower than what was merged later, else that merge came first.
        """
        before, after, bytes_of = self.tables["left"], self.tables["right"], self.bytes_of
        a, b, limit, ok = left, right, float("inf"), True
        while True:
            joined = self.ranks.get(bytes_of[a] + bytes_of[b])
            if joined is not None and joined < limit:
                ok = False
                break
            if after[a] < 0 and before[b] < 0:
                break
            if before[b] < 0 or (after[a] >= 0 and a > b):
                limit, a = a, after[a]  # a merge of equal rank further left came first
            else:
                limit, b = b + 1, before[b]
        if len(self._fits) >= PAIR_MEMORY:
            self._fits.clear()
        self._fits[left * len(self.sizes) + right] = ok
        return ok

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, shorter, known, span = len(piece), self.sizes, self.tables["shorter"], self._fits.get, len(self.sizes)
        longest = [-1] * n
        for end, (back, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # ends come in order, so the longest stays
        if -1 in longest and any(self.ranks.get(piece[i:i + 1]) is None for i in range(n)):
            raise ValueError("the vocabulary lacks a byte of this piece")
        out: list[int] = []
        dead: set[int] = set()
        pos, last, token = 0, -1, longest[0]
        while True:
            ok = last < 0 or known(last * span + token)
            if ok is None:
                ok = self.fits(last, token)
            end = pos + sizes[token]
            if ok and end not in dead:
                out.append(token)
                if end == n:
                    return out
                pos, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: shorten the token before
                dead.add(pos)
                token = out.pop()
                pos -= sizes[token]
                last = out[-1] if out else -1
                token = shorter[token]


class Memory:
    """Results by text, of bounded size: when the new generation is full it becomes the old one."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value

    def again(self, key: str) -> bytes | None:
        value = self.old.get(key)
        return value if value is None else self.keep(key, value)


def _with_columns(batch: pa.RecordBatch, first: int, rows: int, name: str, values: pa.Array) -> pa.RecordBatch:
    part = batch.slice(first, rows)
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [values],
                                      names=[batch.schema.names[i] for i in keep] + [name])


def _replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (array<int>): every match of ``pattern`` encoded by itself, without special tokens."""
    raw = read_ranks(vocab_path)
    sent = docs.sparkSession.sparkContext.broadcast((raw, token_tables(parse_ranks(raw))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder = BacktrackingEncoder(parse_ranks(sent.value[0]), sent.value[1])
        pieces = regex.compile(pattern).findall
        whole_run = regex.compile(WHOLE_RUN).search
        parts, by_piece = Memory(PIECE_MEMORY), Memory(PIECE_MEMORY)

        def encode_piece(piece: str) -> bytes:
            code = by_piece.again(piece)
            return code or by_piece.keep(piece, array("i", encoder.encode(piece.encode("utf-8"))).tobytes())

        def encode_part(part: str) -> bytes:
            known = by_piece.new.get
            return b"".join([known(p) or encode_piece(p) for p in pieces(part)])

        def encode_spaced(part: str) -> bytes:  # parts that follow a space, without it
            return parts.again(part) or parts.keep(part, encode_part(" " + part))

        def encode_text(content: str) -> bytes:
            if pattern != SPACE_CUT_PATTERN or whole_run(content):
                return encode_part(content)
            first, *rest = content.split(" ")
            out = [encode_part(first)]
            for p in rest:
                out.append(parts.new.get(p) or encode_spaced(p))
            return b"".join(out)

        for batch in batches:
            col = batch.column(batch.schema.names.index(text))
            for first, rows, data, offs in chunks(col, 1 << 20):
                buf = data.tobytes()
                ids, bounds = [], [0]
                for i in range(rows):
                    row = encode_text(buf[offs[i]:offs[i + 1]].decode("utf-8"))
                    ids.append(row)
                    bounds.append(bounds[-1] + len(row) // 4)
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield _with_columns(batch, first, rows, "token_ids",
                                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)))

    return docs.mapInArrow(run, _replaced(docs.schema, "token_ids", T.ArrayType(T.IntegerType())))


def decode_documents(docs: DataFrame, vocab_path: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the tokens, joined.  A null list decodes to no bytes."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = parse_ranks(raw.value)
        size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for tok, r in ranks.items():
            size[r] = len(tok)
        place = np.concatenate([[0], np.cumsum(size)])
        table = np.zeros(int(place[-1]), np.uint8)
        for tok, r in ranks.items():
            table[place[r]:place[r] + len(tok)] = np.frombuffer(tok, np.uint8)
        place = place[:-1]
        for batch in batches:
            col = batch.column(batch.schema.names.index(ids))
            counts = np.array([0 if v is None else v for v in pa.compute.list_value_length(col).to_pylist()], np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            i, n = 0, len(counts)
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 18), side="right")) - 1))
                part = flat[bounds[i]:bounds[j]]
                lens = size[part]
                ends = np.concatenate([[0], np.cumsum(lens)])
                out = table[np.repeat(place[part] - ends[:-1], lens) + np.arange(ends[-1])]
                offs = ends[bounds[i:j + 1] - bounds[i]].astype(np.int32)
                values = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(out.tobytes())])
                yield _with_columns(batch, i, j - i, "decoded", values)
                i = j

    return docs.mapInArrow(run, _replaced(docs.schema, "decoded", T.BinaryType()))
