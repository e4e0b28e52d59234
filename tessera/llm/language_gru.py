"""Language identification by a bidirectional gated recurrent network over bytes.

Method: a text's bytes are cut into segments of ``SEGMENT``; one gated recurrent
unit reads each segment forwards, another backwards, both from a zero state.  The
two states at a byte give the probabilities of the languages there (every position
is labelled); a text's probabilities are the mean over all positions that belong
to a letter.  The network is trained in numpy by backpropagation through time with
Adam, on a bounded sample: at most ``PER_LANG`` rows of each language outside the
held-out fold, of each one slice of ``SLICE`` characters at a place chosen by hash.

What runs at scale: one aggregate counts the rows of each language, one filter
takes the sample; scoring scans the documents, ``BATCH`` segments at a time, so
its memory does not follow the length of a text.  The model (some 10 kB, plus a few
numbers for each language) is broadcast.  The driver holds the sample: ``PER_LANG *
SLICE`` characters for each language that occurs.

The prediction depends on the text alone.  Rows: a text that is null or has no
letter (``\\p{L}``) gets ``und`` and score 0; so does every row if there is no
labelled text with a letter.  All segments of very long texts count.  Ties between
languages go to the first by name.  Repeated rows score alike; an empty table gives
no rows.  ``lang_pred score`` replace input columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.sampling import fold
from tessera.llm.textops import chunks, string_bytes

HIDDEN, SEGMENT, BATCH = 8, 64, 2048
PAD = 256
PER_LANG, SLICE = 400, 2048
STEPS, TRAIN_BATCH, RATE = 350, 128, 0.012
UNKNOWN = "und"
LETTER = r"\p{L}"
ADDED = ("lang_pred", "score")


def letter_table() -> np.ndarray:
    """True for bytes of ASCII letters and of characters beyond ASCII."""
    t = np.zeros(PAD + 1, bool)
    t[65:91] = t[97:123] = t[128:256] = True
    return t


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, one a column, padded behind; and the row of each."""
    per_row = -(-np.diff(offs) // SEGMENT)
    row = np.repeat(np.arange(len(per_row)), per_row)
    start = offs[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)) * SEGMENT
    at = start[None, :] + np.arange(SEGMENT)[:, None]
    inside = at < offs[1:][row][None, :]
    x = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.intp)
    x[~inside] = PAD
    return x, row


class Network:
    """Parameters by direction: ``table`` (byte to gate inputs), ``gates`` (state to reset and update gates), ``cand``
    (gated state to candidate), ``out`` (state to language), and ``bias``."""

    def __init__(self, langs: int, seed: int = 11):
        r = np.random.default_rng(seed)
        h = HIDDEN
        f = np.float32
        self.table = r.normal(0, 0.4, (2, PAD + 1, 3 * h)).astype(f)
        self.gates = r.normal(0, h**-0.5, (2, 2 * h, h)).astype(f)
        self.cand = r.normal(0, h**-0.5, (2, h, h)).astype(f)
        self.out = r.normal(0, h**-0.5, (2, langs, h)).astype(f)
        self.bias = np.zeros((langs, 1), f)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.cand, self.out, self.bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Log-odds (position, language, segment) and what the way back needs."""
        steps, n = x.shape
        h = HIDDEN
        z = np.zeros((steps, len(self.bias), n), self.bias.dtype) + self.bias
        kept = []
        for d in (0, 1):
            state = np.zeros((h, n), self.bias.dtype)
            for t in (range(steps) if d == 0 else range(steps - 1, -1, -1)):
                g = self.table[d][x[t]].T
                s = 1 / (1 + np.exp(-(self.gates[d] @ state + g[:2 * h])))
                q = s[:h] * state
                c = np.tanh(self.cand[d] @ q + g[2 * h:])
                new = c + s[h:] * (state - c)
                kept.append((d, t, state, s, q, c, new))
                state = new
                z[t] += self.out[d] @ new
        return z, kept

    def backward(self, x: np.ndarray, dz: np.ndarray, kept: list) -> list[np.ndarray]:
        """Gradients of the parameters from those of the log-odds, back through time."""
        h, grads = HIDDEN, [np.zeros_like(p) for p in self.params()]
        table, gates, cand, out, bias = grads
        bias += dz.sum((0, 2))[:, None]
        last, carry = None, None
        for d, t, state, s, q, c, new in reversed(kept):
            if d != last:
                last, carry = d, np.zeros_like(state)
            dh = self.out[d].T @ dz[t] + carry
            out[d] += dz[t] @ new.T
            r, u = s[:h], s[h:]
            dc = dh * (1 - u) * (1 - c * c)
            dq = self.cand[d].T @ dc
            ds = np.concatenate([dq * state, dh * (state - c)]) * s * (1 - s)
            cand[d] += dc @ q.T
            gates[d] += ds @ state.T
            carry = dh * u + dq * r + self.gates[d].T @ ds
            np.add.at(table[d], x[t], np.concatenate([ds, dc]).T)
        return grads

    def compiled(self) -> dict:
        """The parameters with the gates halved: a logistic is a tanh of half its input."""
        half = np.ones(3 * HIDDEN, np.float32)
        half[:2 * HIDDEN] = 0.5
        return {"table": np.ascontiguousarray(self.table * half), "gates": self.gates * np.float32(0.5), "cand": self.cand * np.float32(0.5),
                "out": self.out, "bias": self.bias}


def softmax(z: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(z - z.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds (position, language, segment) of the compiled network."""
    steps, n = x.shape
    h, f = HIDDEN, np.float32
    z = np.empty((steps, len(model["bias"]), n), f)
    z[:] = model["bias"]
    g, s, c, q = np.empty((n, 3 * h), f), np.empty((2 * h, n), f), np.empty((h, n), f), np.empty((h, n), f)
    for d in (0, 1):
        table, gates, cand, out = (model[k][d] for k in ("table", "gates", "cand", "out"))
        state = np.zeros((h, n), f)
        for t in (range(steps) if d == 0 else range(steps - 1, -1, -1)):
            np.take(table, x[t], axis=0, out=g, mode="clip")
            np.matmul(gates, state, out=s)
            s += g.T[:2 * h]
            np.tanh(s, out=s)
            np.multiply(s[:h], state, out=q)
            q += state  # twice the reset gate times the state; ``cand`` is halved
            np.matmul(cand, q, out=c)
            c += g.T[2 * h:]
            np.tanh(c, out=c)
            state -= c
            u = s[h:]
            u += 1
            u *= f(0.5)
            state *= u
            state += c
            z[t] += out @ state
    return z


def position_probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at every position (position, language, segment)."""
    return softmax(log_odds(model, x), 1)


def pooled(model: dict, col: pa.Array) -> np.ndarray:
    """Mean probabilities over the letter positions of every text (zeros for texts without any)."""
    langs, letters = len(model["bias"]), letter_table()
    total, count = np.zeros((len(col), langs)), np.zeros(len(col))
    for first, _, data, offs in chunks(col, SEGMENT * BATCH):
        x, row = segments(data, offs)
        for i in range(0, len(row), BATCH):
            part, r = x[:, i:i + BATCH], row[i:i + BATCH] + first
            use = letters[part]
            p = (position_probabilities(model, part) * use[:, None, :]).sum(0, dtype=np.float64)
            for k in range(langs):
                total[:, k] += np.bincount(r, p[k], len(col))
            count += np.bincount(r, use.sum(0), len(col))
    return total / np.maximum(count, 1)[:, None]


def fit(texts: list[str], langs: list[str], steps: int = STEPS) -> dict | None:
    """Train on texts with their languages; None without a text that has a letter."""
    names = sorted(set(langs))
    data, offs = string_bytes(pa.array(texts, pa.string()))
    x, row = segments(data, offs)
    letters = letter_table()
    use = letters[x].any(0)
    x, y = x[:, use], np.array([names.index(v) for v in langs], np.int64)[row[use]]
    if not len(y):
        return None
    net, rng = Network(len(names)), np.random.default_rng(7)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    by_lang = [np.flatnonzero(y == k) for k in range(len(names))]
    by_lang = [b for b in by_lang if len(b)]
    each = max(1, TRAIN_BATCH // len(by_lang))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, each) for b in by_lang])  # languages weigh alike
        part = x[:, pick]
        z, kept = net.forward(part)
        mask = letters[part][:, None, :]
        dz = softmax(z, 1)
        dz[np.arange(SEGMENT)[:, None], y[pick][None, :], np.arange(len(pick))[None, :]] -= 1
        dz *= mask / mask.sum()
        grads = net.backward(part, dz.astype(np.float32), kept)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, (m, v) in zip(net.params(), grads, moments):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {**net.compiled(), "langs": names}


def labelled_slices(docs: DataFrame, lang: str = "lang", folds: int = 3, held_out: int = 1, doc: str = "doc_id", text: str = "text") -> pa.Table:
    """At most ``PER_LANG`` slices of each language outside the held-out fold, as (t, y); copies of a slice are learnt once.

    Rows are taken by a hash of id and text: the choice is the same in every run.  A language's share of rows
    follows its count, so what the last step sorts is bounded by some ``4 * PER_LANG`` rows a language.
    """
    t, y = F.col(text), F.col(lang).cast("string")
    known = docs.where(y.isNotNull() & t.rlike(LETTER) & (fold(F.col(doc), folds) != held_out)).select(
        y.alias("y"), F.pmod(F.xxhash64(F.col(doc), t), F.lit(1 << 30)).alias("h"), t.alias("t"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pa.table({"t": pa.array([], pa.string()), "y": pa.array([], pa.string())})
    limits = known.sparkSession.createDataFrame([(k, int(min(1.0, 4 * PER_LANG / n) * (1 << 30))) for k, n in counts.items()], "y string, limit long")
    at = (1 + F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.char_length("t") - SLICE + 1))).cast("int")
    cut = (known.join(F.broadcast(limits), "y").where(F.col("h") < F.col("limit"))
           .select("y", "h", F.substring("t", at, F.lit(SLICE)).alias("t")).groupBy("y", "t").agg(F.min("h").alias("h")))
    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))).where(F.col("k") <= PER_LANG)
    return ranked.orderBy("y", "k").select("t", "y").toArrow()


def train(docs: DataFrame, lang: str = "lang", folds: int = 3, held_out: int = 1, doc: str = "doc_id", text: str = "text") -> dict | None:
    sample = labelled_slices(docs, lang, folds, held_out, doc, text)
    return fit(sample["t"].to_pylist(), sample["y"].to_pylist())


def identify(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the pooled probability of that language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ADDED]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            lettered = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if m is not None:
                p = pooled(m, batch.column(batch.num_columns - 1))
                top = p.argmax(1)
                best = np.where(lettered, np.array(m["langs"], object)[top], UNKNOWN)
                score = np.where(lettered, np.clip(p[np.arange(n), top], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                             names=schema.names)

    inputs = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    t = F.col(f"`{text}`")
    return docs.select(*inputs, F.coalesce(t.rlike(LETTER), F.lit(False)).alias("l"), t.alias("t")).mapInArrow(run, schema)
