"""Toxicity by a convolutional text classifier.

Method: words are hashed into an embedding table, each by itself and by its
first bytes (``PREFIXES``), and the rows are summed; slots that fewer
than ``MIN_TEXTS`` training texts use stay zero.  Filters of several widths run
over the word embeddings; each filter keeps its maximum over the text; a
logistic layer scores the maxima.  The network is trained in numpy on a bounded
sample of labelled rows (``PER_CLASS`` for each label, texts up to
``MAX_BYTES``).  For scoring, each filter tap is multiplied into the embedding
table once, so a filter is a sum of table rows and documents are only scanned.

The score depends on the text alone.  Thresholds are calibrated by language on
all labelled rows outside the held-out fold, at their own label ratio: the
lowest score at which at least ``PRECISION`` of the rows above it are toxic;
they only serve the columns ``threshold`` and ``flagged``.

Words are runs of letters and digits, lower-cased.  Rows: a null or empty
text has no word and scores the filters on padding.  Repeated rows score
alike; an empty table gives no rows; without labelled rows of both kinds every
score is 0.5.  ``score threshold flagged`` replace input columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.sampling import fold, labelled, labelled_sample
from tessera.llm.textops import chunks, mix, non_alnum_table, prefix_hash, span_hash, word_spans

BUCKETS = 1 << 14
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
PREFIXES = (4, 5, 7)
MIN_TEXTS = 4
PER_CLASS, MAX_BYTES = 2500, 32_768
PIECE_BYTES = 1 << 18
EPOCHS, BATCH, RATE = 7, 48, 0.08
# Toxic rows weigh as much as the others together, up to this factor.
MAX_WEIGHT = 6.0
PRECISION = 0.98
BINS = 200


def padded_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding slots of all words (one column for the word and each prefix), each text
    followed by padding (slot 0), and the starts of the texts."""
    pad = max(WIDTHS)
    s, e, per_row = word_spans(data, offs, non_alnum_table())
    starts = np.cumsum(per_row + pad) - (per_row + pad)
    ids = np.zeros((len(s) + pad * len(per_row), 1 + len(PREFIXES)), np.int32)
    if len(s):
        at = np.arange(len(s)) + np.repeat(np.arange(len(per_row)) * pad, per_row)
        prefix = prefix_hash(data)
        for k, n in enumerate((None, *PREFIXES)):
            h = span_hash(prefix, s, e if n is None else np.minimum(e, s + n))
            ids[at, k] = (mix(h + np.uint64(k)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return ids, starts


def _positions(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """First positions of the windows of every text, as segments of 0..n: windows that reach over
    into the next text are masked by the caller's minimum."""
    ok = np.ones(n, bool)
    ends = np.append(starts[1:], n)
    for k in range(1, width):
        ok[ends - k] = False
    return ok


class Network:
    def __init__(self, live: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.live = live  # slots that may leave zero
        self.emb = r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.emb[~live] = 0
        self.taps = [r.normal(0, (1 / (DIM * w)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        # Output weights stay at or above zero: a filter is evidence of toxicity or nothing.
        self.out = np.abs(r.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32)
        self.out_bias = np.full(1, -2, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.taps, *self.bias, self.out, self.out_bias]

    def step(self, ids, starts, y, weight, state) -> float:
        """One Adagrad step on a batch; returns the loss."""
        n, b = len(ids), len(starts)
        ends = np.append(starts[1:], n)
        x = self.emb[ids].sum(1)
        tops, where = [], []
        for w, taps, bias in zip(WIDTHS, self.taps, self.bias):
            z = np.full((n, FILTERS), -np.inf, np.float32)
            m = n - w + 1
            z[:m] = x[:m] @ taps[0] + bias
            for k in range(1, w):
                z[:m] += x[k:m + k] @ taps[k]
            z[~_positions(n, starts, w)] = -np.inf
            at = np.stack([s + z[s:e].argmax(0) for s, e in zip(starts, ends)])
            where.append(at)
            tops.append(z[at, np.arange(FILTERS)[None, :]])
        act = np.maximum(np.concatenate(tops, 1), 0)
        p = 1 / (1 + np.exp(-(act @ self.out + self.out_bias[0])))
        g = ((p - y) * weight / b).astype(np.float32)
        grads = {id(self.out): act.T @ g + 1e-4 * self.out, id(self.out_bias): np.array([g.sum()], np.float32)}
        ga = np.outer(g, self.out) * (act > 0)
        touched, updates = [], []
        for i, (w, taps) in enumerate(zip(WIDTHS, self.taps)):
            gf = ga[:, i * FILTERS:(i + 1) * FILTERS]
            gt = np.zeros_like(taps)
            for k in range(w):
                gt[k] = np.einsum("bf,bfd->df", gf, x[where[i] + k])
                part = (gf[:, :, None] * taps[k].T[None]).reshape(-1, DIM)
                for j in range(ids.shape[1]):
                    touched.append(ids[where[i] + k, j].ravel())
                    updates.append(part)
            grads[id(taps)] = gt + 1e-4 * taps
            grads[id(self.bias[i])] = gf.sum(0)
        rows, inv = np.unique(np.concatenate(touched), return_inverse=True)
        ge = np.zeros((len(rows), DIM), np.float32)
        np.add.at(ge, inv, np.concatenate(updates))
        keep = self.live[rows]
        rows, ge = rows[keep], ge[keep]
        state[0][rows] += ge * ge
        self.emb[rows] -= RATE * ge / np.sqrt(state[0][rows] + 1e-8)
        for a, s in zip(self.params()[1:], state[1:]):
            gr = grads[id(a)].reshape(a.shape)
            s += gr * gr
            a -= RATE * gr / np.sqrt(s + 1e-8)
        np.maximum(self.out, 0, out=self.out)
        return float(-(weight * np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).mean())

    def compiled(self) -> dict:
        """The embedding table times every tap, side by side, and the output layer."""
        return {"table": np.concatenate([self.emb @ t for taps in self.taps for t in taps], 1).astype(np.float32), "bias": self.bias, "out": self.out, "out_bias": float(self.out_bias[0])}


def score_ids(model: dict, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n, tops, tap = len(ids), [], 0
    word = model["table"][ids[:, 0]]
    for j in range(1, ids.shape[1]):
        word += model["table"][ids[:, j]]
    for w, bias in zip(WIDTHS, model["bias"]):
        m = n - w + 1
        z = np.full((n, FILTERS), -np.inf, np.float32)
        z[:m] = word[:m, tap:tap + FILTERS]
        for k in range(1, w):
            z[:m] += word[k:m + k, tap + k * FILTERS:tap + (k + 1) * FILTERS]
        tap += w * FILTERS
        z[~_positions(n, starts, w)] = -np.inf
        tops.append(np.maximum(np.maximum.reduceat(z, starts, axis=0) + bias, 0))
    return 1 / (1 + np.exp(-(np.concatenate(tops, 1) @ model["out"] + model["out_bias"]).astype(np.float64)))


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS) -> dict | None:
    """Train on texts with labels 0 and 1; None unless both occur."""
    y = np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rows = []
    for _, _, data, offs in chunks(pc.utf8_lower(pa.array(texts, pa.string()))):
        ids, starts = padded_ids(data, offs)
        rows += np.split(ids, starts[1:])
    texts_with = np.zeros(BUCKETS, np.int64)
    for r in rows:
        texts_with[np.unique(r)] += 1
    live = texts_with >= MIN_TEXTS
    live[0] = False
    weight = np.where(y > 0, np.float32(min(MAX_WEIGHT, max(1.0, (1 - y).sum() / y.sum()))), np.float32(1))
    net, rng = Network(live), np.random.default_rng(3)
    state = [np.zeros_like(a) for a in net.params()]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            starts = np.cumsum([0] + [len(rows[j]) for j in pick])[:-1]
            net.step(np.concatenate([rows[j] for j in pick]), starts, y[pick], weight[pick], state)
    return net.compiled()


def score_texts(model: dict | None, col: pa.Array) -> np.ndarray:
    out = np.full(len(col), 0.5)
    if model is not None:
        for first, rows, data, offs in chunks(pc.utf8_lower(col), PIECE_BYTES):
            out[first:first + rows] = score_ids(model, *padded_ids(data, offs))
    return out


def thresholds(rows: DataFrame, precision: float = PRECISION) -> dict:
    """Per language, the lowest score at which the rows above are toxic at the wanted precision; key None: all.

    From all of (lang, score, y), by counts per language and score bin (``BINS`` for
    each unit of the logit); a threshold lies between two bins.
    """
    p = F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    bins = (rows.groupBy("lang", F.floor(F.log(p / (1 - p)) * BINS).alias("bin"))
            .agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.sum("y").alias("toxic")).toArrow())
    langs = np.array(bins["lang"].to_pylist(), object)
    bin_, low, high, n, toxic = (bins[c].to_numpy() for c in ("bin", "low", "high", "n", "toxic"))
    out = {}
    for lang in [None, *sorted({x for x in langs if x is not None})]:
        pick = np.ones(len(langs), bool) if lang is None else langs == lang
        if not toxic[pick].sum():
            continue
        at, inv = np.unique(-bin_[pick], return_inverse=True)  # highest bin first
        bottom, top = np.full(len(at), np.inf), np.zeros(len(at))
        np.minimum.at(bottom, inv, low[pick])
        np.maximum.at(top, inv, high[pick])
        good = np.cumsum(np.bincount(inv, toxic[pick])) >= precision * np.cumsum(np.bincount(inv, n[pick]))
        if good.any():
            k = np.flatnonzero(good)[-1]
            out[lang] = float((bottom[k] + (top[k + 1] if k + 1 < len(at) else 0.0)) / 2)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", lang: str | None = "lang", folds: int = 3, held_out: int = 1,
          doc: str = "doc_id", text: str = "text") -> tuple[dict | None, dict]:
    """The network, and the thresholds by language from all labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, PER_CLASS, MAX_BYTES, folds, held_out, doc, text)
    model = fit(sample["t"].to_pylist(), np.array(sample["y"].to_pylist(), np.float32))
    if not lang or model is None:
        return model, {}
    known = labelled(labels, label, folds, held_out, doc).select(F.col("k").alias("known_id"), "y")
    rows = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull() & (fold(F.col(doc), folds) != held_out)).select(
        F.col(doc).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    scored = score(rows, model, keep=["id", "lang"]).select("id", "lang", "score")
    return model, thresholds(scored.join(known, F.col("id") == F.col("known_id")).select("lang", "score", "y"))


def score(docs: DataFrame, model: dict | None, cut: dict | None = None, text: str = "text", lang: str = "lang",
          keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, ``threshold`` (of the row's language, else of all) and ``flagged``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "threshold", "flagged")]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            s = score_texts(sent.value, batch.column(at[text]))
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in names], pa.array(s, pa.float64())], names=[*names, "score"])

    needed = [F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]
    out = docs.select(*needed).mapInArrow(run, schema)
    limit = F.lit((cut or {}).get(None, 0.5))
    if lang in names:
        for k, v in (cut or {}).items():
            limit = F.when(F.col(lang) == k, v).otherwise(limit) if k is not None else limit
    return out.withColumn("threshold", limit).withColumn("flagged", F.col("score") >= F.col("threshold"))
