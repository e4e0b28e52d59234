"""Quality scores by attention-based multiple-instance learning.

Method: a document is a bag of passages of ``PASSAGE`` words.  Every passage is
encoded from the mean of its hashed word embeddings and a few surface shares
(symbols, digits, capitals, repeated words, ...); slots that fewer than
``MIN_TEXTS`` training texts use stay zero.  A gated attention (a tanh
branch times a sigmoid branch), learnt from document labels only, weights the
passages; the weighted sum of the encodings is the document's representation,
scored by a logistic layer.  Trained in numpy on a bounded sample of labelled
rows (``PER_CLASS`` for each label, texts up to ``MAX_BYTES``); scoring reads
whole texts and only scans the documents.

Rows: a null or empty text is a bag of one empty passage.  Repeated rows score
alike; an empty table gives no rows; without labelled rows of both kinds every
score is 0.5.  ``score`` and ``attention`` replace input columns of the names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.sampling import labelled_sample
from tessera.llm.textops import chunks, mix, prefix_hash, space_table, span_hash, word_spans

PASSAGE = 48
BUCKETS, DIM, HIDDEN, GATE = 1 << 13, 8, 12, 8
PER_CLASS, MAX_BYTES = 2500, 32_768
EPOCHS, BATCH, RATE = 14, 32, 0.05
MIN_TEXTS = 4
# Share of training batches without the words, so that the surface shares are learnt by themselves.
WORD_DROP = 0.5
# Byte classes that are counted per passage.
SYMBOLS, BANGS, STOPS = b"#*$%&|<>_=~^{}[]\\/@", b"!?", b".,;:"


def _classes() -> np.ndarray:
    t = np.zeros((256, 6), np.float32)
    for k, group in enumerate((SYMBOLS, BANGS, STOPS, b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256)))):
        t[list(group), k] = 1
    return t


STATS = 6 + 6


def bags(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Embedding slots of all words, first word of every passage, surface shares of
    every passage, and the number of passages of every text (at least 1)."""
    s, e, per_row = word_spans(data, offs, space_table())
    rows = len(per_row)
    n_pass = np.maximum(-(-per_row // PASSAGE), 1)
    first_word = np.repeat(np.cumsum(per_row) - per_row, n_pass)
    k = np.arange(len(first_word)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
    starts = first_word + k * PASSAGE
    sizes = np.minimum(PASSAGE, np.repeat(per_row, n_pass) - k * PASSAGE)
    if not len(s):
        return np.zeros(0, np.int64), starts, np.zeros((len(starts), STATS), np.float32), n_pass
    h = span_hash(prefix_hash(data), s, e)
    ids = (mix(h) % np.uint64(BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(rows), per_row)
    word = np.zeros((len(h) + 1, 4), np.float64)  # running sums over words
    same1 = np.zeros(len(h), bool)
    same1[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    same2 = np.zeros(len(h), bool)
    same2[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    newline = np.zeros(len(h), bool)
    newline[1:] = data[s[1:] - 1] == 0x0A
    word[1:] = np.cumsum(np.stack([e - s, same1, same2, newline], 1), 0)
    byte = np.zeros((len(data) + 1, 6), np.float32)
    byte[1:] = np.cumsum(_classes()[data], 0)
    last = starts + np.maximum(sizes, 0)
    size = np.maximum(sizes, 1)[:, None]
    sums = word[last] - word[starts]
    full = sizes > 0
    b0 = np.where(full, s[np.minimum(starts, len(s) - 1)], 0)
    b1 = np.where(full, e[np.maximum(last - 1, 0)], 0)
    counts = byte[b1] - byte[b0]
    stats = np.concatenate([counts / size, sums[:, :1] / size / 8, sums[:, 1:] / size,
                            np.maximum(sizes, 0)[:, None] / PASSAGE, (sizes <= 0)[:, None]], 1).astype(np.float32)
    return ids, starts, np.minimum(2 * stats, 4), n_pass


def passage_inputs(emb: np.ndarray, ids: np.ndarray, starts: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Mean embedding of every passage next to its surface shares."""
    total = np.zeros((len(ids) + 1, emb.shape[1]), np.float64)
    if len(ids):
        np.cumsum(emb[ids], 0, out=total[1:])
    ends = np.append(starts[1:], len(ids))
    size = np.maximum(ends - starts, 1)[:, None]
    return np.concatenate([(total[ends] - total[starts]) / size, stats], 1).astype(np.float32)


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        n = lambda *shape: r.normal(0, (1 / shape[0]) ** 0.5, shape).astype(np.float32)
        self.p = {"emb": r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), "w": n(DIM + STATS, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
                  "v": n(HIDDEN, GATE), "u": n(HIDDEN, GATE), "a": n(GATE, 1)[:, 0], "c": n(HIDDEN, 1)[:, 0], "c0": np.zeros(1, np.float32)}


def forward(p: dict, x: np.ndarray, n_pass: np.ndarray) -> dict:
    """Encodings, attention and scores of bags of passages."""
    h = np.tanh(x @ p["w"] + p["b"])
    tv, su = np.tanh(h @ p["v"]), _sig(h @ p["u"])
    logit = (tv * su) @ p["a"]
    first = np.cumsum(n_pass) - n_pass
    top = np.repeat(np.maximum.reduceat(logit, first), n_pass)
    w = np.exp(logit - top)
    att = w / np.repeat(np.add.reduceat(w, first), n_pass)
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    return {"h": h, "tv": tv, "su": su, "att": att, "z": z, "score": _sig((z @ p["c"] + p["c0"][0]).astype(np.float64)), "first": first}


def _train_step(p: dict, state: dict, live, ids, starts, stats, n_pass, y, words: bool) -> None:
    x = passage_inputs(p["emb"], ids, starts, stats)
    x[:, :DIM] *= words
    f = forward(p, x, n_pass)
    g = ((f["score"] - y) / len(y)).astype(np.float32)
    grad = {"c": f["z"].T @ g, "c0": np.array([g.sum()], np.float32)}
    gz = np.repeat(np.outer(g, p["c"]), n_pass, axis=0)
    dot = (gz * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["att"] * dot, f["first"]), n_pass)
    gl = f["att"] * (dot - mean)
    grad["a"] = (f["tv"] * f["su"]).T @ gl
    gt = np.outer(gl, p["a"]) * f["su"] * (1 - f["tv"] ** 2)
    gu = np.outer(gl, p["a"]) * f["tv"] * f["su"] * (1 - f["su"])
    grad["v"], grad["u"] = f["h"].T @ gt, f["h"].T @ gu
    gh = (f["att"][:, None] * gz + gt @ p["v"].T + gu @ p["u"].T) * (1 - f["h"] ** 2)
    grad["w"], grad["b"] = x.T @ gh + 1e-4 * p["w"], gh.sum(0)
    if len(ids) and words:
        size = np.append(starts[1:], len(ids)) - starts
        gx = (gh @ p["w"][:DIM].T) / np.maximum(size, 1)[:, None]
        rows, inv = np.unique(ids, return_inverse=True)
        ge = np.zeros((len(rows), DIM), np.float32)
        np.add.at(ge, inv, np.repeat(gx, size, axis=0).astype(np.float32))
        rows, ge = rows[live[rows]], ge[live[rows]]
        state["emb"][rows] += ge * ge
        p["emb"][rows] -= RATE * ge / np.sqrt(state["emb"][rows] + 1e-8)
    for k, gr in grad.items():
        state[k] += gr * gr
        p[k] -= (RATE * gr / np.sqrt(state[k] + 1e-8)).astype(np.float32)


def fit(texts: list[str], y, epochs: int = EPOCHS) -> dict | None:
    """Train on whole texts with labels 0 and 1; None unless both occur."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rows = []
    for _, _, data, offs in chunks(pa.array(texts, pa.string())):
        ids, starts, stats, n_pass = bags(data, offs)
        bounds = np.append(starts, len(ids))
        at = np.concatenate([[0], np.cumsum(n_pass)])
        rows += [(ids[bounds[a]:bounds[b]], starts[a:b] - starts[a], stats[a:b]) for a, b in zip(at[:-1], at[1:])]
    net, rng = Network(), np.random.default_rng(4)
    texts_with = np.zeros(BUCKETS, np.int64)
    for r in rows:
        texts_with[np.unique(r[0])] += 1
    net.live = texts_with >= MIN_TEXTS
    net.p["emb"][~net.live] = 0
    state = {k: np.zeros_like(v) for k, v in net.p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = [rows[j] for j in order[i:i + BATCH]]
            base = np.cumsum([0] + [len(r[0]) for r in pick])
            _train_step(net.p, state, net.live, np.concatenate([r[0] for r in pick]),
                        np.concatenate([r[1] + b for r, b in zip(pick, base)]), np.concatenate([r[2] for r in pick]),
                        np.array([len(r[1]) for r in pick]), y[order[i:i + BATCH]], rng.random() >= WORD_DROP)
    return net.p


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """The network from the labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, PER_CLASS, MAX_BYTES)
    return fit(sample["t"].to_pylist(), sample["y"].to_pylist())


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None, attention: bool = False) -> DataFrame:
    """Add ``score`` and, if asked for, ``attention`` (the weight of every passage)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "attention")]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("score", T.DoubleType())]
                          + ([T.StructField("attention", T.ArrayType(T.FloatType()))] if attention else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            for first, rows, data, offs in chunks(batch.column(at[text])):
                ids, starts, stats, n_pass = bags(data, offs)
                if p is None:
                    s, w = np.full(rows, 0.5), np.repeat(1 / n_pass, n_pass)
                else:
                    f = forward(p, passage_inputs(p["emb"], ids, starts, stats), n_pass)
                    s, w = f["score"], f["att"]
                part = batch.slice(first, rows)
                cols = [*[part.column(at[c]) for c in names], pa.array(s, pa.float64())]
                if attention:
                    bounds = pa.array(np.concatenate([[0], np.cumsum(n_pass)]), pa.int32())
                    cols.append(pa.ListArray.from_arrays(bounds, pa.array(w, pa.float32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]).mapInArrow(run, schema)
