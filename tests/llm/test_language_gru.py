"""The recurrent network against plain formulas, its gradients, and held-out accuracy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_gru as G
from tessera.llm import queries


def plain_probabilities(net, text: bytes, langs: int):
    """Position by position, unit by unit."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    out = []
    for at in range(0, len(text), G.SEGMENT):
        seg = list(text[at:at + G.SEGMENT])
        seg += [G.PAD] * (G.SEGMENT - len(seg))
        z = [[float(net.bias[k, 0]) for k in range(langs)] for _ in seg]
        for d in (0, 1):
            h = [0.0] * G.HIDDEN
            for t in (range(len(seg)) if d == 0 else reversed(range(len(seg)))):
                g = net.table[d][seg[t]]
                r = [sig(sum(net.gates[d][i][j] * h[j] for j in range(G.HIDDEN)) + g[i]) for i in range(G.HIDDEN)]
                u = [sig(sum(net.gates[d][G.HIDDEN + i][j] * h[j] for j in range(G.HIDDEN)) + g[G.HIDDEN + i]) for i in range(G.HIDDEN)]
                c = [math.tanh(sum(net.cand[d][i][j] * r[j] * h[j] for j in range(G.HIDDEN)) + g[2 * G.HIDDEN + i]) for i in range(G.HIDDEN)]
                h = [u[i] * h[i] + (1 - u[i]) * c[i] for i in range(G.HIDDEN)]
                for k in range(langs):
                    z[t][k] += sum(net.out[d][k][i] * h[i] for i in range(G.HIDDEN))
        for t, b in enumerate(seg):
            if G.letter_table()[b]:
                e = [math.exp(v) for v in z[t]]
                out.append([v / sum(e) for v in e])
    return np.mean(out, 0) if out else np.zeros(langs)


def test_pooled_against_plain_formulas():
    net = G.Network(3, seed=2)
    texts = ["Hello wörld, " * 12, "", None, "123 456", "x", "été " * 100]
    got = G.pooled(net.compiled(), pa.array(texts, pa.string()))
    for t, p in zip(texts, got):
        assert p == pytest.approx(plain_probabilities(net, (t or "").encode(), 3), abs=2e-5)


def test_long_text_equals_its_parts(monkeypatch):
    """Batches cut a long text anywhere between segments."""
    model = G.Network(2).compiled()
    text = "".join(chr(97 + k * k % 26) for k in range(10_000))
    whole = G.pooled(model, pa.array([text, "abc"]))
    monkeypatch.setattr(G, "BATCH", 7)
    assert G.pooled(model, pa.array([text, "abc"])) == pytest.approx(whole, abs=1e-6)


def test_gradients():
    net = G.Network(3, seed=5)
    for name in ("table", "gates", "cand", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    r = np.random.default_rng(0)
    x, y = r.integers(0, 257, (9, 4)), r.integers(0, 3, (9, 4))

    def loss():
        p = G.softmax(net.forward(x)[0], 1)
        return -np.log(np.take_along_axis(p, y[:, None, :], 1)).sum()

    z, kept = net.forward(x)
    dz = G.softmax(z, 1)
    np.put_along_axis(dz, y[:, None, :], np.take_along_axis(dz, y[:, None, :], 1) - 1, 1)
    for p, g in zip(net.params(), net.backward(x, dz, kept)):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for i in {int(np.abs(gf).argmax()), *r.integers(0, len(flat), 6).tolist()}:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert gf[i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_language_id"](spark, sf).toPandas()
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert len(got) == len(lang) and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang_pred == held.doc_id.map(lang)).mean() > 0.97


def test_null_letterless_and_unlabelled(spark):
    rows = [(None, None, "en", "a"), (1, "", "en", "b"), (2, "12 — !?", "fr", "c"), (3, "mot", None, "d"), (3, "mot", None, "d"), (9, "Ünïcode", "de", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = G.train(df)
    out = G.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = sorted(((r.doc_id, r.lang_pred) for r in out.collect()), key=str)
    assert model["langs"] == ["de"] and got == sorted([(None, "und"), (1, "und"), (2, "und"), (3, "de"), (3, "de"), (9, "de")], key=str)
    assert G.train(df.where("lang = 'fr'")) is None
    assert {(r.lang_pred, r.score) for r in G.identify(df, None).collect()} == {("und", 0.0)}
    assert G.identify(df.limit(0), model).count() == 0


def test_sample_is_bounded_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(G, "PER_LANG", 5)
    rows = [(k, f"word{k} " * (k % 9 + 1) * 40, ["en", "fr"][k % 2]) for k in range(300)] + [(1000 + k, "copy", "en") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = G.labelled_slices(df), G.labelled_slices(df.repartition(3))
    assert a.equals(b) and a["y"].to_pylist() == ["en"] * 5 + ["fr"] * 5
    assert max(map(len, a["t"].to_pylist())) <= G.SLICE and len(set(a["t"].to_pylist())) == 10
