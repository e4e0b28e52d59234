import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_mil as Q
from tessera.llm import toxicity as X
from tessera.llm.sampling import fold, labelled_sample

WORDS = [a + b + c for a in ("th", "er", "on", "an") for b in ("ing", "ed", "or", "at") for c in ("", "le", "ou", "sh")]
BAD = ["scum", "trashly", "moronic", "vileness"]


def _rows(n=700):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(WORDS) for _ in range(rnd.choice([3, 40, 150]))]
        toxic = rnd.random() < 0.3
        junk = rnd.random() < 0.3
        if toxic:
            for _ in range(2):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(BAD) + rnd.choice(["", ",", "."]))
        if junk:
            w = [x + "&&&" for x in w] if i % 2 else [x for x in w for _ in range(6)]
        docs.append((i, " ".join(w), rnd.choice(["en", "de", None]), 0.25))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = _rows()
    extra = [(9000, None, "en", 0.0), (9001, "", None, 0.0), (9002, "word " * 30_000, "en", 0.0), (None, "no id", "en", 0.0), (5, docs[5][1], "en", 0.0)]
    return (spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score double"),
            spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"))


def _accuracy(out, labels, col, cut):
    m = out.join(labels.where(F.col(col).isNotNull()), "doc_id").where(fold(F.col("doc_id"), 3) == 1)
    return m.select(F.avg(((F.col("score") >= cut).cast("int") == F.col(col)).cast("int"))).first()[0]


def test_fold_is_crc32(spark):
    df = spark.range(50).select("id", fold(F.col("id"), 3).alias("f"))
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in df.collect())


def test_sample_is_bounded_and_outside_the_fold(tables):
    docs, labels = tables
    t = labelled_sample(docs, labels, "toxic", 20, 4000, extra=["doc_id"])
    assert t.num_rows <= 40 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in t["doc_id"].to_pylist())


def test_toxicity_held_out(tables):
    docs, labels = tables
    model, cut = X.train(docs, labels)
    out = X.score(docs, model, cut)
    assert out.columns == ["doc_id", "text", "lang", "score", "threshold", "flagged"] and out.count() == docs.count()
    assert _accuracy(out, labels, "toxic", 0.7) > 0.97
    rows = out.collect()
    assert all(0 <= r.score <= 1 for r in rows) and None in cut
    alike = {r.score for r in rows if r.doc_id == 5}
    assert max(alike) - min(alike) < 1e-6


def test_thresholds_cover_all_labelled_rows(tables, monkeypatch):
    """At the true label ratio and for every language, also those that the fitting sample does not hold."""
    docs, labels = tables
    monkeypatch.setattr(X, "PER_CLASS", 40)
    docs = docs.withColumn("lang", F.when(F.col("doc_id").between(100, 130), "fr").otherwise(F.col("lang")))
    model, cut = X.train(docs, labels)
    kept = X.score(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id").where(fold(F.col("doc_id"), 3) != 1).where("text IS NOT NULL").collect()
    for lang in (None, "de", "en", "fr"):
        rows = sorted(((r.score, r.toxic) for r in kept if lang in (None, r.lang)), reverse=True)
        hits, best = 0, None
        for i, (s, y) in enumerate(rows):
            hits += y
            if hits >= X.PRECISION * (i + 1):
                best = s
        above = [y for s, y in rows if s >= cut[lang]]
        assert sum(above) >= X.PRECISION * len(above)
        assert abs(len(above) - sum(s >= best for s, _ in rows)) <= 2, (lang, best, cut[lang])


def test_quality_held_out(tables):
    docs, labels = tables
    out = Q.score(docs, Q.train(docs, labels), attention=True)
    assert out.count() == docs.count()
    assert _accuracy(out, labels, "quality", 0.5) > 0.97
    for r in out.collect():
        assert 0 <= r.score <= 1 and abs(sum(r.attention) - 1) < 1e-4
        assert len(r.attention) == max(1, -(-len((r.text or "").split()) // Q.PASSAGE))


@pytest.mark.parametrize("mod,label", [(Q, "quality"), (X, "toxic")])
def test_without_labels_and_rows(spark, tables, mod, label):
    docs, labels = tables
    model = mod.train(docs, labels.limit(0))
    model = model[0] if isinstance(model, tuple) else model
    assert model is None
    assert {r.score for r in mod.score(docs, model).collect()} == {0.5}
    assert mod.score(docs.limit(0), model).count() == 0


def test_gradients():
    """Attention gradients against finite differences."""
    import numpy as np
    rng = np.random.default_rng(0)
    net = Q.Network()
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n_pass = np.array([2, 3])
    stats = rng.random((5, Q.STATS))
    ids, starts = rng.integers(0, Q.BUCKETS, 20), np.arange(0, 20, 4)
    y = np.array([1.0, 0.0])

    def loss(q):
        s = Q.forward(q, Q.passage_inputs(q["emb"], ids, starts, stats).astype(np.float64), n_pass)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    before = {k: v.copy() for k, v in p.items()}
    state = {k: np.full_like(v, 1e12) for k, v in p.items()}  # steps proportional to the gradient
    Q._train_step(p, state, np.ones(Q.BUCKETS, bool), ids, starts, stats, n_pass, y, True)
    for k in ("a", "v", "u", "c", "b"):
        i = tuple(0 for _ in before[k].shape)
        moved = -(p[k][i] - before[k][i]) * 1e6 / Q.RATE
        q = {n: v.copy() for n, v in before.items()}
        q[k][i] += 1e-4
        up = loss(q)
        q[k][i] -= 2e-4
        assert abs(moved - (up - loss(q)) / 2e-4) < 2e-3, k
