import random

import brute

from tessera.llm import decontam as D


def _words(rnd, n):
    return [rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split())
            + str(rnd.randint(0, 40)) for _ in range(n)]


def _tables():
    rnd = random.Random(7)
    items = [(i, " ".join(_words(rnd, n))) for i, n in enumerate([5, 6, 9, 12, 17, 25, 33, 60, 64, 130, 4, 0])]
    items += [(3, items[3][1]), (50, None), (51, "Same WORDS, other case. here we go again now"), (52, "same words other case here we go again now")]
    docs = []
    for i in range(160):
        body = _words(rnd, rnd.choice([0, 3, 20, 200, 1500]))
        if i % 2:
            w = items[i % 10][1].split()
            if i % 3 == 0 and len(w) > 12:  # one word changed
                w[len(w) // 2] = "changed"
            at = rnd.randint(0, len(body))
            body[at:at] = w
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else "\n".join(body), 0, [1]))
    docs += [(500, items[8][1], 0, [1])] * 2 + [(501, None, 0, None), (None, items[5][1], 1, None), (502, "SAME words: other case here, we go again NOW!", 0, [1])]
    return docs, items


def _check(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long, leaks array<int>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.item_id, round(r.containment, 9)) for r in D.search(df, bench).collect()), key=str)
    want = sorted(((d is None, d, i, round(c, 9)) for d, t, *_ in docs for i, c in brute.leaks(t, dict(items).items()).items()), key=str)
    assert got == want
    clean = D.decontaminate(df, bench)
    assert clean.columns == ["doc_id", "text", "item_id"]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t, *_ in docs if not brute.leaks(t, dict(items).items()))


def test_matches_brute_force(spark):
    _check(spark, *_tables())


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 4)
    _check(spark, *_tables())


def test_empty_tables(spark):
    docs, items = _tables()
    _check(spark, [], items)
    _check(spark, docs[:20], [])
