import random

import brute
import pytest

from tessera.llm import suffix_dedup as S


def test_deep_shallow_order():
    rnd = random.Random(2)
    for _ in range(200):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 30))]
        strings += [strings[0], strings[0] + b"a", b"ab" * 40]
        order = S.deep_shallow_order(strings, shallow=rnd.choice([0, 2, 8, 24]))
        assert sorted(order) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)
        got = S.neighbour_prefixes(strings, order)
        for n, a, b in zip(got[1:], order, order[1:]):
            x, y = strings[a], strings[b]
            assert x[:n] == y[:n] and (n in (len(x), len(y)) or x[n] != y[n])


@pytest.mark.parametrize("small", [24, 1])
def test_shared_stretches(monkeypatch, small):
    monkeypatch.setattr(S, "SMALL_GROUP", small)
    rnd = random.Random(4)
    for _ in range(40):
        core = bytes(rnd.choice(b"xyz") for _ in range(400))
        left, right = [], []
        for _ in range(rnd.randint(2, 12)):
            w = bytearray(core)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.choice([*range(0, S.REACH), *range(S.REACH + S.GRAM, 400)])] = ord("Q")
            left.append(bytes(w[:S.REACH])[::-1])
            right.append(bytes(w[S.REACH:S.REACH + S.LENGTH]))
        for i, (a, b) in enumerate(S.shared_stretches(left, right)):
            best = [-1, -1]
            for j in range(len(left)):
                x, y = S.common_prefix(left[i], left[j]), S.common_prefix(right[i], right[j])
                if i != j and x + y >= S.LENGTH:
                    best = [max(best[0], x), max(best[1], y)]
            if best[0] < 0:
                assert (a, b) == (0, 0)
            else:  # the union of the shared windows is the same
                assert a == best[0] and b == best[1]


def _docs():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (20, 40, 41, 60, 200)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rnd.choice([0, 5, 60])))]
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            if rnd.random() < 0.4:
                at = rnd.randrange(len(p))
                p = p[:at] + "#" + p[at + 1:]
            parts += [p, " ".join(word() for _ in range(rnd.choice([0, 3, 30])))]
        rows.append((i, " ".join(parts)))
    rows += [(500, "Is onhe. " * 60), (501, "Is onhe. " * 24), (502, "x" * 199), (503, "x" * 199), (504, "y" * 200), (505, "y" * 200), (506, "z" * 900),
             (507, None), (508, ""), (509, rows[3][1]), (509, rows[3][1]), (None, rows[5][1] + " tail"), (510, "ab" * 99 + "c"), (511, "日本語" * 80)]
    return rows


@pytest.mark.parametrize("limits", [(50_000, 24, 34), (3, 2, 34), (2, 24, 7)])
def test_matches_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(S, "HOT_LEAST", 1000 if limits[0] > 100 else 4)
    monkeypatch.setattr(S, "CUT_BYTES", 1 << 21 if limits[0] > 100 else 3000)
    monkeypatch.setattr(S, "MAX_GROUP", limits[0])
    monkeypatch.setattr(S, "SMALL_GROUP", limits[1])
    monkeypatch.setattr(S, "GRID", limits[2])
    rows = _docs()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, block int")
    got = [(r.doc_id, bytes(r.kept), [tuple(x) for x in r.spans or []]) for r in S.remove_repeats(df).collect()]
    want = [(d, k, s) for (d, _), (k, s) in zip(rows, brute.cut_repeats([t for _, t in rows]))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_clean_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é" * 150 + "a"), (2, "é" * 150 + "b"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.clean_texts(df).collect()}
    assert out == {1: "a", 2: "b", 3: ""}
    assert S.clean_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_and_a_long_text(spark):
    """Columns of any name stay; a text of many repeated passages is one row."""
    passage = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"{passage} {k} {k * k}" for k in range(400))
    df = spark.createDataFrame([(1, long, "a", "b", 5), (2, "short", None, None, None)], "doc_id long, text string, k string, key string, c0 int")
    out = {r.doc_id: r for r in S.clean_texts(df).collect()}
    assert S.clean_texts(df).columns == df.columns and (out[1].k, out[1].key, out[1].c0) == ("a", "b", 5)
    (kept, spans), = brute.cut_repeats([long])
    assert out[1].text == kept.decode() and out[2].text == "short"
    assert len(S.remove_repeats(df).where("doc_id = 1").first().spans) == len(spans) > 300
