"""Periodic runs against plain Python on small texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.periodic_runs import collapse, find, least_depth, maximal_pairs, suffix_order
from tessera.llm.textops import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q - i), q)  # periods rise: the smallest stays
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(texts, min_length=6, exponent=4):
    import pyarrow as pa

    out = []
    for _, rows, data, offs in chunks(pa.array(texts, pa.string())):
        n, runs, kept_bytes, ends = find(data, offs, min_length, exponent)
        out += [(int(n[r]), runs[r], kept_bytes[ends[r]:ends[r + 1]].tobytes().decode()) for r in range(rows)]
    return out


def check(texts, min_length=6, exponent=4):
    for text, (n, runs, collapsed) in zip(texts, found(texts, min_length, exponent)):
        w = WORD.findall(text or "")
        want = brute_runs(w, min_length, exponent)
        assert (n, runs, collapsed) == (len(w), want, kept(w, want)), text


def periodic(r):
    """Words of a few kinds with periodic stretches, nested and side by side."""
    out = []
    for _ in range(r.randint(1, 6)):
        block = [r.choice("abcdeé") for _ in range(r.randint(1, 5))]
        out += block * r.randint(1, 9) + block[:r.randint(0, len(block))]
    return out


def test_random_texts():
    r = random.Random(4)
    texts = [r.choice([" ", "\n", " \t "]).join(periodic(r)) for _ in range(400)] + [" ".join(r.choice("ab") for _ in range(80)) for _ in range(200)]
    texts += ["", None, " \n ", "a", "a a a a a", "a a a a a a", "  x " * 40 + "y", "a b " * 30, ("a b c " * 5 + "a b ") * 6]
    check(texts)


@pytest.mark.parametrize("min_length,exponent", [(3, 2), (6, 3), (10, 2), (4, 5)])
def test_other_limits(min_length, exponent):
    r = random.Random(min_length)
    check([" ".join(periodic(r)) for _ in range(150)] + [" ".join(r.choice("ab") for _ in range(60)) for _ in range(100)], min_length, exponent)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
def test_any_words(rows):
    check([" ".join(w) for w in rows])


def test_long_texts():
    """A word 30,000 times, a long period, and a Fibonacci word (many runs inside runs)."""
    n, runs, collapsed = found(["z " + "a " * 30_000 + "b"])[0]
    assert (n, runs, collapsed) == (30_002, [(1, 30_000, 1)], "z a b")
    block = [f"w{k}" for k in range(5000)]
    n, runs, collapsed = found([" ".join(["x", *block * 4, "w0", "y"])])[0]
    assert runs == [(1, 20_001, 5000)] and collapsed == " ".join(["x", *block, "y"])
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    check([" ".join(b[:3000])])
    n, runs, _ = found([" ".join("p q r s t".split() + [f"u{k % 7919}"] if k % 2 else "p q r s t v".split()) for k in range(3)] * 2)[0]
    assert runs == []


def test_many_left_words():
    """A phrase with thousands of different left words is one wide node."""
    text = " ".join(f"p q r s t x{k}" for k in range(8000))
    assert found([text])[0][1] == []


def test_depth_and_pairs():
    assert [least_depth(6, 4), least_depth(3, 2), least_depth(10, 2), least_depth(100, 4)] == [5, 2, 5, 75]
    with pytest.raises(ValueError):
        least_depth(2, 4)
    ids = np.array([7, 1, 1, 1, 1, 1, 1, 9])
    at = np.arange(1, 3)
    order, shared = suffix_order(ids, at)
    assert sorted(order) == [1, 2] and list(shared) == [5]
    assert list(maximal_pairs(list(order), list(shared), [-1, *ids.tolist()], 5, 6, 4)) == [(1, 1, 5)]


def test_query_against_plain_python(spark, sf_small):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha, planted = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for d in docs:
        w = WORD.findall(d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r.collapsed_sha256 == sha(kept(w, runs))
    assert planted > 5


def test_nulls_clashing_columns_and_empty_table(spark):
    rows = [(None, "a a a a a a a", "x", 1), (1, None, "y", 2), (2, "b", None, None), (2, "b", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, _text int")
    out = collapse(df)
    assert out.columns == ["doc_id", "text", "_text", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert got == sorted([(None, 7, [(0, 7, 1)], "a"), (1, 0, [], ""), (2, 1, [], "b"), (2, 1, [], "b")], key=str)
    assert collapse(df.limit(0)).count() == 0
