import random

import brute
import pytest

from tessera.llm import jaccard_join as J


def _docs():
    rnd = random.Random(11)
    base = [[f"w{rnd.randint(0, 900)}" for _ in range(n)] for n in (6, 40, 120, 400)]
    rows, i = [], 0
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, len(b) // 30, len(b) // 15])):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 99)}"
            rows.append((i, " ".join(w).title() if i % 4 == 0 else " \n".join(w)))
            i += 1
    rows += [(i + k, " ".join(f"solo{k}_{j}" for j in range(30)) + " the same short common line here") for k in range(40)]
    rows += [(900, None), (901, ""), (902, "too few words"), (903, "too few words"), (904, "Too few words"), (905, rows[20][1]), (905, rows[20][1]),
             (None, rows[20][1]), (None, "no id but more than five words here")]
    return rows


@pytest.mark.parametrize("leaf,block", [(64, 512), (3, 5)])
def test_links_and_groups_match_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = _docs()
    links, group = brute.near_groups([t for _, t in rows])
    df = spark.createDataFrame([(d, t, 1, b"k") for d, t in rows], "doc_id long, text string, label int, k binary")
    got = [tuple(r) for r in J.join(df).select("doc_id", "n_links", "class_id").collect()]
    ids = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            ids[g] = min(d, ids.get(g, d))
    want = [(d, n, ids.get(g)) for (d, _), n, g in zip(rows, links, group)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    stay = J.deduplicate(df)
    assert stay.columns == df.columns
    kept = stay.collect()
    assert len(kept) == len(set(group))
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(ids.values())


def test_recall_bound():
    p = 1.0
    import math
    for _ in range(J.DEPTH):
        p = 1 - math.exp(-p)
    assert 1 - (1 - p) ** J.runs_for() >= J.RECALL


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(df).count() == 0
    assert J.deduplicate(df).count() == 0


def test_groups_of_a_dense_bucket_in_rows_that_grow_with_it(spark, monkeypatch):
    """Groups need no comparison of linked texts: before, a bucket of n texts was dealt to n * n / BLOCK rows."""
    monkeypatch.setattr(J, "BLOCK", 20)
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, " ".join([f"x{i}", *words])) for i in range(400)], "doc_id long, text string")
    dealt, prune = [], J.prune
    monkeypatch.setattr(J, "prune", lambda rows: (dealt.append((rows.count(), rows.select("bucket").distinct().count())), prune(rows))[1])
    assert [r.doc_id for r in J.deduplicate(df).collect()] == [0]
    assert all(rows <= 3 * 400 * buckets for rows, buckets in dealt)  # 20 rows a text and bucket before


def test_every_pair_outside_a_component_is_compared(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 5)
    # Half of the bucket is one component, a part another one, the rest alone.
    keys = [bytes([i]) for i in range(60)]
    label = {k: keys[0] if i < 30 else keys[30] if i < 37 else k for i, k in enumerate(keys)}
    members = spark.createDataFrame([(1, 60, bytearray(k)) for k in keys], "bucket bigint, n bigint, k binary")
    linked = spark.createDataFrame([(bytearray(k), bytearray(c)) for i, (k, c) in enumerate(label.items()) if i < 37], "k binary, label binary")
    met = set()
    groups = {}
    for r in J.block_rows(members, centres=True).collect():
        groups.setdefault(("first", r.g), []).append(r)
    for r in J.rest_rows(members, linked).collect():
        groups.setdefault(("rest", r.g), []).append(r)
    for rows in groups.values():
        across = any(r.side for r in rows)
        met |= {frozenset((bytes(a.k), bytes(b.k))) for a in rows for b in rows if a.k != b.k and (not across or a.side != b.side)}
    assert all(frozenset((a, b)) in met for a in keys for b in keys if label[a] != label[b])
    one = spark.createDataFrame([(bytearray(k), bytearray(keys[0])) for k in keys], "k binary, label binary")
    assert J.rest_rows(members, one).count() == 0
