import base64

import brute
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from tessera.llm.storage import materialise
from tessera.sources.tables import table


def _rows(df):
    return sorted(tuple(r) for r in df.select(*C.COLUMNS).collect())


def _brute(docs, items):
    """The text after each stage, for rows of ``C.COLUMNS``."""
    one = [d for d in docs if not brute.rules(d[1])["failures"]]
    yield one
    _, group = brute.near_groups([d[1] for d in one])
    best = {}
    for g, d in zip(group, one):
        if g not in best or d[0] < best[g][0]:
            best[g] = d
    two = list(best.values())
    yield two
    three = []
    for d, (kept, _) in zip(two, brute.cut_repeats([d[1] for d in two])):
        t = kept.decode("utf-8", "ignore")
        three.append((d[0], t, d[2], d[3], len(t)))
    yield three
    yield [d for d in three if not brute.leaks(d[1], items)]


def test_stages_match_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "short one", None, None, None),
                                   (9004, docs.first().text, "en", "s", 1), (9004, docs.first().text, "en", "s", 1)], docs.schema)
    docs = materialise(docs.unionByName(extra).withColumn("failures", F.lit("clashes")), "t")
    items = [(r.item_id, r.text) for r in table(spark, sf_small, "benchmark").collect()]
    want = list(_brute([tuple(r) for r in docs.select(*C.COLUMNS).collect()], items))
    for (name, stage), rows in zip(C.STAGES, want):
        docs = materialise(stage(spark, docs, sf_small), "t")
        assert docs.columns == C.COLUMNS, name
        assert _rows(docs) == sorted(rows), name
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = C.STAGES[-1][1](spark, docs, sf_small).collect()
    assert sorted((r.doc_id, r.text) for r in last) == sorted((d[0], d[1]) for d in want[-1])
    assert all(r.token_ids == enc.encode_ordinary(r.text) for r in last)


def test_run_is_registered(spark, sf_small):
    out = E.queries()["pipeline"](spark, sf_small)
    assert out.count() > 0 and out.columns == [*C.COLUMNS, "token_ids"]


def test_empty_table(spark, sf_small):
    docs = table(spark, sf_small, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = materialise(stage(spark, docs, sf_small), "t")
    assert docs.count() == 0
