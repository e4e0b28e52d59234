import brute

from tessera.llm import quality_rules as Q

TEXTS = [None, "", " \n\t", "one", "a " * 30, "x y z w v u t s " * 5 + "end", "line\n" * 12 + "other words here", "&&& ### " * 20,
         "Der Der Der der " * 10, "w!! " * 25, "tiny a b c " * 9, "averyverylongwordindeed" * 3 + " " + "b" * 400,
         " ".join(f"word{i}" for i in range(200)) + " " + " ".join(f"word{i}" for i in range(50)), "é\u00a0ü " * 21]


def test_measurements_match_brute_force(spark):
    rows = [(i, t, -5, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[5], 1, "y")] * 2
    out = Q.ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words long, failures string"))
    assert out.columns == ["doc_id", "text", *Q.MEASURES, "failures"]
    for r in out.collect():
        want = brute.rules(r.text)
        assert {k: r[k] for k in want} == want


def test_policies_filters_and_ablation(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    fails = [brute.rules(t)["failures"] for t in TEXTS]
    led = Q.ledger(docs)
    for policy in Q.POLICIES:
        m = Q.mask(policy)
        assert {r.doc_id for r in led.where(Q.kept(policy)).select("doc_id").collect()} == {i for i, f in enumerate(fails) if not f & m}
        rows = {r.rule: (r.n_failed, r.n_only, r.n_rejected) for r in Q.ablation(led, policy).collect()}
        for name in Q.POLICIES[policy]:
            b = 1 << Q.RULES.index(name)
            assert rows[name] == (sum(f & b > 0 for f in fails), sum(f & m == b for f in fails), sum(f & m > 0 for f in fails))


def test_empty_table(spark):
    led = Q.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert led.count() == 0
    assert all(r.n_failed == r.n_only == r.n_rejected == 0 for r in Q.ablation(led).collect())
