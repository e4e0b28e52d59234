import math

import numpy as np
import xxhash

from tessera.llm import url_filter as U
from tessera.llm.queries import URL_RULES, labelled_urls


def _slots(host, path, buckets):
    out = set()
    for part, text in (("h", host), ("p", path.lower())):
        marked = f"^{text}$"
        for n in U.GRAMS if text else ():
            for i in range(len(marked) - n + 1):
                seed = xxhash.xxh64_intdigest(f"{part}{n}".encode(), seed=42)
                h = xxhash.xxh64_intdigest(marked[i:i + n].encode(), seed=seed)
                out.add((h - (1 << 64) if h >> 63 else h) % buckets)
    return out


def test_training_and_scores_match_numpy(spark):
    rows = [(r.url, r.label) for r in labelled_urls(spark).collect()]
    got = U.train(labelled_urls(spark))
    x = np.zeros((len(rows), U.BUCKETS + 1))
    for i, (url, _) in enumerate(rows):
        rest = url.split("://", 1)[1]
        host, path = rest[:rest.index("/")], rest[rest.index("/"):].split("?")[0].split("#")[0]
        s = _slots(host, path, U.BUCKETS)
        x[i, [k + 1 for k in s]] = 1 / math.sqrt(len(s))
    x[:, 0] = 1
    y = np.array([label for _, label in rows], float)
    w = np.zeros(U.BUCKETS + 1)
    for _ in range(U.EPOCHS):
        p = 1 / (1 + np.exp(-x @ w))
        w = w * (1 - U.RATE * U.RIDGE) + U.RATE * len(U.GRAMS) * 4 * x.T @ (y - p) / len(y)
    assert np.allclose(got, w, atol=1e-6)
    out = U.judge(spark.createDataFrame(rows, "url string, label int"), [], got).collect()
    assert all((r.verdict == "block") == (r.label == 1) for r in out)


def test_host_path_and_rules(spark):
    rows = [("http://WWW.Example.NET/EN/a?x#y", "www.example.net", "/EN/a", "net/"), ("https://a.example.net/en/x", "a.example.net", "/en/x", "example.net/en/"),
            ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/"), ("x://org/fr/1", "org", "/fr/1", "org/fr/"),
            ("http://net", "net", "", None), ("http://evilnet/", "evilnet", "/", None), (None, "", "", None), ("no scheme", "", "", None),
            ("a://b://c/d", "b:", "//c/d", None), ("http://h?q=/x", "h", "", None), ("http://ÀB/É", "Àb", "/É", None), ("", "", "", None)]
    df = spark.createDataFrame([(r[0], "old") for r in rows], "url string, host string")
    out = U.judge(df, URL_RULES, [0.0] * 65).collect()
    assert [(r.url, r.host, r.path, r.rule) for r in out] == rows
    verdicts = {r.rule: r.verdict for r in out if r.rule}
    assert verdicts == {k: v for k, v in URL_RULES}


def test_empty_tables(spark):
    w = U.train(spark.createDataFrame([], "url string, label int"))
    assert w == [0.0] * (U.BUCKETS + 1)
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES, w).count() == 0
