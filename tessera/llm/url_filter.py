"""URL filter: host and path rules, and a logistic regression for the other URLs.

Method: character n-grams of host and path are hashed into ``buckets`` slots
(each part apart); a logistic regression on the presence of the slots is
trained from a small labelled URL table.  Training is gradient descent in the
span of the labelled rows, one coefficient for each, so it is an aggregate over
one row of arrays; the weights of the slots follow from one join and sum.
Everything is DataFrame and SQL functions.

Rows: a null URL, or one without ``://``, has an empty host and path, no n-gram
and therefore the score of the bias alone.  Of the rules that fit, the longest
wins; rules of the same length cannot both fit unless they are equal.  Repeated
rows and empty tables need nothing special.  The result columns ``host path
rule score verdict`` replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 4096
GRAMS = (3, 4)
# The labelled table is small by contract; more rows than this raise an error.
MAX_LABELLED = 2000
EPOCHS, RATE, RIDGE = 300, 0.5, 0.002


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.expr("substring(__u, instr(__u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    rest = F.expr("substring(__u, instr(__u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Replace or add ``host`` and ``path``."""
    out = urls.drop("host", "path") if url not in ("host", "path") else urls
    out = out.withColumn("__u", F.coalesce(F.col(url), F.lit("")))
    return out.withColumns({"host": host_of(F.col("__u")), "path": path_of(F.col("__u"))}).drop("__u")


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (``host/path`` text) and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        rule_host, rule_path = text[:at].lower(), text[at:]
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def slots(host: Column, path: Column, buckets: int = BUCKETS, grams=GRAMS) -> Column:
    """Distinct hashed n-gram slots of host (with end marks) and path."""
    def of(part: str, text: Column) -> list[Column]:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.when((F.length(text) > 0) & (F.length(marked) >= n), F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))),
            lambda i: F.pmod(F.xxhash64(F.lit(f"{part}{n}"), F.substr(marked, i, F.lit(n))), F.lit(buckets)).cast("int")))
            .otherwise(F.array().cast("array<int>")) for n in grams]
    return F.array_distinct(F.concat(*of("h", host), *of("p", F.lower(path))))


def train(labelled: DataFrame, url: str = "url", label: str = "label", buckets: int = BUCKETS,
          epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> list[float]:
    """Bias and slot weights (``buckets + 1`` numbers) from a small table of URLs labelled 1 (block) or 0.

    Rows with a null label are left out; an empty table gives zero weights.
    """
    parts = split_url(labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).alias("y")))
    feats = (parts.select(F.col("url"), F.col("y").cast("double").alias("y"), slots(F.col("host"), F.col("path"), buckets).alias("x"))
             .groupBy("url", "y", "x").agg(F.count("*").cast("double").alias("n")))
    if feats.count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    # Kernel of two rows: shared slots, scaled to unit rows, plus 1 for the bias.
    rows = feats.agg(F.sort_array(F.collect_list(F.struct("url", "y", "x", "n"))).alias("r"))
    kernel = F.transform("r", lambda a: F.transform("r", lambda b: F.lit(1.0) + F.size(F.array_intersect(a["x"], b["x"]))
                                                    / F.sqrt(F.greatest(F.size(a["x"]) * F.size(b["x"]), F.lit(1)))))
    rows = rows.select("r", kernel.alias("k"), F.aggregate("r", F.lit(0.0), lambda s, a: s + a["n"]).alias("total"))
    step = lambda alpha: F.transform("k", lambda row, i: (
        F.get(alpha, i) * (1 - rate * ridge)
        + rate * F.get(F.col("r"), i)["n"] / F.col("total") * len(GRAMS) * 4
        * (F.get(F.col("r"), i)["y"] - 1 / (1 + F.exp(-F.aggregate(
            F.zip_with(row, alpha, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))))))
    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.transform("r", lambda a: F.lit(0.0)), lambda al, _: step(al))
    fitted = rows.select(F.explode(F.arrays_zip(F.col("r"), alpha.alias("alpha"))).alias("z")).select(
        F.col("z.r.x").alias("x"), F.col("z.alpha").alias("alpha"))
    weights = (fitted.select(F.explode(F.concat(F.array(F.lit(-1)), F.col("x"))).alias("slot"),
                             "alpha", F.sqrt(F.greatest(F.size("x"), F.lit(1))).alias("scale"))
               .groupBy("slot").agg(F.sum(F.when(F.col("slot") < 0, F.col("alpha")).otherwise(F.col("alpha") / F.col("scale"))).alias("w")))
    out = [0.0] * (buckets + 1)
    for r in weights.collect():  # at most buckets + 1 rows
        out[r["slot"] + 1] = r["w"]
    return out


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability of block: weights are one literal array of a fixed size."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    x = slots(host, path, len(weights) - 1)
    z = F.aggregate(x, F.lit(0.0), lambda s, i: s + F.get(table, i + 1))
    return 1 / (1 + F.exp(-(F.lit(float(weights[0])) + z / F.sqrt(F.greatest(F.size(x), F.lit(1))))))


def judge(urls: DataFrame, rules: list[tuple[str, str]], weights: list[float], url: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """Add ``host path rule score verdict`` to every row."""
    out = split_url(urls, url).drop("rule", "score", "verdict")
    rule, says = rule_of(rules, F.col("host"), F.col("path"))
    out = out.withColumn("score", score(F.col("host"), F.col("path"), weights))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(says, F.when(F.col("score") >= threshold, "block").otherwise("allow"))})
