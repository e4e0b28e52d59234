"""Quality rules as a bitmask ledger, with DataFrame functions only.

Method: every rule is evaluated once for every document; the failures are
stored as bits of one integer next to the measurements (the ledger).  A policy
is a version and a mask: a document is kept if none of the policy's bits is
set.  Ablations come from bitwise aggregation of the ledger: a rule decides a
document alone if the masked failures equal its bit.

Words are ``[^\\x20\\x09-\\x0D]+``.  Rows: a null text has no word and fails the
``few_words`` rule; an empty table gives an empty ledger and an ablation of
zeros.  Repeated rows are judged one by one.  Ledger columns replace input
columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs", "n_stutters"]


def _rules(m) -> dict[str, Column]:
    """Name -> failure of the measurements ``m``, in the order of the bits."""
    return {
        "few_words": m["n_words"] < 20,
        "repeated_words": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "symbols": 5 * m["n_symbols"] > m["n_words"],
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "short_words": m["word_chars"] < 2 * m["n_words"],
        "long_words": m["word_chars"] > 16 * m["n_words"],
        "shouting": 10 * m["n_bangs"] > m["n_words"],
        "stutter": 10 * m["n_stutters"] > 3 * m["n_words"],
    }


RULES = ["few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting", "stutter"]
# Versioned policies: the rules whose failure rejects a document.
POLICIES = {"base": ["few_words", "repeated_words"], "v1": ["few_words", "repeated_words", "symbols"], "v2": RULES}


def mask(policy: str | list[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << RULES.index(n) for n in names)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(w: Column) -> Column:
    """A hash of every run of ``WINDOW`` words."""
    return F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(h: Column) -> Column:
    """Words in windows that occur twice: only if there are any, (hash, place) are sorted and neighbours compared."""
    def places(s):
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    covered = F.aggregate(
        _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + (p + WINDOW - F.greatest(p, a["end"]))).cast("bigint").alias("n")),
        lambda a: a["n"])
    return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(F.lit(0).cast("bigint"))


def _measure(t: Column) -> Column:
    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = _let(words, lambda w: _let(lines, lambda x: _let(_windows(w), lambda h: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda s, v: s + F.length(v)).alias("word_chars"),
        (F.size(F.split(t, r"[#*$%&|<>]")) - 1).cast("bigint").alias("n_symbols"),
        F.size(x).cast("bigint").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(h).alias("n_repeat_words"),
        (F.size(F.split(t, "!!")) - 1).cast("bigint").alias("n_bangs"),
        F.size(F.filter(w, lambda v, i: F.coalesce(F.get(w, i - 1) == v, F.lit(False)))).cast("bigint").alias("n_stutters")))))

    def with_failures(m):
        bits = F.lit(0).cast("bigint")
        for i, failed in enumerate(_rules(m).values()):
            bits = bits + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
        return F.struct(*[m[c].alias(c) for c in MEASURES], bits.cast("bigint").alias("failures"))

    return _let(measured, with_failures)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and ``failures`` (bit i set: rule i of ``RULES`` failed)."""
    keep = [c for c in docs.columns if c not in (*MEASURES, "failures")]
    out = docs.withColumn("__m", _measure(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return out.select(*[F.col(f"`{k}`") for k in keep], *[F.col("__m")[c].alias(c) for c in (*MEASURES, "failures")])


def kept(policy: str | list[str] = "v2", failures: str = "failures") -> Column:
    """True where the policy finds no failure."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(led: DataFrame, policy: str | list[str] = "v2") -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it rejects, and all
    that the policy rejects; from one aggregate over the ledger."""
    m = mask(policy)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("failures").bitwiseAND(F.lit(m))
    aggs = [F.count(F.when(hit != 0, 1)).alias("rejected")]
    for n in names:
        b = 1 << RULES.index(n)
        aggs += [F.count(F.when(hit.bitwiseAND(F.lit(b)) != 0, 1)).alias(f"f_{n}"), F.count(F.when(hit == b, 1)).alias(f"o_{n}")]
    one = led.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"),
        F.col("rejected").alias("n_rejected")) for n in names])))
