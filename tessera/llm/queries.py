"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return deco


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes they decode to, as digests."""
    import public_tokenizers

    from tessera.llm.bpe import decode_documents, encode_documents

    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_documents(docs, vocab, public_tokenizers.PATTERN).drop("text")
    return decode_documents(ids, vocab).select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), e AS (
  SELECT *, lag(role) OVER w AS before, count(*) OVER () AS n,
    length(regexp_replace(text, '(\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|\[NEXT\])', '\\\1', 'g')) AS chars,
    length(regexp_replace(role, '(\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|\[NEXT\])', '\\\1', 'g')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE
    CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18 ELSE 28 + role_chars END END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op9_chat", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the output."""
    from tessera.llm.chat import format_conversations, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = read_back(format_conversations(turns.unionByName(probe)))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
               .cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


# The rules of the URL filter.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# The small labelled URL table: hosts to block and to allow, each with a few paths.  None of the hosts that the pages
# tables name is among them: what is said of those is said of hosts that training did not see.
BLOCK_HOSTS = ("casino-slots lucky-casino best-casino online-casino ads-banner ads-server adserver-click click-track track-pixel bets-now "
               "bet-win sport-bets free-win free-coins spam-mail mail-spam link-farm farm-links pills-shop buy-pills cheap-meds cheap-watches "
               "adult-cams adult-chat xxx-cams xxx-videos").split()
ALLOW_HOSTS = ("weather library news garden school river museum cooking science history market theatre nature reading weekend brother "
               "station motion within nothing earth rather mountain another national thousand together months paths clothes truths theses "
               "others notes stones houses lines").split()
LABELLED_PATHS = ["/en/12.html", "/fr/804?page=2", "/es/77", "/de/410/"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table: (url, label), 1 to block."""
    rows = [(f"https://{sub}{h}.example.{tld}{p}", y)
            for y, hosts in ((1, BLOCK_HOSTS), (0, ALLOW_HOSTS)) for h in hosts
            for sub, tld, p in zip(("www.", "m.", "", "blog."), ("com", "org", "com", "org"), LABELLED_PATHS)]
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the classifier."""
    from tessera.llm.url_filter import judge, train

    weights = train(labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES, weights).select("page_id", "host", "path", "rule", "verdict", "score")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(string_split(t, '!!')) - 1 AS n_bangs,
    len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2])) AS n_stutters
  FROM w LEFT JOIN covered c USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 10 * n_bangs > n_words
    OR 10 * n_stutters > 3 * n_words) AS kept,
  ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT
    + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
    + 32 * (word_chars > 16 * n_words)::BIGINT + 64 * (10 * n_bangs > n_words)::BIGINT
    + 128 * (10 * n_stutters > 3 * n_words)::BIGINT)::BIGINT AS failures
FROM m
"""


@query("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document and the verdict of the current policy."""
    from tessera.llm.quality_rules import kept, ledger

    led = ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (~kept("base")).alias("base_failed"), kept("v2").alias("kept"), "failures")


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the share of the item's shingles."""
    from tessera.llm.decontam import search

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from tessera.llm.quality_mil import score, train
    from tessera.llm.sampling import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and the flag by its language's threshold."""
    from tessera.llm.sampling import fold
    from tessera.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model, cut = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model, cut, keep=["doc_id", "lang"]).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "threshold", "flagged")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    from tessera.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 200 bytes that occur elsewhere."""
    from tessera.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                      F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_lm_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-mixing scores of every document."""
    from tessera.llm.context_mixing import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite embedding on the leading components of the distinct quantised vectors; ``deviation`` is null beyond 64 bits
    (``deviation_exact`` has it)."""
    from tessera.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained",
        "identity_error", F.col("deviation").alias("deviation_exact"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words of every document (every tenth has a planted periodic tail) and digests of them and of the collapsed text."""
    from tessera.llm.periodic_runs import collapse, strongest, with_planted_tail

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.withColumn("text", with_planted_tail("text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = collapse(planted, keep=["doc_id"]).withColumn("best", strongest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from tessera.llm.language_gru import identify, train
    from tessera.llm.sampling import fold

    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
