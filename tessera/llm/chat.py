"""Chat formatting with Spark expressions only.

Method: the turns of a conversation are collected as structs and sorted,
adjacent turns of the same role are merged into blocks by array aggregation,
and the blocks are concatenated.  A control string inside a text gets one
backslash in front, which ``read_back`` takes off again; the template itself
puts a space in front of every control string, so a backslash there always
means "text".

Template (one line per block)::

    <<SYS>> text <</SYS>>
    [INST] text [NEXT] text [/INST]
    <s> text </s>
    <<ROLE>> role [NEXT] text <</ROLE>>        (any other role)

Rows: a null text or role counts as empty; a null turn sorts first; turns that
tie are ordered by role, then text; repeated rows are separate turns.  A null
conv_id is a conversation of its own.  An empty table gives no rows.  Further
columns are not carried (the result has one row per conversation), so clashing
names cannot arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Opening and closing control string of each known role.
TEMPLATE = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE>>", "<</ROLE>>")
NEXT = "[NEXT]"
CONTROL = [c for pair in [*TEMPLATE.values(), OTHER] for c in pair] + [NEXT]


def _any(strings) -> str:
    return "(" + "|".join(s.replace("[", r"\[").replace("]", r"\]") for s in strings) + ")"


CONTROL_REGEX = _any(CONTROL)


def escape(c: Column) -> Column:
    """A backslash in front of every control string."""
    return F.regexp_replace(c, CONTROL_REGEX, r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\" + CONTROL_REGEX, "$1")


def _open(role: Column) -> Column:
    out = F.lit(OTHER[0])
    for name, (a, _) in TEMPLATE.items():
        out = F.when(role == name, F.lit(a)).otherwise(out)
    return out


def _close(role: Column) -> Column:
    out = F.lit(OTHER[1])
    for name, (_, b) in TEMPLATE.items():
        out = F.when(role == name, F.lit(b)).otherwise(out)
    return out


SUMS = "struct<total:bigint,sums:array<bigint>>"


def _fold(sizes: Column, size) -> Column:
    """(total, sums): the running sum before every element of a short array."""
    return F.aggregate(
        sizes, F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("sums")).cast(SUMS),
        lambda acc, x: F.struct((acc["total"] + size(x)).alias("total"), F.concat(acc["sums"], F.array(acc["total"])).alias("sums")).cast(SUMS))


def _sums_in_pieces(sizes: str) -> Column:
    """Running sums of a long array in pieces of the root of its length, since a fold copies its array at each step."""
    n = F.size(sizes)
    width = F.ceil(F.sqrt(n)).cast("int")
    return F.transform(F.sequence(F.lit(1), n, width), lambda i: _fold(F.slice(sizes, i, width), lambda x: x))


def _running(pieces: str) -> Column:
    """Running sums of the whole array from those of its pieces."""
    return F.flatten(F.zip_with(pieces, _fold(F.col(pieces), lambda x: x["total"])["sums"], lambda x, base: F.transform(x["sums"], lambda v: v + base)))


def format_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``key``, ``formatted``, and ``loss_mask``, the spans of
    ``formatted`` (start from 1 and length, in code points) that hold assistant texts."""
    one = turns.select(
        F.col(key).alias("k"),
        F.struct(F.col(turn).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("r"),
                 F.coalesce(F.col(text), F.lit("")).alias("t")).alias("s"))
    conv = one.groupBy("k").agg(F.sort_array(F.collect_list("s")).alias("turns"))
    conv = conv.withColumn("parts", F.transform("turns", lambda x: F.struct(x["r"].alias("r"), escape(x["t"]).alias("t"))))
    # Blocks: (role, escaped texts), cut where the role differs from that of the turn before.
    role_at = lambda i: F.get("parts", i)["r"]
    conv = conv.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1))))
    conv = conv.withColumn("blocks", F.transform("starts", lambda i, j: F.struct(
        role_at(i).alias("r"),
        F.transform(F.slice("parts", i + 1, F.coalesce(F.get("starts", j + 1), F.size("parts")) - i), lambda x: x["t"]).alias("ts"))))
    known = lambda r: r.isin(*TEMPLATE)
    line = lambda b: F.concat(
        _open(b["r"]), F.lit(" "),
        F.when(known(b["r"]), F.lit("")).otherwise(F.concat(escape(b["r"]), F.lit(f" {NEXT} "))),
        F.array_join(b["ts"], f" {NEXT} "), F.lit(" "), _close(b["r"]), F.lit("\n"))
    conv = conv.withColumn("lines", F.transform("blocks", line))
    # Spans of assistant texts: what stands before and after each text, and where its turn begins.
    first, last = (lambda x, i: (i == 0) | (role_at(i - 1) != x["r"])), (lambda x, i: F.coalesce(role_at(i + 1) != x["r"], F.lit(True)))
    before = lambda x: F.length(_open(x["r"])) + 1 + F.when(known(x["r"]), 0).otherwise(F.length(escape(x["r"])) + len(NEXT) + 2)
    conv = conv.withColumn("steps", F.transform("parts", lambda x, i: F.struct(
        x["r"].alias("r"), F.length(x["t"]).cast("bigint").alias("n"),
        F.when(first(x, i), before(x)).otherwise(len(NEXT) + 2).cast("bigint").alias("before"),
        F.when(last(x, i), F.length(_close(x["r"])) + 2).otherwise(0).cast("bigint").alias("after"))))
    conv = conv.withColumn("sizes", F.transform("steps", lambda x: x["before"] + x["n"] + x["after"]))
    conv = conv.withColumn("sums", _sums_in_pieces("sizes")).withColumn("at", _running("sums"))
    spans = F.zip_with("steps", "at", lambda x, at: F.struct(x["r"].alias("r"), (at + x["before"] + 1).alias("start"), x["n"].alias("len")))
    mask = F.transform(F.filter(spans, lambda x: x["r"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len")))
    return conv.select(F.col("k").alias(key), F.array_join("lines", "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame, column: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """Parse formatted conversations: adds ``turns`` (array of role and text) and ``loss_text``
    (the texts under the mask, unescaped and joined)."""
    closes = [b for _, b in [*TEMPLATE.values(), OTHER]]
    blocks = F.filter(F.split(F.col(column), f" {_any(closes)}\n"), lambda b: b != "")
    kind = "array<struct<role:string,text:string>>"

    def texts(b, opened):
        return F.split(F.substr(b, F.lit(len(opened) + 2)), " " + _any([NEXT]) + " ")

    def turns_of(role, parts):
        return F.transform(parts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    def parse(b):
        other = texts(b, OTHER[0])
        out = turns_of(unescape(F.element_at(other, 1)), F.slice(other, 2, F.greatest(F.size(other) - 1, F.lit(0))))
        for name, (a, _) in TEMPLATE.items():
            out = F.when(F.startswith(b, F.lit(a + " ")), turns_of(F.lit(name), texts(b, a))).otherwise(out)
        return out.cast(kind)

    def text_of(wide, s):
        return unescape(F.decode(F.substr(wide, ((s["start"] - 1) * 4 + 1).cast("int"), (s["len"] * 4).cast("int")), "UTF-32"))

    # With four bytes a code point a span is found without a walk from the start; as the element of an
    # array the bytes are handed on, not copied for each span.
    joined = F.transform(F.array(F.encode(column, "UTF-32")), lambda wide: F.array_join(F.transform(F.col(mask), lambda s: text_of(wide, s)), ""))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, parse))).withColumn("loss_text", F.get(joined, F.lit(0)))
