"""Casts, logic and number formatting (Column -> Column)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import c, lit_or_col


def to_integer(x: Column, t: str = "bigint") -> Column:
    """Toward zero, exact for every 64-bit integer: whole numbers (and text that
    is one) cast directly, other text through a decimal, so '1.5' gives 1 and
    '9007199254740993' keeps its last digit.  What does not convert is null."""
    text = x.cast("string")
    return F.coalesce(x.try_cast("bigint"), text.try_cast("decimal(38,10)").try_cast("bigint")).try_cast(t)


def int_(x) -> Column:
    """INT(x): toward zero."""
    return to_integer(c(x))


def float_(x) -> Column:
    return c(x).try_cast("double")


def str_(x) -> Column:
    return c(x).cast("string")


def date(x) -> Column:
    return c(x).try_cast("date")


def datetime(x) -> Column:
    return c(x).try_cast("timestamp_ntz")


def case(expr, whens: Sequence[tuple], else_=None) -> Column:
    """CASE expr WHEN v THEN r ... ELSE e END."""
    e = c(expr)
    out = None
    for v, r in whens:
        cond = e == lit_or_col(v)
        out = F.when(cond, lit_or_col(r)) if out is None else out.when(cond, lit_or_col(r))
    return out.otherwise(lit_or_col(else_)) if else_ is not None else out


def if_(branches: Sequence[tuple], else_=None) -> Column:
    """IF c1 THEN r1 ELSEIF c2 THEN r2 ... [ELSE e] END; no ELSE -> null."""
    out = None
    for cond, r in branches:
        out = F.when(cond, lit_or_col(r)) if out is None else out.when(cond, lit_or_col(r))
    return out.otherwise(lit_or_col(else_)) if else_ is not None else out


def iif(test, then, else_, unknown=None) -> Column:
    """IIF(test, then, else[, unknown]): unknown when the test is null."""
    t = c(test)
    return F.when(t.isNull(), lit_or_col(unknown)).when(t, lit_or_col(then)).otherwise(lit_or_col(else_))


def ifnull(x, alt) -> Column:
    return F.coalesce(c(x), lit_or_col(alt))


def zn(x) -> Column:
    return F.coalesce(c(x), F.lit(0))


def isnull(x) -> Column:
    return c(x).isNull()


def isnumber(x) -> Column:
    return c(x).try_cast("double").isNotNull()


def and_(a, b) -> Column:
    return c(a) & c(b)


def or_(a, b) -> Column:
    return c(a) | c(b)


def not_(a) -> Column:
    return ~c(a)


def eq(a, b) -> Column:
    return lit_or_col(a) == lit_or_col(b)


def ne(a, b) -> Column:
    return lit_or_col(a) != lit_or_col(b)


def in_(x, values) -> Column:
    return c(x).isin(list(values))


_FMT = re.compile(r"^(?P<prefix>[^#0,.%]*)(?P<body>[#0,]*(?:\.0+)?)(?P<pct>%?)(?P<suffix>.*)$")


def format_number(x, fmt: str) -> Column:
    """Number -> text by a display format such as '#,##0.00', '0.0%', '$#,##0'.

    Grouping and decimals come from the pattern; '%' multiplies by 100.
    """
    m = _FMT.match(fmt)
    if not m:
        raise ValueError(f"unsupported number format {fmt!r}")
    body = m.group("body")
    decimals = len(body.split(".")[1]) if "." in body else 0
    grouping = "," in body
    v = c(x).cast("double")
    if m.group("pct"):
        v = v * 100
    # DecimalFormat rounding (half-even on the exact binary value) either way.
    txt = F.format_number(v, decimals)
    if not grouping:
        txt = F.regexp_replace(txt, ",", "")
    return F.concat(F.lit(m.group("prefix")), txt, F.lit(m.group("pct") + m.group("suffix")))
