"""String calculation functions (Column -> Column).

Argument order follows the BI calculation language (string first).  All are
built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import c, lit_or_col


def ascii_(s) -> Column:
    """ASCII(s): code point of the first character."""
    return F.ascii(c(s))


def char(n) -> Column:
    """CHAR(n): the character with code point n (full Unicode range)."""
    n = lit_or_col(n).cast("long")
    return F.when((n >= 0) & (n <= 0x10FFFF),
                  F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def contains(s, sub) -> Column:
    return F.contains(c(s), lit_or_col(sub))


def startswith(s, sub) -> Column:
    return F.startswith(c(s), lit_or_col(sub))


def endswith(s, sub) -> Column:
    return F.endswith(c(s), lit_or_col(sub))


def find(s, sub, start=None) -> Column:
    """FIND(s, sub[, start]): 1-based position, 0 when absent."""
    if start is None:
        return F.locate(sub, c(s))
    return F.locate(sub, c(s), int(start))


def findnth(s, sub: str, n: int) -> Column:
    """FINDNTH(s, sub, n): position of the n-th occurrence, 0 when fewer."""
    s = c(s)
    occurrences = F.floor((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub))
    return F.when(s.isNull(), F.lit(None)).when(
        occurrences >= n, F.length(F.substring_index(s, sub, n)) + 1).otherwise(F.lit(0))


def left(s, n) -> Column:
    return F.left(c(s), lit_or_col(n))


def right(s, n) -> Column:
    return F.right(c(s), lit_or_col(n))


def mid(s, start, length=None) -> Column:
    """MID(s, start[, len]): 1-based substring."""
    if length is None:
        return F.substr(c(s), lit_or_col(start))
    return F.substr(c(s), lit_or_col(start), lit_or_col(length))


def len_(s) -> Column:
    return F.length(c(s))


def lower(s) -> Column:
    return F.lower(c(s))


def upper(s) -> Column:
    return F.upper(c(s))


def proper(s) -> Column:
    """PROPER(s): first letter of every space-separated word upper-cased."""
    return F.initcap(c(s))


def trim(s) -> Column:
    return F.trim(c(s))


def ltrim(s) -> Column:
    return F.ltrim(c(s))


def rtrim(s) -> Column:
    return F.rtrim(c(s))


def replace(s, old, new) -> Column:
    return F.replace(c(s), lit_or_col(old), lit_or_col(new))


def space(n) -> Column:
    return F.repeat(F.lit(" "), lit_or_col(n))


def split(s, delim: str, token: int = 1) -> Column:
    """SPLIT(s, delim, token): 1-based token, negative counts from the end; 0 -> null."""
    if token == 0:
        return F.lit(None).cast("string")
    return F.split_part(c(s), F.lit(delim), F.lit(token))


def concat(*cols) -> Column:
    """s1 + s2: null when any part is null."""
    return F.concat(*[lit_or_col(x) for x in cols])


def combined_field(fields, separator: str = " ") -> Column:
    """Combined field: members joined by a separator (nulls skipped)."""
    return F.concat_ws(separator, *[c(f).cast("string") for f in fields])


def min2(a, b) -> Column:
    """Row-level MIN(a, b); nulls are skipped."""
    return F.least(lit_or_col(a), lit_or_col(b))


def max2(a, b) -> Column:
    """Row-level MAX(a, b); nulls are skipped."""
    return F.greatest(lit_or_col(a), lit_or_col(b))
