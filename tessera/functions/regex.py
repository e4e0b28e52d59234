"""Regular-expression calculation functions (Java regex, evaluated in the JVM)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import c


def _groups(pattern: str) -> int:
    try:
        return re.compile(pattern).groups
    except re.error:
        return 1


def regexp_match(s, pattern: str) -> Column:
    """REGEXP_MATCH(s, pattern): true when the pattern occurs anywhere."""
    return c(s).rlike(pattern)


def regexp_extract(s, pattern: str) -> Column:
    """REGEXP_EXTRACT(s, pattern): first capture group (whole match when the
    pattern has no group); null when there is no match."""
    s = c(s)
    idx = 1 if _groups(pattern) >= 1 else 0
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, idx))


def regexp_extract_nth(s, pattern: str, n: int) -> Column:
    """REGEXP_EXTRACT_NTH(s, pattern, n): n-th capture group, null on no match."""
    s = c(s)
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, int(n)))


def regexp_replace(s, pattern: str, replacement: str) -> Column:
    """REGEXP_REPLACE(s, pattern, repl): every match replaced ($1 back-references)."""
    return F.regexp_replace(c(s), pattern, replacement)
