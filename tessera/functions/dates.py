"""Date calculation functions.

Semantics kept from the BI language:
* weeks start on Sunday and week 1 is the week holding January 1 (WEEKNUM);
* DATEDIFF counts boundaries crossed (Jan 31 -> Feb 1 is one month);
* date inputs stay dates, timestamp inputs stay timestamps (NTZ stays NTZ).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import c, lit_or_col

# Date-part names accepted (lower case) and their Spark units.
PART_UNITS = {
    "year": "YEAR", "quarter": "QUARTER", "month": "MONTH", "week": "WEEK",
    "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND",
}


def _part(part: str) -> str:
    p = part.lower().strip()
    aliases = {"yyyy": "year", "yy": "year", "qq": "quarter", "q": "quarter", "mm": "month",
               "m": "month", "dd": "day", "d": "day", "ww": "week", "wk": "week",
               "hh": "hour", "mi": "minute", "n": "minute", "ss": "second", "s": "second",
               "dw": "weekday", "dy": "dayofyear", "y": "dayofyear"}
    return aliases.get(p, p)


def dateadd(part: str, n, d, is_date: bool = False) -> Column:
    """DATEADD(part, n, d). Month arithmetic clamps to the month end.

    ``is_date=True`` keeps a DATE result for DATE input.
    """
    p = _part(part)
    unit = PART_UNITS[p]
    out = F.timestamp_add(unit, lit_or_col(n), c(d))
    return out.cast("date") if is_date else out


def _ts(d) -> Column:
    return c(d).cast("timestamp_ntz")


def week_start(d) -> Column:
    """Sunday on or before the date (Spark's own weeks start on Monday)."""
    day = c(d).cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1)


def _epoch_days(d) -> Column:
    return F.datediff(c(d).cast("date"), F.lit(_dt.date(1970, 1, 1)))


def datediff(part: str, a, b) -> Column:
    """DATEDIFF(part, a, b): number of part boundaries between a and b."""
    p = _part(part)
    a, b = c(a), c(b)
    if p == "year":
        return (F.year(b) - F.year(a)).cast("long")
    if p == "quarter":
        return ((F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))).cast("long")
    if p == "month":
        return ((F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))).cast("long")
    if p == "week":
        return (F.datediff(week_start(b), week_start(a)) / 7).cast("long")
    if p == "day":
        return F.datediff(b.cast("date"), a.cast("date")).cast("long")
    secs = {"hour": 3600, "minute": 60, "second": 1}[p]
    ua, ub = _wall_seconds(a), _wall_seconds(b)
    return (F.floor(ub / secs) - F.floor(ua / secs)).cast("long")


def _wall_seconds(d) -> Column:
    """Seconds since 1970-01-01 00:00 on the wall clock (no time-zone shift,
    so boundary counts do not depend on the session time zone or DST)."""
    t = _ts(d)
    return (_epoch_days(t).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
            + F.floor(F.second(t))).cast("long")


# DATENAME text patterns.
_NAME_PATTERNS = {"month": "MMMM", "weekday": "EEEE"}


def datename(part: str, d) -> Column:
    """DATENAME(part, d): month and weekday as names, other parts as digits."""
    p = _part(part)
    if p in _NAME_PATTERNS:
        return F.date_format(c(d), _NAME_PATTERNS[p])
    return datepart(p, d).cast("string")


def dateparse(fmt: str, s) -> Column:
    """DATEPARSE(format, s) with a Java date pattern; null when it does not parse."""
    return F.try_to_timestamp(c(s), F.lit(fmt)).cast("timestamp_ntz")


def week(d) -> Column:
    """WEEK(d): Sunday-start week of year, January 1 in week 1."""
    d = c(d)
    jan1 = F.trunc(d.cast("date"), "year")
    return (F.floor((F.dayofyear(d) + F.dayofweek(jan1) - 2) / 7) + 1).cast("int")


def datepart(part: str, d) -> Column:
    """DATEPART(part, d) as an integer."""
    p = _part(part)
    d = c(d)
    fn = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth,
        "hour": F.hour, "minute": F.minute, "weekday": F.dayofweek,
        "dayofyear": F.dayofyear, "week": week,
    }
    if p == "second":
        return F.floor(F.second(d)).cast("int")
    if p == "iso-week":
        return F.weekofyear(d)
    return fn[p](d).cast("int")


def year(d) -> Column:
    return F.year(c(d))


def month(d) -> Column:
    return F.month(c(d))


def day(d) -> Column:
    return F.dayofmonth(c(d))


def quarter(d) -> Column:
    return F.quarter(c(d))


def datetrunc(part: str, d, is_date: bool = False) -> Column:
    """DATETRUNC(part, d): start of the period (weeks start on Sunday)."""
    p = _part(part)
    d = c(d)
    if p == "week":
        out = week_start(d).cast("timestamp_ntz")
    else:
        out = F.date_trunc(PART_UNITS[p], d).cast("timestamp_ntz")
    return out.cast("date") if is_date else out


def isdate(s) -> Column:
    """ISDATE(s): true when the text reads as a date or timestamp."""
    s = c(s)
    return F.when(s.isNull(), F.lit(False)).otherwise(
        F.try_to_timestamp(s).isNotNull())


def makedate(y, m, d) -> Column:
    """MAKEDATE(y, m, d); null for an invalid day."""
    return F.try_make_timestamp_ntz(lit_or_col(y), lit_or_col(m), lit_or_col(d),
                                    F.lit(0), F.lit(0), F.lit(0)).cast("date")


def makedatetime(date, time) -> Column:
    """MAKEDATETIME(date, time): date part of the first, clock part of the second
    (a timestamp or an 'HH:mm:ss' string)."""
    dt = c(date)
    tm = c(time)
    t = F.coalesce(F.try_to_timestamp(tm.cast("string"), F.lit("HH:mm:ss")),
                   tm.cast("string").try_cast("timestamp"))
    return F.try_make_timestamp_ntz(F.year(dt), F.month(dt), F.dayofmonth(dt),
                                    F.hour(t), F.minute(t), F.second(t))


def maketime(h, m, s) -> Column:
    """MAKETIME(h, m, s) as 'HH:mm:ss' text (time maps to string)."""
    h, m, s = lit_or_col(h), lit_or_col(m), lit_or_col(s)
    ok = (h >= 0) & (h < 24) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60)
    return F.when(ok, F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int")))


def now() -> Column:
    return F.current_timestamp()


def today() -> Column:
    return F.current_date()


def date_literal(value: str | _dt.date | _dt.datetime) -> Column:
    """#2024-01-15# style literal."""
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value) if len(value) <= 10 else _dt.datetime.fromisoformat(value)
    return F.lit(value)
