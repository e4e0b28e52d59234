"""Math calculation functions; undefined inputs give null, never errors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import c, lit_or_col


def abs_(x) -> Column:
    return F.abs(c(x))


def ceiling(x) -> Column:
    return F.ceil(c(x))


def floor(x) -> Column:
    return F.floor(c(x))


def round_(x, digits: int = 0) -> Column:
    """ROUND(x[, d]): half away from zero."""
    return F.round(c(x), digits)


def round_fast(x, digits: int = 0) -> Column:
    """ROUND of a double by its nearest multiple, halves away from zero, without Spark's decimal text: for magnitudes whose
    multiples fit a long.  Null, NaN and infinities stay."""
    x = c(x)
    y = F.abs(x) * 10.0**digits
    r = (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / F.lit(10.0**digits)
    return F.when(y < 2.0**52, F.when(x < 0, -r).otherwise(r)).otherwise(x)


def power(x, p) -> Column:
    return F.pow(c(x), lit_or_col(p))


def sqrt(x) -> Column:
    x = c(x)
    return F.when(x >= 0, F.sqrt(x))


def square(x) -> Column:
    x = c(x)
    return x * x


def log(x, base: float | None = None) -> Column:
    """LOG(x[, base]): base 10 by default; null for x <= 0."""
    x = c(x)
    if base is None:
        return F.when(x > 0, F.log10(x))
    return F.when(x > 0, F.log(float(base), x))


def ln(x) -> Column:
    x = c(x)
    return F.when(x > 0, F.ln(x))


def exp(x) -> Column:
    return F.exp(c(x))


def sign(x) -> Column:
    return F.signum(c(x)).cast("int")


def pi() -> Column:
    return F.pi()


def sin(x) -> Column:
    return F.sin(c(x))


def cos(x) -> Column:
    return F.cos(c(x))


def tan(x) -> Column:
    return F.tan(c(x))


def acos(x) -> Column:
    x = c(x)
    return F.when((x >= -1) & (x <= 1), F.acos(x))


def asin(x) -> Column:
    x = c(x)
    return F.when((x >= -1) & (x <= 1), F.asin(x))


def atan(x) -> Column:
    return F.atan(c(x))


def cot(x) -> Column:
    x = c(x)
    return F.when(F.tan(x) != 0, F.cot(x))


def atan2(y, x) -> Column:
    """ATAN2(y, x); null at the origin."""
    y, x = c(y), c(x)
    return F.when((x != 0) | (y != 0), F.atan2(y, x))


def degrees(x) -> Column:
    return F.degrees(c(x))


def radians(x) -> Column:
    return F.radians(c(x))


def div(a, b) -> Column:
    """DIV(a, b): integer quotient truncated toward zero; null when b = 0."""
    a, b = c(a).cast("long"), lit_or_col(b).cast("long")
    return F.when(b != 0, F.call_function("div", a, b))


def mod(a, b) -> Column:
    """MOD(a, b): remainder with the sign of the dividend; null when b = 0."""
    return F.try_mod(c(a), lit_or_col(b))


# Hexagonal bins of side length 1, pointy-top orientation.  The centres form
# two offset rectangular lattices; the nearest centre is the nearer of the two
# per-lattice nearest points (fixed geometry constants below).
_HEX_W = math.sqrt(3.0)   # horizontal spacing of centres in one row
_HEX_H = 3.0              # vertical period of the lattice (two rows)


def _hex_nearest(x: Column, y: Column):
    ax = F.round(x / _HEX_W) * _HEX_W
    ay = F.round(y / _HEX_H) * _HEX_H
    bx = (F.floor(x / _HEX_W) + 0.5) * _HEX_W
    by = (F.floor(y / _HEX_H) + 0.5) * _HEX_H
    da = (x - ax) * (x - ax) + (y - ay) * (y - ay)
    db = (x - bx) * (x - bx) + (y - by) * (y - by)
    use_a = da <= db
    return F.when(use_a, ax).otherwise(bx), F.when(use_a, ay).otherwise(by)


def hexbinx(x, y) -> Column:
    """HEXBINX(x, y): x of the nearest hexagon centre."""
    return _hex_nearest(c(x).cast("double"), c(y).cast("double"))[0]


def hexbiny(x, y) -> Column:
    """HEXBINY(x, y): y of the nearest hexagon centre."""
    return _hex_nearest(c(x).cast("double"), c(y).cast("double"))[1]
