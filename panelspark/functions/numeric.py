"""Rounding, percentages and lenient casts. All JVM-side column expressions.

Two half-even roundings exist because the results to match come from two:
``round_scaled`` scales, rounds to the nearest even integer and scales back (what
numpy and pandas do); ``round_exact`` rounds the exact binary value (what
Python's own ``round`` does). They differ only on values such as 0.15, whose
nearest double is not exactly a tie.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHITESPACE = " \t\n\r\f\x0b"

# Veltkamp constant 2^27 + 1: splits a double into two 26-bit halves.
_SPLIT = 134217729.0


def round_scaled(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value."""
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def round_exact(x: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value.

    The scaled value can land on a tie only through its own rounding error;
    the error (Dekker's product) then says on which side the exact value lies.
    """
    scale = float(10**digits)
    y = x * F.lit(scale)
    t = x * F.lit(_SPLIT)
    hi = t - (t - x)
    err = (hi * F.lit(scale) - y) + (x - hi) * F.lit(scale)
    tie = F.abs(y - F.rint(y)) == 0.5
    nearest = (
        F.when(tie & (err > 0), F.floor(y).cast("double") + 1.0)
        .when(tie & (err < 0), F.floor(y).cast("double"))
        .otherwise(F.rint(y))
    )
    return nearest / F.lit(scale)


def pct_change_guarded(old: Column, new: Column, rounding=round_exact, digits: int = 1) -> Column:
    """Percent change; 0.0 when the base is not positive."""
    return F.when(old > 0, rounding(F.try_divide(new - old, old) * 100.0, digits)).otherwise(F.lit(0.0))


def pct_change_null(old: Column, new: Column, digits: int = 1) -> Column:
    """Percent change; NULL when the base is zero."""
    return round_scaled(F.try_divide(new - old, old) * 100.0, digits)


def share_pct(part: Column, whole: Column, rounding=round_exact, digits: int = 1) -> Column:
    """Part of the whole in percent; 0.0 when the whole is not positive."""
    return F.when(whole > 0, rounding(F.try_divide(part, whole) * 100.0, digits)).otherwise(F.lit(0.0))


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def to_number(c: Column) -> Column:
    """Text to double; NULL when it is not a plain decimal number."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def to_count(c: Column) -> Column:
    """Text to bigint, truncated towards zero; NULL when it is not a number."""
    return to_number(c).try_cast("bigint")


def clamp_count(c: Column) -> Column:
    """Nearest whole number, not below zero."""
    return F.greatest(F.lit(0).cast("bigint"), F.rint(c).cast("bigint"))
