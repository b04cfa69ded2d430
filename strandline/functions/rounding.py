"""Rounding in its several senses, and numbers of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scale(dp: int) -> Column:
    return F.lit(10.0**dp)


def round_half_up(x: Column, dp: int = 0) -> Column:
    """Halves go up, towards +infinity; on decimals, so that 0.5 is 0.5."""
    d = x.cast("decimal(28,9)")
    if dp < 0:
        unit = 10**-dp
        return (F.floor(d / F.lit(unit) + F.lit(0.5).cast("decimal(2,1)")) * unit).cast("decimal(28,9)")
    unit = F.lit(10**dp).cast("decimal(10,0)")
    return (F.floor(d * unit + F.lit(0.5).cast("decimal(2,1)")).cast("decimal(28,0)") / unit).cast("decimal(28,9)")


def normal_round(x: Column, dp: int = 0) -> Column:
    """Halves go away from zero, in floating point."""
    return F.signum(x) * F.floor(F.abs(x) * _scale(dp) + 0.5) / _scale(dp)


def truncate(x: Column, dp: int = 0) -> Column:
    """Towards zero."""
    y = x * _scale(dp)
    return F.when(x >= 0, F.floor(y)).otherwise(F.ceil(y)) / _scale(dp)


def round_sf(x: Column, n: int = 2) -> Column:
    """To n significant figures, halves to even."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) + 1 - n)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / unit) * unit)


def round_scaled(x: Column, n: int = 0) -> Column:
    """A double to n places as C's round and most databases do: scaled in binary, halves away from zero, the sign of zero kept.

    Spark's ``round`` goes by the shortest decimal instead: of 11.692320326499999, which times 10**9 is a half exactly, it makes
    the number below at nine places, and 0.0 of a small negative number.
    """
    scaled = F.abs(x) * F.lit(10.0**n)
    return F.when(scaled < float("inf"), F.signum(x) * F.round(scaled) / F.lit(10.0**n)).otherwise(x)


def plain_decimal(x: Column) -> Column:
    """A decimal as text without exponent or needless zeros."""
    text = F.format_string("%s", x.cast("decimal(38,18)").cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def decimal_places(x: Column) -> Column:
    """Digits after the point of a number written as text."""
    return F.length(F.regexp_extract(x, r"\.(\d*)$", 1))


def roundable_to(y: Column, dp: int = 0) -> Column:
    """The half-open range [low, high) of numbers that ``round_half_up`` takes to y."""
    half = F.lit(0.5) / _scale(dp)
    return F.struct((y - half).alias("low"), (y + half).alias("high"))


def truncatable_to(y: Column, dp: int = 0) -> Column:
    """Ends of the range of numbers that ``truncate`` takes to y: [y, y+u), (y-u, y], or (-u, u) for zero."""
    unit = F.lit(1.0) / _scale(dp)
    return F.struct(F.when(y > 0, y).otherwise(y - unit).alias("low"), F.when(y < 0, y).otherwise(y + unit).alias("high"))
