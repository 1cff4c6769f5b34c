"""Numeric columns: exact sums, half-up rounding and strict number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: plain decimal or exponent text. Spark's own cast also takes 1d, 1f, NaN and inf.
LARGEST = 1e15  # measures beyond this are no readings; sums of decimals hold far more
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def exact(value: Column | str) -> Column:
    """A measure as decimal with eight places, so that sums are the same in any order; beyond `LARGEST` null."""
    return col_of(value).try_cast("decimal(28,8)")


def exact_sum(value: Column | str) -> Column:
    return F.sum(exact(value))


def half_up(value: Column | str, digits: int = 2) -> Column:
    """Round halves towards plus infinity, so -2.5 becomes -2."""
    scale = float(10**digits)
    scaled = F.floor(col_of(value).cast("double") * F.lit(scale) + F.lit(0.5))
    return scaled.cast("double") / F.lit(scale)


def sql_round(value: Column | str, digits: int = 2) -> Column:
    """Double rounding as analytic SQL engines do it: scale, halves away from zero, scale back.

    Spark's own round works on the decimal text of the double and differs for
    values such as 1.005.
    """
    x, scale = col_of(value).cast("double"), float(10**digits)
    size = F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(x < 0, -size).otherwise(size)


def half_up_int(value: Column | str) -> Column:
    return F.floor(col_of(value).cast("double") + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column, empty: int | None = 0) -> Column:
    """Whole-number percentage, `empty` when there is nothing to count."""
    rate = half_up_int(part.cast("double") / whole.cast("double") * F.lit(100.0))
    return F.when(whole > 0, rate).otherwise(F.lit(empty).cast("long"))


def is_number(text: Column | str) -> Column:
    return col_of(text).rlike(PLAIN_NUMBER)


def parse_number(text: Column | str) -> Column:
    """The number in a text, null when it is none or beyond `LARGEST`."""
    number = F.when(is_number(text), col_of(text).try_cast("double"))
    return F.when(F.abs(number) <= LARGEST, number)


def number_text(value: Column | str) -> Column:
    """Shortest plain text of a double: -12.5, -12, 0.25."""
    plain = col_of(value).try_cast("decimal(38,18)").cast("string")
    return F.coalesce(F.regexp_replace(plain, r"^(-?[0-9]+(?:\.[0-9]*[1-9])?)\.?0*$", "$1"), col_of(value).cast("string"))


def pad_left(value: Column | str, width: int) -> Column:
    """Zero-pad short text and leave longer text whole (lpad would cut it)."""
    text = col_of(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
