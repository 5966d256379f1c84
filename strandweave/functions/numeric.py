"""Guarded arithmetic on columns and bounded option parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_or_zero(num: Column, den: Column) -> Column:
    """``num / den``, or 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def ceil_div(num: Column, den: Column) -> Column:
    """Quotient of positive integers rounded up, exact over the whole range of a long."""
    num, den = num.cast("long"), den.cast("long")
    return F.call_function("div", num, den) + F.when(num % den == 0, 0).otherwise(1)


def mod_or_zero(num: Column, den: Column) -> Column:
    """``num % den``, or 0 where the modulus is 0."""
    return F.when(den == 0, F.lit(0)).otherwise(num % F.when(den == 0, F.lit(1)).otherwise(den))


def percent_of(part: Column, whole: Column) -> Column:
    return div_or_zero(part * F.lit(100.0), whole)


def parse_bounded_int(text: str, option: str, low: int, high: int | None = None) -> int:
    """Option value as an integer within ``[low, high]``; raises ``ValueError`` otherwise."""
    try:
        value = int(text)
    except ValueError:
        raise ValueError(f"{option}: {text!r} is not an integer") from None
    if value < low or (high is not None and value > high):
        bound = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ValueError(f"{option}: {value} is not {bound}")
    return value
