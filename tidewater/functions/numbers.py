"""Lenient numbers: reading them from text, and writing them the short way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leading decimal number, as a lenient parser reads it once all but digits and dots is gone.
LEADING_NUMBER = r"^(\d+\.?\d*|\.\d+)"


def to_number(text: Column, number: Column | None = None) -> Column:
    """The number in ``text``: digits and dots only, then the longest decimal prefix; null where there is none.

    So ``rs. 5,000`` is 0.5, ``5 lakh`` 5 and ``-5`` 5. ``number``, where not null, is taken as
    it is: values that were numbers from the start keep their sign.
    """
    digits = F.regexp_replace(text, r"[^0-9.]", "")
    parsed = F.regexp_extract(digits, LEADING_NUMBER, 1).try_cast("double")
    return parsed if number is None else F.coalesce(number.cast("double"), parsed)


def round_half_up(x: Column) -> Column:
    """The nearest integer, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def to_integer(text: Column, number: Column | None = None) -> Column:
    return round_half_up(to_number(text, number))


def two_places(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)) / 100


def clamp(x: Column, low: float, high: float) -> Column:
    """``x``, which must not be null, within bounds."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def short_number(x: Column, missing: str = "null") -> Column:
    """A number in its shortest decimal form: integers without a fraction, no exponent."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(30,6)").cast("string"), "0+$", ""), r"\.$", "")
    text = F.when(whole, x.cast("long").cast("string")).when(F.abs(x) >= 1e7, plain).otherwise(x.cast("string"))
    return F.coalesce(text, F.lit(missing))


def card_number(x: Column) -> Column:
    """One decimal place, as shown on a product card."""
    return F.format_string("%.1f", x)


def percent_label(weight: Column) -> Column:
    return F.concat(round_half_up(weight * 100).cast("string"), F.lit("%"))


def first_dash_to_space(text: Column) -> Column:
    """Only the first hyphen becomes a space."""
    return F.regexp_replace(text, "^([^-]*)-", "$1 ")
