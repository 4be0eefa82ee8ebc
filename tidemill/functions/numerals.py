"""Kanji numerals in three readings, as Arrow functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
DIGITS = "〇一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000}


def read(text: str | None, units: str = "十百千", places: bool = True, first_year: bool = False) -> int | None:
    """A number in ASCII or full-width digits, in units, or (``places``) digit by digit; None where the reading doesn't allow it.

    ``first_year`` reads 元 as 1, as years of an era are written.
    """
    text = unicodedata.normalize("NFKC", text or "").strip()
    if first_year and text == "元":
        return 1
    if text.isascii() and text.isdigit():
        return int(text)
    values = [DIGITS.find(c) if c in DIGITS else UNITS[c] if c in units else None for c in text.replace("零", "〇")]
    if not values or None in values:
        return None
    if max(values) < 10:  # no unit
        return int("".join(map(str, values))) if places or len(values) == 1 else None
    total = now = 0
    for v in values:
        total, now = (total, v) if v < 10 else (total + (now or 1) * v, 0)
    return total + now


def _column(**reading):
    @F.pandas_udf(T.LongType())
    def column(text: pd.Series) -> pd.Series:
        return text.map(lambda t: read(t, **reading)).astype("Int64")

    return column


#: To hundreds, by units alone.
short_number = _column(units="十百", places=False)
#: To thousands, by units or by places, 元 as 1.
free_number = _column(first_year=True)
#: To thousands, by units or by places.
strict_number = _column()
