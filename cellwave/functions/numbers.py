"""Column functions for the spellings of numbers in traffic exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def clean_decimal(value: Column) -> Column:
    """A double from a text with a decimal comma and other characters around it; null where what is left is no number."""
    kept = F.regexp_replace(F.replace(value.cast("string"), F.lit(","), F.lit(".")), r"[^0-9.\-eE]", "")
    return F.when(kept.rlike(NUMBER), kept).try_cast("double")


def to_number(value: Column) -> Column:
    """A double from a text that is a number as it stands, infinite ones too; else, and for NaN, null. Numbers stay."""
    text = value.cast("string")
    number = F.when(text.rlike(NUMBER) | text.rlike(INFINITE), F.trim(text)).try_cast("double")
    return F.when(~F.isnan(number), number)
