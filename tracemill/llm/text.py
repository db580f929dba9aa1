"""Column expressions that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, and the letters that are lower-cased.
SPACE = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words ``words`` finds, without making them twice."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    blank = (F.element_at(parts, 1) == "").cast("long")
    tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.size(parts).cast("long") - blank - tail


def keyed(found: DataFrame, key: str) -> DataFrame:
    """``found`` with its first column named ``key``; a result column of that very name gets an underscore in front."""
    first, *others = found.columns
    return found.select(F.col(first).alias(key), *[F.col(c).alias(f"_{c}" if c == key else c) for c in others])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
