"""Helpers that several of the operators share."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words as a bigint; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def count_at_most(sorted_values: Column, length: int, value: Column) -> Column:
    """How many elements of an ascending array are not above `value`, by binary search."""
    if length == 0:
        return F.lit(0)
    widths = [1 << k for k in reversed(range(math.floor(math.log2(length)) + 1))]

    def step(found: Column, wide: Column) -> Column:
        return F.when(F.get(sorted_values, found + wide - 1) <= value, found + wide).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if it has few rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df
