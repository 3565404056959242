"""Array functions on token contexts and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def left_truncate(tokens: Column, length: int) -> Column:
    """The last `length` entries; shorter arrays stay as they are."""
    start = F.greatest(F.size(tokens) - length, F.lit(0)) + 1
    return F.slice(tokens, start, F.lit(length))


def cut_at_stop(tokens: Column, stop: int, max_new: int) -> Column:
    """Entries before the first `stop`, at most `max_new` of them."""
    head = F.slice(tokens, 1, max_new)
    at = F.array_position(head, stop).cast("int")
    return F.when(at > 0, F.slice(head, F.lit(1), at - 1)).otherwise(head)


def rms_normalise(vector: Column, eps: float = 1e-5, weight: Column | None = None) -> Column:
    """x / sqrt(mean(x^2) + eps), in double, times an optional weight vector."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    scale = F.sqrt(squares / F.size(vector) + F.lit(eps))
    if weight is None:
        return F.transform(vector, lambda x: x.cast("double") / scale)
    return F.zip_with(vector, weight, lambda x, w: w.cast("double") * x.cast("double") / scale)


def running_sums(values: Column) -> Column:
    """Running sums of a bigint array, in one pass; a built-in fold would copy the sums at each entry."""

    @F.pandas_udf("array<bigint>")
    def sums(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else np.cumsum(row))

    return sums(values)
