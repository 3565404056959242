"""Running values inside ordered groups, whatever the size of a group.

A plain window puts a whole group into one task. Here the rows are cut into
slices of about equal size along (group, order): a long group spans several
slices, a slice may hold many groups. Windows run inside (group, slice); what a
slice takes over from earlier ones comes from a summary with one row per
(group, slice).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage, join_groups, shuffle_width


def slice_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], slices: int | None = None
) -> DataFrame:
    """`df` with a ``slice`` number that grows along (group, order).

    The order columns must tell all rows of a group apart. Slice borders come
    from Spark's range sampling; the checkpoint fixes them for later passes.
    """
    slices = slices or shuffle_width(df.sparkSession)
    cut = df.repartitionByRange(slices, *group, *order)
    return cut_lineage(cut.withColumn("slice", F.spark_partition_id()))


def running(
    sliced: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    function: Callable[[str], Column] = F.sum,
    inclusive: bool = True,
) -> DataFrame:
    """Add the running `function` (sum or max, from 0) of each bigint in `values`.

    With ``inclusive=False`` a row's own value is left out.
    """
    group = list(group)
    zero = F.lit(0).cast("bigint")
    combine = F.greatest if function is F.max else lambda a, b: a + b
    valued = sliced.withColumns({f"_v_{n}": c.cast("bigint") for n, c in values.items()})
    totals = valued.groupBy(*group, "slice").agg(
        *[function(f"_v_{n}").alias(f"_t_{n}") for n in values]
    )
    earlier = W.partitionBy(*group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *group,
        "slice",
        *[F.coalesce(function(f"_t_{n}").over(earlier), zero).alias(f"_c_{n}") for n in values],
    )
    last = 0 if inclusive else -1
    inside = (
        W.partitionBy(*group, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    )
    local = valued.withColumns(
        {f"_l_{n}": F.coalesce(function(f"_v_{n}").over(inside), zero) for n in values}
    )
    return join_groups(local, carried, group, ["slice"]).select(
        *sliced.columns,
        *[combine(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n in values],
    )


def previous_value(
    sliced: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add the `value` of the row just before, null for the first row of a group."""
    group = list(group)
    lasts = sliced.groupBy(*group, "slice").agg(
        F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("_last")
    )
    carried = lasts.select(
        *group, "slice", F.lag("_last").over(W.partitionBy(*group).orderBy("slice")).alias("_carried")
    )
    inside = W.partitionBy(*group, "slice").orderBy(*order)
    local = sliced.withColumn("_before", F.lag(F.struct(F.col(value))).over(inside))
    return join_groups(local, carried, group, ["slice"]).select(
        *sliced.columns, F.coalesce("_before", "_carried")[value].alias(name)
    )


def group_values(
    sliced: DataFrame, group: Sequence[str], aggregates: Sequence[Column]
) -> DataFrame:
    """Add aggregates of the whole group to its rows, joined back slice by slice."""
    group = list(group)
    whole = sliced.groupBy(*group).agg(*aggregates)
    present = sliced.select(*group, "slice").distinct()
    return join_groups(sliced, join_groups(present, whole, group, []), group, ["slice"])
