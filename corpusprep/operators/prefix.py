"""Running totals and ranks over a whole table without a one-task window.

`running_totals` serves streams ordered by a unique bigint. Rows fall into
buckets of 2^21 neighbouring keys, buckets into buckets of buckets, so no
window ever sees more than 2^22 rows, whatever the distribution of the keys.
Nothing is sampled or collected; the plan stays lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusprep.session import join_groups

_SHIFT = 21
_LEVELS = 3  # 3 * 21 bits cover a 64-bit key but for the sign, which the top level holds


def running_totals(
    df: DataFrame, key: str, values: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Each row's sum of `values` over the rows with a smaller key in its group.

    Returns the group columns, the key, the values and ``before_<value>``.
    """
    group = list(group)
    # The explicit null filter keeps joins from inferring different ones for their
    # inputs: one exchange by bucket then serves the totals and the detail rows.
    rows = df.select(*group, key, *values).filter(F.col(key).isNotNull())
    rows = rows.withColumn("_b1", F.shiftright(key, _SHIFT))
    rows = rows.repartition(*group, "_b1")
    bases = _bucket_bases(rows, values, group, level=1)
    within = W.partitionBy(*group, "_b1").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    local = [
        F.coalesce(F.sum(v).over(within), F.lit(0)).cast("bigint").alias(f"_local_{v}")
        for v in values
    ]
    return join_groups(rows.select("*", *local), bases, group, ["_b1"]).select(
        *group,
        key,
        *values,
        *[(F.col(f"_base_{v}") + F.col(f"_local_{v}")).alias(f"before_{v}") for v in values],
    )


def _bucket_bases(
    rows: DataFrame, values: Sequence[str], group: list[str], level: int
) -> DataFrame:
    """Total of all earlier buckets, for each bucket of `level`."""
    bucket = f"_b{level}"
    totals = rows.groupBy(*group, bucket).agg(*[F.sum(v).alias(v) for v in values])
    top = level == _LEVELS - 1
    if not top:
        totals = totals.withColumn(f"_b{level + 1}", F.shiftright(bucket, _SHIFT))
    scope = [*group] if top else [*group, f"_b{level + 1}"]
    earlier = W.partitionBy(*scope).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    based = totals.select(
        *scope,
        bucket,
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).cast("bigint").alias(f"_in_{v}") for v in values],
    )
    if top:
        return based.withColumnsRenamed({f"_in_{v}": f"_base_{v}" for v in values})
    above = _bucket_bases(totals, values, group, level + 1)
    return join_groups(based, above, group, [f"_b{level + 1}"]).select(
        *group,
        bucket,
        *[(F.col(f"_in_{v}") + F.col(f"_base_{v}")).alias(f"_base_{v}") for v in values],
    )


_HASH_DIGITS = 4  # 65,536 buckets


def shuffled_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add ``rank`` (from 0): the place of each row in a reproducible random order.

    The order is that of md5(seed:key). Its first digits make evenly filled
    buckets, so only the 65,536 bucket counts meet in one window.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, _HASH_DIGITS))
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    within = W.partitionBy("_bucket").orderBy("_hash", key)
    return (
        hashed.join(F.broadcast(bases), "_bucket")  # at most 65,536 rows
        .withColumn("rank", F.col("_base") + F.row_number().over(within) - 1)
        .drop("_bucket", "_hash", "_base")
    )
