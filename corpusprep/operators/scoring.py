"""Choosing from and normalising long score tables (group_id, cand_id, score).

A group may be of any size: picks and sums are aggregates that merge partial
results, ranks are first taken over salted parts. Null is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusprep.operators.ordered import running, slice_rows
from corpusprep.session import join_groups

# Parts that a group's rows are dealt to before the rows of all parts are ranked.
_PARTS = 64


def argmax(scores: DataFrame) -> DataFrame:
    """Best candidate of each group; the smallest id wins a tie."""
    best = F.struct("score", (-F.col("cand_id")).alias("_"))
    return scores.groupBy("group_id").agg(
        F.max_by("cand_id", best).alias("cand_id"), F.max("score").alias("score")
    )


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each group with ``rank`` from 1, ties by id; all rows for k <= 0.

    Each part of a group gives its k best, and the best of those are the result. To rank all
    rows, slices along (group, order) are counted, so no group has to fit one task.
    """
    if k <= 0:
        ordered = scores.withColumn("_down", -F.col("score"))
        sliced = slice_rows(ordered, ["group_id"], ["_down", "cand_id"])
        ranked = running(sliced, ["group_id"], ["_down", "cand_id"], {"rank": F.lit(1)}, F.sum)
        return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_down", "slice")
    best = [F.desc("score"), F.asc("cand_id")]
    part = W.partitionBy("group_id", "_part").orderBy(*best)
    parted = scores.withColumn("_part", F.pmod(F.xxhash64("cand_id"), F.lit(_PARTS)))
    some = parted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= k).drop("_part", "_rank")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("group_id").orderBy(*best)))
    return ranked.filter(F.col("rank") <= k)


def with_log_sum(scores: DataFrame, value: Column, name: str = "log_sum") -> DataFrame:
    """Add log(sum(exp(value))) of the row's group, summed against the group's maximum."""
    valued = scores.withColumn("_value", value)
    tops = valued.groupBy("group_id").agg(F.max("_value").alias("_top"))
    near = join_groups(valued.select("group_id", "_value"), tops, ["group_id"], [])
    logs = near.groupBy("group_id").agg(
        (F.first("_top") + F.log(F.sum(F.exp(F.col("_value") - F.col("_top"))))).alias(name)
    )
    return join_groups(valued, logs, ["group_id"], []).drop("_value")


def softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Add ``probability`` after dividing scores by the temperature."""
    value = F.col("score") / temperature
    summed = with_log_sum(scores, value, "_log_sum")
    return summed.withColumn("probability", F.exp(value - F.col("_log_sum"))).drop("_log_sum")


def cross_entropy(scores: DataFrame) -> DataFrame:
    """One row: groups and mean loss, with the right candidate in ``target``."""
    summed = with_log_sum(scores, F.col("score"))
    losses = summed.filter(F.col("cand_id") == F.col("target"))
    return losses.agg(
        F.count("*").alias("groups"), F.avg(F.col("log_sum") - F.col("score")).alias("loss")
    )


# 48 bits of a hash make the uniform number of one candidate.
_DIGITS = 12


def weighted_draw(scores: DataFrame, seed: int, temperature: float = 1.0) -> DataFrame:
    """One candidate per group, drawn with its softmax probability.

    The maximum of score plus Gumbel noise is such a draw, so no running sum
    over the group is needed. The noise comes from md5(seed:group:candidate)
    and is the same in every run.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "group_id", "cand_id"))
    number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    uniform = (number + 0.5) / float(16**_DIGITS)
    noisy = F.col("score") / temperature - F.log(-F.log(uniform))
    return scores.groupBy("group_id").agg(
        F.max_by("cand_id", F.struct(noisy, (-F.col("cand_id")).alias("_"))).alias("cand_id")
    )
