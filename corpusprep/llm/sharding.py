"""Uniform shuffle into shards of exact sizes."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import count_at_most
from corpusprep.session import local_frame, shuffle_width

#: Entries of the matrix up to which it is broadcast (eight bytes each).
_BROADCAST_ENTRIES = 2_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` items, taken without replacement, are among the `good` ones.

    Inversion from the mode outwards: exact up to double rounding, for counts of any
    size, in steps of the order of the standard deviation.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(total, drawn))
    left = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while left > 0:
        if up == high and down == low:
            return mode
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up + p_down < 1e-300:
            return mode
    return mode


def communication_matrix(rows: Sequence[int], columns: Sequence[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, as a uniform shuffle would leave them."""
    if sum(rows) != sum(columns):
        raise ValueError("row and column sums differ")
    rng = random.Random(seed)
    left = list(columns)
    matrix = []
    for wanted in rows:
        rest = sum(left)
        counts = []
        for k, size in enumerate(left):
            n = hypergeometric(rng, size, rest - size, wanted) if wanted else 0
            rest -= size
            wanted -= n
            left[k] -= n
            counts.append(n)
        matrix.append(counts)
    return matrix


def even_sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def shuffle_to_shards(
    docs: DataFrame,
    shards: int,
    *,
    id_col: str = "doc_id",
    seed: int = 7,
    blocks: int | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Give each row a shard and a slot in it, as one uniform shuffle of all rows would.

    Rows fall into source blocks by a hash of the id. A matrix of exact block-to-shard
    counts is drawn (hypergeometric, so that it is distributed as in a uniform shuffle);
    each block is permuted, its rows are dealt out by the matrix, and each receiving
    piece is permuted again. A shard consists of several pieces, so no task holds a
    whole shard. Shard sizes are equal or differ by one.

    Returns `docs` with ``shard int`` and ``slot bigint`` (0, 1, ... without gaps in each
    shard) added; columns of these names are replaced. `extra` names columns that help
    to order rows of equal id. A null id is an id like any other; rows that repeat get
    a place each. The same rows, seed and block count give the same places. No row
    gives no row.
    """
    spark = docs.sparkSession
    blocks = blocks or shuffle_width(spark)
    pieces = max(1, -(-blocks // shards))
    docs = docs.drop("shard", "slot", "_block", "_rank", "_cum", "_piece", "_first")
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(blocks)).cast("int")
    found = {r["b"]: r["n"] for r in docs.select(block.alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(b, 0) for b in range(blocks)]
    sizes, firsts, owners = [], [], []
    for shard, size in enumerate(even_sizes(sum(counts), shards)):
        first = 0
        for part in even_sizes(size, pieces):
            sizes.append(part)
            firsts.append(first)
            owners.append(shard)
            first += part
    ends = []
    for row in communication_matrix(counts, sizes, seed):
        total, line = 0, []
        for n in row:
            total += n
            line.append(total)
        ends.append(line)
    matrix = local_frame(spark, list(zip(range(blocks), ends)), "_b int, _cum array<bigint>")
    if blocks * len(sizes) <= _BROADCAST_ENTRIES:
        matrix = F.broadcast(matrix)

    ties = [F.col(id_col), *map(F.col, extra)]
    sent = (
        docs.withColumn("_block", block)
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(F.xxhash64(*ties, F.lit(seed + 1)), *ties)))
        .join(matrix, F.col("_block") == F.col("_b"))
        .withColumn("_piece", count_at_most(F.col("_cum"), len(sizes), (F.col("_rank") - 1).cast("bigint")))
    )
    place = F.row_number().over(Window.partitionBy("_piece").orderBy(F.xxhash64(*ties, F.lit(seed + 2)), *ties))
    first = F.element_at(F.lit(firsts).cast("array<bigint>"), F.col("_piece") + 1)
    owner = F.element_at(F.lit(owners).cast("array<int>"), F.col("_piece") + 1)
    return sent.withColumn("slot", first + place - 1).withColumn("shard", owner).drop(
        "_block", "_rank", "_b", "_cum", "_piece"
    )
