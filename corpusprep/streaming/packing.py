"""Packing a token stream that arrives in micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusprep.operators.packing import pack_blocks, stretches, with_offsets
from corpusprep.session import cut_lineage, join_groups

_TAIL_KEY = -1


class BlockPacker:
    """A `foreachBatch` handler that packs each source's stream into blocks.

    What does not fill a block is carried to the next batch: at most `block`
    tokens a source, with the number of blocks so far and the last key. The
    work inside a batch is spread like that of the batch operator, so one hot
    source does not end in one task. Keys count up from 0 within a source; a row
    that comes after a later one of its source goes to the late rows.

    Everything is written under the batch number and read from the one before,
    so a batch that is repeated after a failure replaces its own output.
    """

    def __init__(
        self, folder: str, block: int, ids: Column, key: str = "seq", group: Sequence[str] = ("source",)
    ) -> None:
        self.folder = folder
        self.block = block
        self.ids = ids
        self.key = key
        self.group = list(group)

    def path(self, part: str, batch_id: int | None = None) -> str:
        base = f"{self.folder}/{part}"
        return base if batch_id is None else f"{base}/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        group, key, block = self.group, self.key, self.block
        coded = cut_lineage(batch.select(*group, key, self.ids.alias("ids")))
        if batch_id > 0:
            state = batch.sparkSession.read.parquet(self.path("state", batch_id - 1))
        else:
            state = coded.limit(0).select(
                *group,
                F.lit(0).cast("bigint").alias("next_block"),
                F.lit(_TAIL_KEY).cast("bigint").alias("last_key"),
                F.col("ids").alias("tail"),
            )
        seen = state.select(*group, "last_key")
        reason = F.when(F.col(key).isNull(), "no key").when(
            F.col(key) <= F.coalesce("last_key", F.lit(_TAIL_KEY)), "late"
        )
        aged = join_groups(coded, seen, group, [], "left").withColumn("reason", reason)
        aged.filter("reason is not null").drop("last_key").write.mode("overwrite").parquet(
            self.path("late", batch_id)
        )
        fresh = aged.filter("reason is null").select(*group, key, "ids")
        tails = state.select(
            *group, F.lit(_TAIL_KEY).cast("bigint").alias(key), F.col("tail").alias("ids")
        )
        stream = with_offsets(
            fresh.unionByName(tails), F.col("ids"), key=key, group=group
        )
        base = state.select(*group, "next_block")
        blocks = join_groups(pack_blocks(stream, block, group), base, group, [], "left")
        number = F.col("block_id") + F.coalesce("next_block", F.lit(0))
        blocks.select(*group, number.alias("block_id"), "x", "y").write.mode("overwrite").parquet(
            self.path("blocks", batch_id)
        )
        self._next_state(stream, state).write.mode("overwrite").parquet(
            self.path("state", batch_id)
        )

    def _next_state(self, stream: DataFrame, state: DataFrame) -> DataFrame:
        group, block = self.group, self.block
        totals = stream.groupBy(*group).agg(
            F.sum(F.size("ids").cast("bigint")).alias("total"), F.max(self.key).alias("max_key")
        )
        full = totals.withColumn("blocks", F.expr(f"greatest(0, total - 1) div {block}"))
        rest = stretches(stream, block, 0, group).withColumnsRenamed(
            {"stretch": "blocks", "tokens": "tail"}
        )
        old = state.select(*group, "next_block", "last_key")
        # A source without a token so far has a state too.
        kept = join_groups(full, rest, group, ["blocks"], "left")
        return join_groups(kept, old, group, [], "left").select(
            *group,
            (F.coalesce("next_block", F.lit(0)) + F.col("blocks")).alias("next_block"),
            F.greatest("last_key", "max_key").alias("last_key"),
            F.coalesce("tail", F.array().cast("array<int>")).alias("tail"),
        )


def stream_pack(df: DataFrame, packer: BlockPacker, checkpoint: str) -> DataStreamWriter:
    """A writer that packs the stream `df`; set a trigger on it and start it."""
    return df.writeStream.foreachBatch(packer).option("checkpointLocation", checkpoint)
