"""How much data and how many steps a training run has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.operators.prefix import running_totals


def token_totals(df: DataFrame, n_tokens: Column, by: list[str]) -> DataFrame:
    """Examples and tokens per phase or other grouping."""
    return df.groupBy(*by).agg(
        F.count("*").alias("examples"), F.sum(n_tokens.cast("bigint")).alias("tokens")
    )


def estimate_steps(
    lines: DataFrame,
    block: int,
    batch: int,
    max_bytes: int | None = None,
    max_examples: int | None = None,
    key: str = "line_no",
) -> DataFrame:
    """Steps per epoch as one row: of all lines, or as the head of the file up to the given limits tells.

    `lines` holds one row per line: the key (a unique bigint in file order),
    ``n_bytes`` with the newline, ``parsed``, ``valid`` (an example came out)
    and ``n_tokens`` of the example. Limits are tested after each line that
    parsed, so the line that reaches one still counts.
    """
    if max_bytes is None and max_examples is None:
        lines = lines.withColumn("_sampled", F.lit(True))
    else:
        lines = _head(lines, key, max_bytes or 2**62, max_examples or 2**62)
    sampled = F.col("_sampled")
    totals = lines.agg(
        F.sum("n_bytes").cast("bigint").alias("file_bytes"),
        F.sum(F.when(sampled, F.col("n_bytes"))).cast("bigint").alias("sample_bytes"),
        F.sum(F.when(sampled & F.col("valid"), 1).otherwise(0)).cast("bigint").alias("sample_lines"),
        F.sum(F.when(sampled & F.col("valid"), F.col("n_tokens")).otherwise(0))
        .cast("bigint")
        .alias("sample_tokens"),
    )
    totals = totals.fillna(0)
    ratio = F.col("file_bytes") / F.greatest(F.col("sample_bytes"), F.lit(1))
    tokens = F.floor(F.col("sample_tokens") * ratio)
    steps = F.greatest(F.lit(1), F.floor(tokens / max(1, block * batch)))
    empty = (F.col("sample_bytes") == 0) | (F.col("sample_tokens") == 0)
    return totals.withColumn("steps", F.when(empty, F.lit(1)).otherwise(steps).cast("bigint"))


def _head(lines: DataFrame, key: str, max_bytes: int, max_examples: int) -> DataFrame:
    """Mark the lines up to the one that reaches a limit."""
    whole = lines.select(key, *[F.col(c).cast("bigint").alias(c) for c in ("n_bytes", "parsed", "valid")])
    before = running_totals(whole, key, ["n_bytes", "parsed", "valid"])
    reached = (F.col("before_n_bytes") + F.col("n_bytes") >= max_bytes) | (
        F.col("before_valid") + F.col("valid") >= max_examples
    )
    ends = before.filter((F.col("parsed") == 1) & reached)
    last = ends.agg(F.min(key).alias("_last"))  # one row
    up_to = F.col(key) <= F.coalesce(F.col("_last"), F.lit(2**63 - 1))
    return lines.join(F.broadcast(last)).withColumn("_sampled", up_to)  # one row on the right


def exact_steps(df: DataFrame, n_tokens: Column, block: int, batch: int, epochs: int) -> DataFrame:
    """One row: tokens, sliding windows, full batches and steps over all epochs."""
    tokens = F.coalesce(F.sum(n_tokens.cast("bigint")), F.lit(0))
    windows = F.greatest(F.lit(0), F.col("tokens") - block - 1)
    return (
        df.agg(tokens.alias("tokens"))
        .withColumn("windows", windows)
        .withColumn("batches", F.expr(f"windows div {batch}"))
        .withColumn("steps", F.greatest(F.lit(1), F.col("batches") * epochs))
    )


def ffn_width(n_embd: Column) -> Column:
    """Hidden width of the gated feed-forward layer: two thirds of four times the width."""
    return F.floor(n_embd * 8 / 3)


def config_params(configs: DataFrame) -> DataFrame:
    """Add ``params``, the parameter count that a config implies."""
    d = F.col("n_embd").cast("bigint")
    kv_width = F.col("n_kv_head") * F.floor(d / F.col("n_head"))
    layer = d * 2 + d * d * 2 + d * kv_width * 2 + d * ffn_width(d) * 3
    return configs.withColumn(
        "params", F.col("vocab_size") * d * 2 + d + F.col("n_layer") * layer
    )
