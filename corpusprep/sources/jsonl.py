"""Tolerant JSON-lines scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.text import drop_bad_utf8
from corpusprep.operators.records import parse_lines, split_rejects
from corpusprep.sources.text import ordered_lines


def scan_jsonl(
    spark: SparkSession, path: str, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) records in reading order (path, block, line).

    Blank lines are skipped. Undecodable bytes are dropped, or with `strict`
    (the rule for chat examples) reject their line.
    """
    if not strict:
        return split_rejects(parse_lines(ordered_lines(spark, path, "raw")))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value"),
    )
    sound = F.is_valid_utf8(F.col("value"))
    repaired = lines.select(
        "path", "block", "line", drop_bad_utf8(F.col("value")).alias("raw"), sound.alias("sound")
    )
    parsed = parse_lines(repaired).withColumn(
        "reject", F.coalesce(F.col("reject"), F.when(~F.col("sound"), "undecodable"))
    )
    return split_rejects(parsed.drop("sound"))
