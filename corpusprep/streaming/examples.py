"""Chat examples from JSON-lines files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.operators.records import parse_lines, sft_examples, split_rejects


def stream_examples(
    spark: SparkSession, folder: str, files_per_trigger: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """(examples, rejected) streams with the path of their file; a line that is not UTF-8 is rejected."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    named = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    whole = F.is_valid_utf8("raw")
    good, broken = split_rejects(parse_lines(named.filter(whole)))
    examples, odd = sft_examples(good, ["path"])
    torn = named.filter(~whole).select("path", F.lit("not UTF-8").alias("reject"))
    return examples, broken.select("path", "reject").unionByName(odd).unionByName(torn)
