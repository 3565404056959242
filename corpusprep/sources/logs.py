"""Training logs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = "run_id bigint, seq bigint, ts timestamp, line string"


def read_log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Streaming (run_id, seq, ts, line) rows of the JSON files put into `folder`."""
    reader = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)
