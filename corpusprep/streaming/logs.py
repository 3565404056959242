"""Run state and idle runs from a stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.operators.telemetry import latest_state, log_kinds

__all__ = ["latest_state", "log_kinds", "stream_idle", "stream_latest"]


def stream_latest(log: DataFrame) -> DataFrame:
    """Latest fields of each run, for the ``update`` output mode."""
    return latest_state(log)


def stream_idle(log: DataFrame, gap: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Stretches of activity that ended with more than `gap` of silence, for ``append``.

    A stretch comes out once the watermark has passed its end. Set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` for
    runs with many lines, to merge them before the shuffle.
    """
    sessions = log.withWatermark("ts", lateness).groupBy("run_id", F.session_window("ts", gap))
    return sessions.agg(F.count("*").alias("lines"), F.max("ts").alias("last_line")).select(
        "run_id", F.col("session_window.start").alias("started"), "last_line", "lines"
    )
