"""Runs and phases out of training-log rows (run_id, ts, seq, line).

(ts, seq) orders the lines of a run. Operators that need the order take rows
from `order_lines`, which slices long runs over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.loglines import (
    PROGRESS_FIELDS, SAVED_PREFIX, classify, parse_env, parse_progress,
)
from corpusprep.operators.ordered import group_values, previous_value, running, slice_rows

GROUP, ORDER = ("run_id",), ("ts", "seq")


def order_lines(log: DataFrame) -> DataFrame:
    return slice_rows(log, GROUP, ORDER)


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def log_kinds(log: DataFrame) -> DataFrame:
    return log.withColumn("kind", classify(F.col("line")))


def progress_fields(log: DataFrame) -> DataFrame:
    """Progress lines with their fields as columns."""
    parsed = log.withColumn("p", parse_progress(F.col("line"))).filter(F.col("p").isNotNull())
    return parsed.select("run_id", "ts", "seq", "p.*")


def env_fields(log: DataFrame) -> DataFrame:
    """Lines with a JSON payload, with its members as columns."""
    parsed = log.withColumn("e", parse_env(F.col("line"))).filter(F.col("e").isNotNull())
    return parsed.select("run_id", "ts", "seq", "e.*")


def eta(log: DataFrame, total: int) -> DataFrame:
    """Progress lines with steps done, seconds since the run's first line, per step and left.

    `log` comes from `order_lines`.
    """
    is_step = classify(F.col("line")) == "progress"
    counted = running(log, GROUP, ORDER, {"done": is_step.cast("int")})
    started = group_values(counted, GROUP, [F.min("ts").alias("started")])
    steps = started.filter(is_step)
    elapsed = _seconds(F.col("ts"), F.col("started"))
    per_step = F.col("elapsed") / F.greatest(F.col("done"), F.lit(1))
    left = F.greatest(F.lit(0.0), (F.lit(total) - F.col("done")) * F.col("per_step"))
    return (
        steps.withColumn("elapsed", elapsed)
        .withColumn("per_step", per_step)
        .withColumn("remaining", left)
        .select("run_id", "ts", "seq", "done", "elapsed", "per_step", "remaining")
    )


def phase_marker(line: Column) -> Column:
    """(phase, state) of a line that starts or ends a phase, else null.

    Markers are ``PHASE:`` lines and payloads with a phase and a status.
    """
    plain = line.startswith("PHASE:")
    env = parse_env(line)
    phase = F.when(plain, F.regexp_extract(line, r"^PHASE:(\w+)", 1)).otherwise(
        F.when(env["phase"].isNotNull(), F.concat_ws(":", env["phase"], env["part"]))
    )
    state = F.when(plain, F.regexp_extract(line, r"^PHASE:\w+ (\w+)", 1)).otherwise(env["status"])
    known = phase.isNotNull() & state.isin("start", "done")
    return F.when(known, F.struct(phase.alias("phase"), state.alias("state")))


def phase_spans(log: DataFrame) -> DataFrame:
    """One row per phase start: its lines, first and last time, and whether it was closed.

    A span runs from a start marker to the line before the next one. `log`
    comes from `order_lines`.
    """
    marked = log.withColumn("mark", phase_marker(F.col("line")))
    starts = F.coalesce(F.col("mark.state") == "start", F.lit(False))
    numbered = running(marked, GROUP, ORDER, {"span": starts.cast("int")})
    ends = F.col("mark.state") == "done"
    first_end = F.min(F.when(ends, F.struct("ts", "seq", F.col("mark.phase").alias("phase"))))
    return (
        numbered.filter(F.col("span") > 0)
        .groupBy("run_id", "span")
        .agg(
            F.max(F.when(starts, F.col("mark.phase"))).alias("phase"),
            F.min("ts").alias("started"),
            F.max("ts").alias("last_seen"),
            first_end.alias("end"),
            F.count("*").alias("lines"),
        )
        .withColumn("closed", F.coalesce(F.col("end.phase") == F.col("phase"), F.lit(False)))
        .withColumn("seconds", _seconds(F.coalesce("end.ts", "last_seen"), F.col("started")))
        .drop("end")
    )


def latest_aggregates() -> list[Column]:
    """Latest non-null value of each progress field and of the run's environment."""
    at = F.struct("ts", "seq")
    progress, env = parse_progress(F.col("line")), parse_env(F.col("line"))
    fields = {name: progress[name] for name in PROGRESS_FIELDS}
    fields |= {name: env[name] for name in ("device", "auto_jsonl", "sft_steps_est")}
    line = F.col("line")
    saved = F.when(line.startswith(SAVED_PREFIX), F.substr(line, F.lit(len(SAVED_PREFIX) + 1)))
    fields["saved_path"] = saved
    return [F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in fields.items()]


def latest_state(log: DataFrame) -> DataFrame:
    """One row per run; an absent field never erases an earlier value."""
    return log.groupBy("run_id").agg(*latest_aggregates())


def idle_gaps(log: DataFrame, seconds: float = 10.0) -> DataFrame:
    """Lines that came more than `seconds` after the one before. `log` comes from `order_lines`."""
    paired = previous_value(log, GROUP, ORDER, "ts", "previous_ts")
    gap = _seconds(F.col("ts"), F.col("previous_ts"))
    return (
        paired.withColumn("gap_seconds", gap)
        .filter(F.col("gap_seconds") > seconds)
        .select("run_id", "ts", "seq", "previous_ts", "gap_seconds")
    )


def run_outcome(log: DataFrame) -> DataFrame:
    """How each run ended: done and error flags, last error and last saved path."""
    line = F.col("line")
    at = F.struct("ts", "seq")
    is_error = line.startswith("ERROR:")
    saved = F.when(line.startswith(SAVED_PREFIX), F.substr(line, F.lit(len(SAVED_PREFIX) + 1)))
    return log.groupBy("run_id").agg(
        F.bool_or(line == "DONE").alias("done"),
        F.bool_or(is_error).alias("failed"),
        F.max_by(F.when(is_error, line), F.when(is_error, at)).alias("last_error"),
        F.max_by(saved, F.when(saved.isNotNull(), at)).alias("saved_path"),
    )


def run_names(runs: DataFrame) -> DataFrame:
    """Add ``run_name`` from task, input files, sizes and start stamp."""

    def stem(path: Column) -> Column:
        name = F.regexp_extract(path, r"([^/]*)$", 1)
        return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")

    no_jsonl = F.coalesce(F.col("jsonl"), F.lit("")) == ""
    base = F.when((F.col("task") == "lm") | no_jsonl, stem(F.col("txt"))).otherwise(
        stem(F.col("jsonl"))
    )
    name = F.concat(
        base,
        *[
            p
            for label, c in (
                ("-d", "d_model"), ("h", "heads"), ("l", "layers"), ("-seq", "seq_len"),
                ("-bs", "batch"),
            )
            for p in (F.lit(label), F.col(c).cast("string"))
        ],
        F.lit("-"),
        F.date_format("started", "yyyyMMdd-HHmmss"),
    )
    return runs.withColumn("run_name", name)
