"""Column functions that read training-log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line prefixes, in the order in which they are tried.
LINE_PREFIXES = (
    ("ENV ", "env"),
    ("PHASE:", "phase"),
    ("{", "env"),
    ("PARAMS ", "params"),
    ("Saved weights: ", "saved"),
    ("Training started", "status"),
    ("Quantizing ", "status"),
    ("Progress:", "progress"),
)

# Names of the progress fields.
PROGRESS_FIELDS = ("pct", "epoch", "epoch_total", "step", "step_total", "loss", "s_it", "elapsed", "eta")

# Members of the JSON payloads.
ENV_SCHEMA = (
    "device string, cuda_available boolean, cuda_names array<string>, torch string, "
    "auto_jsonl string, ids_lm bigint, sft_steps_est bigint, sample_bytes bigint, "
    "file_bytes bigint, sample_lines bigint, sample_tokens bigint, auto_batch bigint, "
    "reason string, phase string, part string, status string, "
    "parameter_count bigint, size_label string"
)

SAVED_PREFIX = "Saved weights: "


def classify(line: Column) -> Column:
    """Kind of a log line; the first matching rule wins."""
    kind = None
    for prefix, name in LINE_PREFIXES:
        test = line.startswith(prefix)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return (
        kind.when(line == "DONE", "done")
        .when(line.startswith("ERROR:"), "error")
        .when(line.startswith("ERR:busy"), "busy")
        .otherwise("other")
    )


def parse_progress(line: Column) -> Column:
    """Struct of the progress fields as text; a field that is absent is null.

    A progress line is a row of cells between bars. The first holds the percentage, the
    others a name and a value; ``epoch`` and ``step`` have ``done/total`` values.
    """
    cells = F.split(F.regexp_replace(line, "^Progress:", "percent "), r"\|")
    named = F.transform(cells, lambda c: F.split(F.trim(c), r"\s+"))
    pairs = F.filter(named, lambda c: F.size(c) == 2)
    value = F.map_from_entries(F.transform(pairs, lambda c: F.struct(F.get(c, F.lit(0)), F.get(c, F.lit(1)))))

    def field(name: str, cell: str, part: int | None = None) -> Column:
        text = F.element_at(value, cell)
        return (text if part is None else F.get(F.split(text, "/"), F.lit(part))).alias(name)

    fields = F.struct(
        F.rtrim(field("pct", "percent"), F.lit("%")).alias("pct"),
        field("epoch", "epoch", 0), field("epoch_total", "epoch", 1),
        field("step", "step", 0), field("step_total", "step", 1),
        field("loss", "loss"), field("s_it", "s_it"), field("elapsed", "elapsed"), field("eta", "ETA"),
    )
    return F.when(line.startswith("Progress:"), fields)


def parse_env(line: Column) -> Column:
    """Struct of the JSON payload of an ``ENV`` or bare-object line, else null."""
    payload = F.when(line.startswith("ENV "), F.substr(line, F.lit(5))).when(
        line.startswith("{"), line
    )
    return F.from_json(payload, ENV_SCHEMA)


def percent_done(step: Column, total: Column, capped: bool) -> Column:
    """100 * step / total; the chat phase caps the step at its estimated total."""
    done = F.least(step, total) if capped else step
    return F.lit(100.0) * done / F.greatest(total, F.lit(1))
