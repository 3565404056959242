"""Queries of the training-log operators, over lines made from the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.loglines import classify, percent_done as percent
from corpusprep.operators import telemetry as L
from corpusprep.plans.fixtures import ctes, run_log
from corpusprep.plans.registry import Tables, query
from corpusprep.session import scratch_folder
from corpusprep.sources.textlogs import read_text_logs

_LOG = ctes(run_log=None)
_TOTAL_STEPS = 100


@query(
    _LOG
    + """ SELECT run_id, seq, CASE
      WHEN line LIKE 'ENV %' THEN 'env' WHEN line LIKE 'PHASE:%' THEN 'phase' WHEN line LIKE '{%' THEN 'env'
      WHEN line LIKE 'PARAMS %' THEN 'params' WHEN line LIKE 'Saved weights: %' THEN 'saved'
      WHEN line LIKE 'Training started%' OR line LIKE 'Quantizing %' THEN 'status'
      WHEN line LIKE 'Progress:%' THEN 'progress' WHEN line = 'DONE' THEN 'done'
      WHEN line LIKE 'ERROR:%' THEN 'error' WHEN line LIKE 'ERR:busy%' THEN 'busy' ELSE 'other' END AS kind
    FROM run_log"""
)
def log_kinds(t: Tables) -> DataFrame:
    return L.log_kinds(run_log(t)).select("run_id", "seq", "kind")


def _cell(name: str) -> str:
    """The value of a named cell of a progress line."""
    return f"nullif(split_part(list_filter(cells, lambda c: c LIKE '{name} %')[1], ' ', 2), '')"


_PROGRESS = f"""cells AS (SELECT run_id, ts, seq, list_transform(string_split(substr(line, 10), '|'), lambda c: trim(c)) AS cells
    FROM run_log WHERE line LIKE 'Progress:%'),
  progress AS (SELECT run_id, ts, seq, rtrim(cells[1], '%') AS pct,
    split_part({_cell('epoch')}, '/', 1) AS epoch, split_part({_cell('epoch')}, '/', 2) AS epoch_total,
    split_part({_cell('step')}, '/', 1) AS step, split_part({_cell('step')}, '/', 2) AS step_total,
    {_cell('loss')} AS loss, {_cell('s_it')} AS s_it, {_cell('elapsed')} AS elapsed, {_cell('ETA')} AS eta
  FROM cells)"""


@query(f"{_LOG}, {_PROGRESS} SELECT * EXCLUDE (ts) FROM progress")
def progress_fields(t: Tables) -> DataFrame:
    return L.progress_fields(run_log(t)).drop("ts")


_ENV = """env AS (SELECT run_id, ts, seq, CASE WHEN line LIKE 'ENV %' THEN substr(line, 5) ELSE line END AS j
  FROM run_log WHERE line LIKE 'ENV %' OR line LIKE '{%')"""


@query(
    f"""{_LOG}, {_ENV} SELECT run_id, seq, j->>'$.device' AS device, cast(j->>'$.cuda_available' AS boolean) AS cuda_available,
      j->>'$.auto_jsonl' AS auto_jsonl, cast(j->>'$.ids_lm' AS bigint) AS ids_lm,
      cast(j->>'$.sft_steps_est' AS bigint) AS sft_steps_est, cast(j->>'$.auto_batch' AS bigint) AS auto_batch,
      j->>'$.reason' AS reason, j->>'$.phase' AS phase FROM env"""
)
def env_fields(t: Tables) -> DataFrame:
    return L.env_fields(run_log(t)).select(
        "run_id", "seq", "device", "cuda_available", "auto_jsonl", "ids_lm", "sft_steps_est",
        "auto_batch", "reason", "phase",
    )


@query(
    f"""{_LOG}, {_PROGRESS} SELECT run_id, seq,
      round(100.0::double * cast(step AS bigint) / greatest(cast(step_total AS bigint), 1), 6) AS open_pct,
      round(100.0::double * least(cast(step AS bigint), cast(step_total AS bigint)) / greatest(cast(step_total AS bigint), 1), 6) AS capped_pct
    FROM progress"""
)
def percent_done(t: Tables) -> DataFrame:
    step, total = F.col("step").cast("bigint"), F.col("step_total").cast("bigint")
    return L.progress_fields(run_log(t)).select(
        "run_id",
        "seq",
        F.round(percent(step, total, capped=False), 6).alias("open_pct"),
        F.round(percent(step, total, capped=True), 6).alias("capped_pct"),
    )


@query(
    f"""{_LOG}, counted AS (SELECT run_id, ts, seq, line,
        sum(CASE WHEN line LIKE 'Progress:%' THEN 1 ELSE 0 END) OVER
          (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS done,
        min(ts) OVER (PARTITION BY run_id) AS started FROM run_log),
      timed AS (SELECT run_id, seq, cast(done AS bigint) AS done,
        (epoch_us(ts) - epoch_us(started)) / 1e6 AS elapsed FROM counted WHERE line LIKE 'Progress:%')
    SELECT run_id, seq, done, elapsed, elapsed / done AS per_step,
      greatest(0.0::double, ({_TOTAL_STEPS} - done) * (elapsed / done)) AS remaining FROM timed"""
)
def eta(t: Tables) -> DataFrame:
    return L.eta(L.order_lines(run_log(t)), _TOTAL_STEPS).drop("ts")


@query(
    f"""{_LOG}, marked AS (SELECT run_id, ts, seq,
        CASE WHEN line LIKE 'PHASE:%' THEN regexp_extract(line, '^PHASE:(\\w+)', 1)
          WHEN line LIKE 'ENV %' THEN (substr(line, 5)->>'$.phase') || ':' || (substr(line, 5)->>'$.part') END AS phase,
        CASE WHEN line LIKE 'PHASE:%' THEN regexp_extract(line, '^PHASE:\\w+ (\\w+)', 1)
          WHEN line LIKE 'ENV %' THEN substr(line, 5)->>'$.status' END AS state FROM run_log),
      spans AS (SELECT *, sum(CASE WHEN phase IS NOT NULL AND state = 'start' THEN 1 ELSE 0 END) OVER
        (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS span FROM marked),
      grouped AS (SELECT run_id, span, max(phase) FILTER (state = 'start') AS phase, min(ts) AS started,
        max(ts) AS last_seen, count(*) AS lines,
        arg_min({{'ts': ts, 'phase': phase}}, (ts, seq)) FILTER (state = 'done' AND phase IS NOT NULL) AS e
        FROM spans WHERE span > 0 GROUP BY run_id, span)
    SELECT run_id, cast(span AS bigint) AS span, phase, lines, coalesce(e.phase = phase, false) AS closed,
      (epoch_us(coalesce(e.ts, last_seen)) - epoch_us(started)) / 1e6 AS seconds FROM grouped"""
)
def phase_spans(t: Tables) -> DataFrame:
    return L.phase_spans(L.order_lines(run_log(t))).drop("started", "last_seen")


def _latest_sql() -> str:
    fields = ["pct", "epoch", "epoch_total", "step", "step_total", "loss", "s_it", "elapsed", "eta"]
    progress = ", ".join(f"arg_max({f}, (ts, seq)) FILTER ({f} IS NOT NULL) AS {f}" for f in fields)
    env = ", ".join(
        f"arg_max({v}, (ts, seq)) FILTER ({v} IS NOT NULL) AS {n}"
        for n, v in (
            ("device", "j->>'$.device'"), ("auto_jsonl", "j->>'$.auto_jsonl'"),
            ("sft_steps_est", "cast(j->>'$.sft_steps_est' AS bigint)"),
        )
    )
    return f"""{_LOG}, {_PROGRESS}, {_ENV}, p AS (SELECT run_id, {progress} FROM progress GROUP BY run_id),
      e AS (SELECT run_id, {env} FROM env GROUP BY run_id),
      s AS (SELECT run_id, arg_max(substr(line, 16), (ts, seq)) AS saved_path FROM run_log
        WHERE line LIKE 'Saved weights: %' GROUP BY run_id)
    SELECT * FROM (SELECT DISTINCT run_id FROM run_log) LEFT JOIN p USING (run_id) LEFT JOIN e USING (run_id)
      LEFT JOIN s USING (run_id)"""


@query(_latest_sql())
def latest_state(t: Tables) -> DataFrame:
    return L.latest_state(run_log(t))


_GAP = 6 * 3600


@query(
    f"""{_LOG}, paired AS (SELECT run_id, ts, seq, lag(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS previous_ts FROM run_log)
    SELECT run_id, seq, (epoch_us(ts) - epoch_us(previous_ts)) / 1e6 AS gap_seconds FROM paired
    WHERE epoch_us(ts) - epoch_us(previous_ts) > {_GAP}000000"""
)
def idle_gaps(t: Tables) -> DataFrame:
    """Gaps of hours, as the events of a user lie far apart."""
    gaps = L.idle_gaps(L.order_lines(run_log(t)), seconds=_GAP)
    return gaps.drop("ts", "previous_ts")


@query(
    f"""{_LOG} SELECT run_id, bool_or(line = 'DONE') AS done, bool_or(line LIKE 'ERROR:%') AS failed,
      arg_max(line, (ts, seq)) FILTER (line LIKE 'ERROR:%') AS last_error,
      arg_max(substr(line, 16), (ts, seq)) FILTER (line LIKE 'Saved weights: %') AS saved_path
    FROM run_log GROUP BY run_id"""
)
def run_outcome(t: Tables) -> DataFrame:
    return L.run_outcome(run_log(t))


# One training request per order.
_RUNS = """
SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'lm' WHEN 1 THEN 'sft' ELSE 'both' END AS task,
  CASE o_orderkey % 4 WHEN 0 THEN 'corpus.v2.txt' WHEN 1 THEN 'sub/plain.txt' WHEN 2 THEN '.txt' ELSE 'noext' END AS txt,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'chat' || cast(o_custkey AS varchar(20)) || '.jsonl' END AS jsonl,
  cast(64 * (o_custkey % 8 + 1) AS int) AS d_model, cast(o_custkey % 8 + 1 AS int) AS heads,
  cast(o_orderkey % 12 AS int) AS layers, 256 AS seq_len, 48 AS batch, o_orderdate AS started
FROM {orders}
"""


@query(
    f"""WITH runs AS ({_RUNS.format(orders="orders")}),
      based AS (SELECT *, CASE WHEN task = 'lm' OR coalesce(jsonl, '') = '' THEN txt ELSE jsonl END AS path FROM runs)
    SELECT run_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]+$', '\\1') || '-d' || d_model
      || 'h' || heads || 'l' || layers || '-seq' || seq_len || '-bs' || batch || '-'
      || strftime(started, '%Y%m%d-%H%M%S') AS run_name FROM based"""
)
def run_names(t: Tables) -> DataFrame:
    return L.run_names(t.sql(_RUNS, orders=t.orders)).select("run_id", "run_name")


_LOGS = 16


@query(
    f"""{_LOG} SELECT cast(run_id % {_LOGS} AS varchar) AS run_id, count(*) AS lines, cast(sum(octet_length(encode(line)) + 1) AS bigint) AS n_bytes,
      bit_xor(cast('0x' || md5(line)[1:15] AS bigint)) AS digest FROM run_log GROUP BY 1"""
)
def text_log_scan(t: Tables) -> DataFrame:
    """The log lines, written as plain text files and read back by the log source."""
    folder = f"{scratch_folder(t.spark)}/logs-{uuid.uuid4().hex}"
    run_log(t).select((F.col("run_id") % _LOGS).alias("log"), "line").write.partitionBy("log").text(folder)
    lines = read_text_logs(t.spark, folder, files="part-.*", run="/log=([^/]*)/")
    digest = F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("bigint")
    return lines.groupBy("run_id").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).cast("bigint").alias("n_bytes"), F.bit_xor(digest).alias("digest")
    )
