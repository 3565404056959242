"""Inputs that the given tables lack, derived from them in SQL.

The texts run on Spark and on DuckDB alike, so both sides of a check start from
the same rows. Table names stand in braces; literal braces are doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusprep.plans.registry import Tables

# Corpus artefacts, one kind per document by doc_id.
DIRTY = """
SELECT doc_id, lang, source, CASE doc_id % 8
  WHEN 0 THEN text
  WHEN 1 THEN text || chr(10) || '```py' || chr(10) || 'code' || chr(10) || '```' || chr(10)
  WHEN 2 THEN '<0x41>' || text || '<0xD0><0x9F><0x0A>```sh'
  WHEN 3 THEN text || ' CR13 self lf. LF10'
  WHEN 4 THEN chr(1) || text || chr(127) || '﷐'
  WHEN 5 THEN replace(text, chr(10), chr(13) || chr(10))
  WHEN 6 THEN replace(text, chr(10), chr(10) || chr(10))
  ELSE chr(160) || '  ' || text || ' ' || chr(9)
END AS text
FROM {documents}
"""

# JSON lines of every shape the record operators must tell apart.
JSON_LINES = """
SELECT line_no, CASE line_no % 20
  WHEN 0 THEN '{{"text": "' || body || '", "prompt": "p", "answer": "a"}}'
  WHEN 1 THEN '{{"prompt": "' || head || '", "answer": "' || body || '"}}'
  WHEN 2 THEN '{{"prompt": "", "user": "' || body || '", "response": "", "assistant": "ok"}}'
  WHEN 3 THEN '{{"messages": [{{"role": "system", "content": "s"}}, {{"role": "user", "content": "early"}},'
      || ' {{"role": "assistant", "content": "early"}}, {{"role": "user", "content": "' || head
      || '"}}, {{"role": "assistant", "content": "' || body || '"}}]}}'
  WHEN 4 THEN '{{"messages": [{{"role": "assistant", "content": "' || body
      || '"}}, {{"role": "user", "content": "late"}}]}}'
  WHEN 5 THEN '{{"question": "", "answer": "' || body
      || '", "messages": [{{"role": "user", "content": "unused"}}]}}'
  WHEN 6 THEN '{{"prompt": "' || body || '"}}'
  WHEN 7 THEN '{{"prompt": "' || body || '", "answer": ""}}'
  WHEN 8 THEN '   ' || chr(9)
  WHEN 9 THEN '{{bad ' || body
  WHEN 10 THEN '["' || body || '"]'
  WHEN 11 THEN '{{"prompt": 5, "answer": "' || body || '"}}'
  WHEN 12 THEN '{{"text": "CR", "prompt": "p", "answer": "' || body || '"}}'
  WHEN 13 THEN '{{"system": "be brief", "text": "<0x41>' || body || ' CR13 lf. ' || chr(92) || 'u0001"}}'
  WHEN 14 THEN '{{"input": "<|eot_id|>' || head || '", "answer": "' || body || '"}}'
  WHEN 15 THEN '{{"system": "s", "input": null, "answer": "' || head
      || '", "messages": [{{"role": "user", "content": "' || body || '"}}]}}'
  WHEN 16 THEN '  {{"prompt": "  ' || chr(92) || 'n```x' || chr(92) || 'n' || head || ' ", "answer": "' || body || '"}} '
  WHEN 17 THEN '{{"prompt": 0, "user": "u", "answer": "' || body || '"}}'
  WHEN 18 THEN '{{"text": ["' || head || '"], "prompt": "p", "answer": "a"}}'
  ELSE '{{"prompt": "p", "messages": ["' || head || '"]}}'
END AS raw
FROM (
  SELECT doc_id AS line_no,
    replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS body,
    replace(replace(split_part(text, chr(10), 1), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS head
  FROM {documents}
) AS escaped
"""

# One JSON line per turn, with message members that carry no text beside it.
TURN_LINES = """
SELECT conv_id, turn, '{{"messages": [{{"role": "' || role || '", "content": "' || body
  || '"}}, {{"role": "user", "content": "  "}}, {{"role": "user", "content": 7}}, {{"role": "user"}}, '
  || '{{"content": "<0x42>CR13"}}], "id": ' || cast(turn AS varchar(20)) || '}}' AS raw
FROM (
  SELECT conv_id, turn, role,
    replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS body
  FROM {conversations}
) AS escaped
"""

# Lines as a training run prints them; the event type picks the kind.
RUN_LOG = """
SELECT user_id AS run_id, ts, event_id AS seq, CASE
  WHEN event_type = 'view' AND event_id % 2 = 0 THEN
    'Progress:  ' || cast(event_id % 100 AS varchar(20)) || '.25% | epoch 1/4 | step '
    || cast(event_id % 100 AS varchar(20)) || '/100 | loss ' || cast(value AS varchar(30)) || ' | s_it 0.42s/it'
  WHEN event_type = 'view' THEN
    'Progress:  50.00% | epoch 2/3 | step ' || cast(event_id % 300 AS varchar(20))
    || '/200 | loss ' || cast(value AS varchar(30)) || ' | s_it 0.5s/it | elapsed 1.5m | ETA '
    || cast(event_id % 7 AS varchar(20)) || '.0m'
  WHEN event_type = 'click' AND event_id % 8 = 0 THEN '{{"device": "cuda", "cuda_available": true, "torch": "2.3"}}'
  WHEN event_type = 'click' AND event_id % 8 = 1 THEN 'ENV {{"auto_jsonl": "Datasets/d' || cast(event_id AS varchar(20)) || '.jsonl"}}'
  WHEN event_type = 'click' AND event_id % 8 = 2 THEN 'ENV {{"ids_lm": ' || cast(event_id AS varchar(20)) || '}}'
  WHEN event_type = 'click' AND event_id % 8 = 3 THEN 'ENV {{"sft_steps_est": ' || cast(event_id % 50 AS varchar(20)) || ', "sample_lines": 10}}'
  WHEN event_type = 'click' AND event_id % 8 = 4 THEN 'ENV {{"auto_batch": 8, "reason": "oom"}}'
  WHEN event_type = 'click' AND event_id % 8 = 5 THEN 'PARAMS ' || cast(event_id * 1000 AS varchar(20)) || ' | d_model=256'
  WHEN event_type = 'click' AND event_id % 8 = 6 THEN 'Training started (device=cuda, AMP=True)'
  WHEN event_type = 'click' THEN 'Quantizing to Q4_K_M ...'
  WHEN event_type = 'signup' AND event_id % 4 = 2 THEN 'ENV {{"phase": "spm_merge", "part": "txt", "status": "start"}}'
  WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'PHASE:LM start'
  WHEN event_type = 'signup' THEN 'PHASE:SFT start (epochs=3)'
  WHEN event_type = 'purchase' AND event_id % 4 = 2 THEN 'ENV {{"phase": "spm_merge", "part": "txt", "status": "done"}}'
  WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'PHASE:LM done'
  WHEN event_type = 'purchase' THEN 'PHASE:SFT done'
  WHEN event_id % 5 = 0 THEN 'ERROR: ValueError: run ' || cast(user_id AS varchar(20))
  WHEN event_id % 5 = 1 THEN 'DONE'
  WHEN event_id % 5 = 2 THEN 'ERR:busy'
  WHEN event_id % 5 = 3 THEN 'Saved weights: Models/m' || cast(event_id AS varchar(20)) || '.gguf'
  ELSE 'WARN: slow step'
END AS line
FROM {events}
"""

# Model configs, valid and invalid, one per part.
CONFIGS = """
SELECT 'm' || cast(p_partkey AS varchar(20)) AS model, p_partkey AS model_no,
  cast(264 + (p_partkey % 7) * 100 AS int) AS vocab_size,
  cast(CASE WHEN p_partkey % 101 = 0 THEN 40 ELSE p_partkey % 4 END AS int) AS n_layer,
  cast(n_head AS int) AS n_head,
  cast(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE n_head END AS int) AS n_kv_head,
  cast(n_head * (16 + 8 * (p_size % 5)) AS int) AS n_embd,
  cast(128 * (1 + p_size % 4) AS int) AS block_size,
  cast(CASE WHEN p_partkey % 5 = 0 THEN 500000 ELSE 10000 END AS double) AS rope_theta,
  cast(0.001 AS double) AS rms_eps,
  CASE WHEN p_partkey % 2 = 0 THEN 'float16' ELSE 'float32' END AS dtype
FROM (
  SELECT p_partkey, p_size,
    CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS n_head
  FROM {part}
) AS sized
"""

# Files of training folders, one per page; names repeat between folders.
FILES = """
SELECT 'run' || cast(page_id % 40 AS varchar(20)) AS folder, name,
  'run' || cast(page_id % 40 AS varchar(20)) || '/' || name AS path, cast(page_id * 10 AS bigint) AS length
FROM (
  SELECT page_id, CASE page_id % 11
    WHEN 0 THEN 'dataset.jsonl'
    WHEN 1 THEN 'dataset_chatml_text.jsonl'
    WHEN 2 THEN 'dataset_llama3_text.jsonl'
    WHEN 3 THEN 'dataset_chatml_nosystem.jsonl'
    WHEN 4 THEN 'dataset_llama3_nosystem.jsonl'
    WHEN 5 THEN 'corpus.txt'
    WHEN 6 THEN 'model' || cast(page_id % 30 AS varchar(20)) || '.gguf'
    ELSE 'z' || cast(page_id % 90 AS varchar(20)) || '.jsonl'
  END AS name
  FROM {pages}
) AS named
"""

# Token scores: one group per vector, one candidate per dimension.
SCORES_SPARK = """
SELECT vec_id AS group_id, label AS target, cand_id, round(cast(x AS double) * 20, 3) AS score
FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS cand_id, x
"""
SCORES_DUCK = """
SELECT vec_id AS group_id, label AS target, cast(i AS integer) AS cand_id,
  round(cast(embedding[i + 1] AS double) * 20, 3) AS score
FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)
"""


def dirty(t: Tables) -> DataFrame:
    return t.sql(DIRTY, documents=t.documents)


def json_lines(t: Tables) -> DataFrame:
    return t.sql(JSON_LINES, documents=t.documents)


def turn_lines(t: Tables) -> DataFrame:
    return t.sql(TURN_LINES, conversations=t.conversations)


def run_log(t: Tables) -> DataFrame:
    return t.sql(RUN_LOG, events=t.events)


def configs(t: Tables) -> DataFrame:
    return t.sql(CONFIGS, part=t.part)


def files(t: Tables) -> DataFrame:
    return t.sql(FILES, pages=t.pages)


def scores(t: Tables) -> DataFrame:
    return t.sql(SCORES_SPARK, embeddings=t.embeddings)


def ctes(**parts: str) -> str:
    """``WITH`` clause for DuckDB; fixture texts get their plain table names."""
    tables = ("documents", "events", "part", "pages", "embeddings", "conversations")
    names = {name: name for name in tables}
    known = {
        "dirty": DIRTY, "json_lines": JSON_LINES, "turn_lines": TURN_LINES,
        "run_log": RUN_LOG, "configs": CONFIGS, "files": FILES, "scores": SCORES_DUCK,
    }
    bodies = []
    for name, text in parts.items():
        body = known[name].format(**names) if text is None else text
        bodies.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(bodies)
