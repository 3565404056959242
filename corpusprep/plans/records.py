"""Queries of the JSON-line and chat operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import chat
from corpusprep.functions.text import clean_text
from corpusprep.functions.tokens import byte_token_count
from corpusprep.operators import records as R
from corpusprep.operators.sizing import token_totals
from corpusprep.plans import duck
from corpusprep.plans.fixtures import ctes, dirty, json_lines, turn_lines
from corpusprep.plans.registry import Tables, query
from corpusprep.sources.text import clean_lines

_TRIMMED = f"SELECT line_no, {duck.strip('raw')} AS raw FROM json_lines"
_PARSED = """SELECT line_no, CASE WHEN json_valid(raw) AND raw[1] = '{' THEN raw END AS j, raw
  FROM trimmed WHERE raw <> ''"""
_LINES = ctes(json_lines=None, trimmed=_TRIMMED, parsed=_PARSED)


def _records(t: Tables) -> DataFrame:
    return R.split_rejects(R.parse_lines(json_lines(t)))[0]


@query(
    f"""{_LINES} SELECT line_no, CASE WHEN NOT json_valid(raw) THEN 'unparsable'
      WHEN j IS NULL THEN 'not an object' ELSE 'ok' END AS status, length(raw) AS raw_length FROM parsed"""
)
def jsonl_scan(t: Tables) -> DataFrame:
    parsed = R.parse_lines(json_lines(t))
    return parsed.select(
        "line_no",
        F.coalesce("reject", F.lit("ok")).alias("status"),
        F.length("raw").cast("bigint").alias("raw_length"),
    )


def _field_rows() -> str:
    rows = ", ".join(
        f"{{'field_rank': {i}, 'field': '{n}', 'value': CASE WHEN json_type(j, '$.{n}') = 'VARCHAR' "
        f"THEN json_extract_string(j, '$.{n}') END}}"
        for i, n in enumerate(R.TEXT_FIELDS)
    )
    return f"SELECT line_no, unnest([{rows}], recursive := true) FROM parsed WHERE j IS NOT NULL"


_FIELDS = f"""{_LINES}, fields AS ({_field_rows()}),
  cleaned AS (SELECT line_no, field_rank, field, {duck.clean("value")} AS text FROM fields
    WHERE value IS NOT NULL AND {duck.strip("value")} <> '')
  """


@query(_FIELDS + "SELECT * FROM cleaned WHERE text <> ''")
def corpus_fields(t: Tables) -> DataFrame:
    return R.corpus_fields(_records(t), ["line_no"])


_TURNS = ctes(turn_lines=None) + f""", listed AS (
    SELECT conv_id, turn, json_extract(raw, '$.messages[*]') AS l FROM turn_lines),
  messages AS (SELECT conv_id, turn, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS message_rank FROM listed),
  valued AS (SELECT conv_id, turn, message_rank,
    CASE WHEN json_type(m, '$.content') = 'VARCHAR' THEN json_extract_string(m, '$.content') END AS value FROM messages),
  texts AS (SELECT conv_id, turn, cast(message_rank AS integer) AS message_rank, {duck.clean("value")} AS text
    FROM valued WHERE value IS NOT NULL AND {duck.strip("value")} <> '')
  """


@query(_TURNS + "SELECT * FROM texts WHERE text <> ''")
def corpus_messages(t: Tables) -> DataFrame:
    good, _ = R.split_rejects(R.parse_lines(turn_lines(t)))
    return R.corpus_messages(good, ["conv_id", "turn"])


@query(
    rf"""{_FIELDS}, {ctes(dirty=None)[5:]},
    cut AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM dirty),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM cut),
    txt AS (SELECT doc_id, line_no, {duck.clean("line")} AS text FROM lines)
    SELECT cast(0 AS integer) AS source_rank, doc_id AS key, cast(line_no AS integer) AS place, text
      FROM txt WHERE text <> ''
    UNION ALL SELECT 1, line_no, field_rank, text FROM cleaned WHERE text <> ''"""
)
def corpus_union(t: Tables) -> DataFrame:
    """Corpus of text lines, then record fields, each row with its place in the order."""
    lines = clean_lines(dirty(t).select("doc_id", "text"))
    fields = R.corpus_fields(_records(t), ["line_no"])
    return lines.select(
        F.lit(0).alias("source_rank"), F.col("doc_id").alias("key"), F.col("line_no").alias("place"), "text"
    ).unionByName(
        fields.select(
            F.lit(1).alias("source_rank"), F.col("line_no").alias("key"),
            F.col("field_rank").alias("place"), "text",
        )
    )


# --- chat examples ----------------------------------------------------------


def _json_worth(name: str, source: str = "j", missing: str = "NULL") -> str:
    """{text, truthy, odd} of one JSON member, spelled with DuckDB's type names."""
    path = f"{source}, '$.{name}'"
    kind = f"json_type({path})"
    text = f"json_extract_string({path})"
    number = "('UBIGINT', 'BIGINT', 'DOUBLE')"
    truthy = (
        f"CASE {kind} WHEN 'VARCHAR' THEN {text} <> '' WHEN 'BOOLEAN' THEN {text} = 'true' "
        f"WHEN 'ARRAY' THEN json_array_length({path}) > 0 WHEN 'OBJECT' THEN {text} <> '{{}}' "
        f"ELSE coalesce({kind} IN {number} AND cast({text} AS double) <> 0, false) END"
    )
    worth = (
        f"CASE WHEN {kind} IS NULL THEN {missing} WHEN {kind} = 'VARCHAR' THEN {text} "
        f"WHEN {kind} = 'NULL' THEN NULL ELSE '' END"
    )
    return f"{{'text': {worth}, 'truthy': {truthy}, 'odd': {kind} <> 'VARCHAR' AND {truthy}}}"


def _json_chain(names: tuple) -> str:
    cases = " ".join(f"WHEN ({_json_worth(n)}).truthy THEN {_json_worth(n)}" for n in names[:-1])
    return f"CASE {cases} ELSE {_json_worth(names[-1])} END"


def _last_message(role: str, pick: str) -> str:
    mine = f"list_filter(messages, lambda m: json_extract_string(m, '$.role') = '{role}')"
    chosen = f"{mine}[{pick}]"
    return f"CASE WHEN {chosen} IS NOT NULL THEN {_json_worth('content', chosen, chr(39) * 2)} END"


_SFT = (
    _LINES
    + f""", chosen AS (
    SELECT line_no, {_json_worth("text")} AS t, {_json_worth("system", missing="''")} AS s,
      {_json_chain(R.USER_FIELDS)} AS u, {_json_chain(R.ANSWER_FIELDS)} AS a,
      CASE WHEN json_type(j, '$.messages') = 'ARRAY' THEN json_extract(j, '$.messages[*]') END AS messages0
    FROM parsed WHERE j IS NOT NULL),
  consulted AS (
    SELECT *, CASE WHEN NOT t.truthy AND (u.text IS NULL OR a.text IS NULL) THEN messages0 END AS messages
    FROM chosen),
  filled AS (
    SELECT line_no, t, CASE WHEN s.truthy THEN s ELSE coalesce({_last_message("system", "1")}, s) END AS s,
      CASE WHEN u.text IS NULL THEN {_last_message("user", "-1")} ELSE u END AS u,
      CASE WHEN a.text IS NULL THEN {_last_message("assistant", "-1")} ELSE a END AS a,
      coalesce(len(list_filter(messages, lambda m: json_type(m) <> 'OBJECT')) > 0, false) AS bad
    FROM consulted),
  judged AS (
    SELECT line_no, t.truthy AS is_text, CASE WHEN t.odd THEN 'text is not a string'
      WHEN NOT t.truthy AND bad THEN 'message is not an object'
      WHEN NOT t.truthy AND (coalesce(u.odd, false) OR coalesce(a.odd, false) OR coalesce(s.odd, false))
        THEN 'field is not a string' END AS reject,
      t.text AS t, u.text AS u, a.text AS a FROM filled),
  cleaned AS (SELECT line_no, is_text, reject, u IS NULL OR a IS NULL AS open,
    CASE WHEN t IS NOT NULL THEN {duck.clean("t")} END AS t,
    CASE WHEN u IS NOT NULL THEN {duck.clean("u")} END AS u,
    CASE WHEN a IS NOT NULL THEN {duck.clean("a")} END AS a FROM judged),
  examples AS (
    SELECT line_no, CASE WHEN is_text THEN 'text' ELSE 'pair' END AS kind,
      CASE WHEN is_text THEN t ELSE {duck.render("u", "a")} END AS example,
      CASE WHEN is_text THEN t ELSE u || a END LIKE '%<|%|>%' AS has_marker
    FROM cleaned WHERE reject IS NULL AND CASE WHEN is_text THEN t <> '' ELSE NOT open END)
  """
)


def _examples(t: Tables) -> tuple[DataFrame, DataFrame]:
    return R.sft_examples(_records(t), ["line_no"])


@query(_SFT + "SELECT * FROM examples")
def sft_examples(t: Tables) -> DataFrame:
    return _examples(t)[0]


@query(_SFT + "SELECT line_no, reject FROM cleaned WHERE reject IS NOT NULL")
def sft_rejects(t: Tables) -> DataFrame:
    return _examples(t)[1]


@query(_SFT + "SELECT line_no, example FROM examples WHERE kind = 'text'")
def sft_text_first(t: Tables) -> DataFrame:
    return _examples(t)[0].filter(F.col("kind") == "text").select("line_no", "example")


@query(
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END AS a,
        CASE WHEN doc_id % 5 = 0 THEN lang WHEN doc_id % 5 = 1 THEN '' END AS b,
        CASE WHEN doc_id % 2 = 0 THEN '' END AS c, text FROM documents)
    SELECT doc_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END AS short,
      CASE WHEN a <> '' THEN a WHEN c <> '' THEN c ELSE text END AS filled FROM c"""
)
def first_truthy(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    a = F.when(d % 3 == 0, "").when(d % 3 == 1, F.col("source"))
    b = F.when(d % 5 == 0, F.col("lang")).when(d % 5 == 1, "")
    c = F.when(d % 2 == 0, "")
    return t.documents.select(
        "doc_id",
        chat.first_truthy(a, b, c).alias("short"),
        chat.first_truthy(a, c, F.col("text")).alias("filled"),
    )


# The first turn of a role in ascending, the last in descending order.
_PAIRS = """WITH pairs AS (SELECT conv_id,
    arg_min(text, turn) FILTER (role = 'system') AS system,
    arg_max(text, turn) FILTER (role = 'user') AS user,
    arg_max(text, turn) FILTER (role = 'assistant') AS assistant
  FROM conversations GROUP BY conv_id)
  """


@query(_PAIRS + "SELECT * FROM pairs")
def chat_pairs(t: Tables) -> DataFrame:
    return R.pair_from_messages(t.conversations)


@query(_PAIRS + 'SELECT * FROM pairs WHERE "user" IS NOT NULL AND assistant IS NOT NULL')
def complete_pairs(t: Tables) -> DataFrame:
    return R.complete_pairs(R.pair_from_messages(t.conversations))


def _turn_sql(before: str, after: str, end: str, role: str, text: str) -> str:
    return f"'{before}{role}' || {after} || {duck.controls(duck.fences(duck.strip(text)))} || {end}"


def _render_sql(begin: str, before: str, after: str, end: str) -> str:
    def turn(role: str, text: str) -> str:
        return _turn_sql(before, after, end, role, text)

    return f"""SELECT conv_id, '{begin}'
      || CASE WHEN {duck.strip("system")} <> '' THEN {turn("system", "system")} ELSE '' END
      || {turn("user", '"user"')} || {turn("assistant", "assistant")} AS example
      FROM pairs WHERE "user" IS NOT NULL AND assistant IS NOT NULL"""


def _rendered(t: Tables, template: str) -> DataFrame:
    pairs = R.complete_pairs(R.pair_from_messages(t.conversations))
    example = chat.render_chat(F.col("system"), F.col("user"), F.col("assistant"), template)
    return pairs.select("conv_id", example.alias("example"))


_HEADER_SQL = _render_sql(
    "<|begin_of_text|>", "<|start_header_id|>", "'<|end_header_id|>' || chr(10) || chr(10)", "'<|eot_id|>'"
)


@query(_PAIRS + _HEADER_SQL)
def render_chat(t: Tables) -> DataFrame:
    return _rendered(t, "header")


@query(_PAIRS + _render_sql("", "<|im_start|>", "chr(10)", "'<|im_end|>' || chr(10)"))
def render_chatml(t: Tables) -> DataFrame:
    return _rendered(t, "chatml")


@query(
    f"""{_PAIRS}, whole AS (SELECT {duck.clean('"user"')} AS u, {duck.clean("assistant")} AS a, system IS NOT NULL AS has_system
      FROM pairs WHERE "user" IS NOT NULL AND assistant IS NOT NULL),
    rendered AS (SELECT has_system, {duck.render("u", "a")} AS example FROM whole)
    SELECT has_system, count(*) AS examples, cast(sum(len({duck.byte_list("example")})) AS bigint) AS tokens
    FROM rendered GROUP BY has_system"""
)
def flagship(t: Tables) -> DataFrame:
    """Chat turns to training examples: how many, and how many tokens, with and without a system turn."""
    pairs = R.complete_pairs(R.pair_from_messages(t.conversations))
    example = chat.render_chat(None, clean_text(F.col("user")), clean_text(F.col("assistant")))
    examples = pairs.select(F.col("system").isNotNull().alias("has_system"), example.alias("example"))
    return token_totals(examples, byte_token_count(F.col("example")), ["has_system"])
