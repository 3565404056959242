"""Queries of the cleaning functions, over documents with planted artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import text as T
from corpusprep.plans import duck
from corpusprep.plans.fixtures import ctes, dirty
from corpusprep.plans.registry import Tables, query
from corpusprep.sources.text import clean_lines as clean_lines_of
from corpusprep.sources.text import split_paragraphs

_DIRTY = ctes(dirty=None)


def _scalar(expression: str) -> str:
    return f"{_DIRTY} SELECT doc_id, {expression} AS text FROM dirty"


@query(_scalar(duck.unhex("text")))
def decode_hex(t: Tables) -> DataFrame:
    return dirty(t).select("doc_id", T.decode_hex_tags(F.col("text")).alias("text"))


@query(_scalar(duck.diag("text")))
def strip_diag(t: Tables) -> DataFrame:
    return dirty(t).select("doc_id", T.strip_diag_markers(F.col("text")).alias("text"))


@query(
    _scalar(
        r"regexp_replace(regexp_replace(text, '(?i)(^|[^\p{L}\p{N}_])(?:CR13|LF10|CR|LF)"
        r"([^\p{L}\p{N}_]|$)', '\1\2', 'g'), '(?i)(^|[^\p{L}\p{N}_])(?:CR13|LF10|CR|LF)"
        r"([^\p{L}\p{N}_]|$)', '\1\2', 'g')"
    )
)
def strip_diag_whole_word(t: Tables) -> DataFrame:
    return dirty(t).select(
        "doc_id", T.strip_diag_markers(F.col("text"), mode="whole_word").alias("text")
    )


@query(_scalar(duck.fences("text")))
def strip_fences(t: Tables) -> DataFrame:
    return dirty(t).select("doc_id", T.strip_fence_lines(F.col("text")).alias("text"))


@query(_scalar(duck.controls("text")))
def strip_controls(t: Tables) -> DataFrame:
    return dirty(t).select("doc_id", T.strip_controls(F.col("text")).alias("text"))


@query(_scalar(duck.clean("text")))
def clean_text(t: Tables) -> DataFrame:
    return dirty(t).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(_scalar(duck.strip("replace(text, chr(13) || chr(10), chr(10))")))
def normalise_newlines(t: Tables) -> DataFrame:
    return dirty(t).select("doc_id", T.normalise_newlines(F.col("text")).alias("text"))


@query(_scalar(duck.strip("text")))
def ustrip(t: Tables) -> DataFrame:
    return dirty(t).select("doc_id", T.ustrip(F.col("text")).alias("text"))


@query(
    f"""{_DIRTY}, holes AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS text FROM dirty)
    SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE {duck.clean("text")} END AS corpus_text,
      CASE WHEN text IS NOT NULL THEN {duck.clean("text")} END AS record_text FROM holes"""
)
def null_policy(t: Tables) -> DataFrame:
    holes = dirty(t).withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    return holes.select(
        "doc_id",
        T.clean_text(F.col("text")).alias("corpus_text"),
        T.clean_text(F.col("text"), null_policy="keep").alias("record_text"),
    )


@query(
    rf"""{_DIRTY}, cut AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM dirty),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM cut)
    SELECT * FROM (SELECT doc_id, cast(line_no AS integer) AS line_no, {duck.clean("line")} AS text FROM lines)
    WHERE text <> ''"""
)
def clean_lines(t: Tables) -> DataFrame:
    return clean_lines_of(dirty(t).select("doc_id", "text"), "text")


PARAGRAPHS = rf"""{_DIRTY}, cut AS (
      SELECT doc_id, string_split(replace({duck.clean("text")}, chr(13) || chr(10), chr(10)), chr(10) || chr(10)) AS l
      FROM dirty),
    parts AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS paragraph_no FROM cut),
    paragraphs AS (SELECT * FROM (SELECT doc_id, cast(paragraph_no AS integer) AS paragraph_no, {duck.strip("p")} AS text FROM parts)
    WHERE text <> '')"""


@query(PARAGRAPHS + " SELECT * FROM paragraphs")
def paragraphs(t: Tables) -> DataFrame:
    cleaned = dirty(t).select("doc_id", T.clean_text(F.col("text")).alias("text"))
    return split_paragraphs(cleaned, "text")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || 'A'
      WHEN 2 THEN text || text ELSE 'П' || text END AS text FROM documents"""
)
def drop_bad_utf8(t: Tables) -> DataFrame:
    broken = t.documents.selectExpr(
        "doc_id",
        """CASE doc_id % 4 WHEN 0 THEN cast(text AS binary)
          WHEN 1 THEN cast(text AS binary) || X'E28241FF'
          WHEN 2 THEN cast(text AS binary) || X'F09F98' || cast(text AS binary)
          ELSE X'80D09FC0AF' || cast(text AS binary) END AS data""",
    )
    return broken.select("doc_id", T.drop_bad_utf8(F.col("data")).alias("text"))
