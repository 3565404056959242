"""Plain-text corpora: line and document scans, and the corpus sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.text import (
    ANY_NEWLINE, clean_text, drop_bad_utf8, normalise_newlines, ustrip,
)
from corpusprep.operators.ordered import running, slice_rows
from corpusprep.session import compute_once


def ordered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, block, line, `name`): file lines with their place.

    `block` is where the split starts in its file and `line` grows within the
    split, so (path, block, line) is the reading order.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        drop_bad_utf8(F.col("value")).alias(name),
    )


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned non-empty lines of a text corpus, in reading order (path, block, line)."""
    lines = ordered_lines(spark, path, "raw")
    cleaned = compute_once(lines, ["path", "block", "line"], text=clean_text(F.col("raw")))
    return cleaned.filter(F.col("text") != "")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one cleaned row per file, newlines normalised and trimmed."""
    raw = spark.read.text(path, wholetext=True)
    text = clean_text(_universal_newlines(drop_bad_utf8(F.col("value"))))
    return raw.select(
        F.col("_metadata.file_path").alias("path"), normalise_newlines(text).alias("text")
    )


def _universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, ANY_NEWLINE, "\n")


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned non-empty lines of a text column, numbered as ``line_no``."""
    others = [c for c in df.columns if c != text]
    lines = F.transform(F.split(text, ANY_NEWLINE), lambda line: clean_text(line))
    return df.select(*others, F.posexplode(lines).alias("line_no", text)).filter(F.col(text) != "")


def split_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Trimmed non-empty paragraphs of a text column, numbered as ``paragraph_no``."""
    others = [c for c in df.columns if c != text]
    body = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    parts = F.transform(F.split(body, "\n\n"), ustrip)
    return df.select(*others, F.posexplode(parts).alias("paragraph_no", text)).filter(
        F.col(text) != ""
    )


def scan_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph_no, text): the paragraphs of `scan_documents`, of files that are read in splits.

    Lines are cleaned one by one, and a blank one ends a paragraph; decoded tags may add line breaks
    of their own. The blank lines before each line are counted in slices along the file, so no
    file is held as a whole, only a paragraph. Numbers grow within a file and may have gaps. A
    byte-order mark that opens a file is left out.
    """
    lines = ordered_lines(spark, path, "raw")
    # A carriage return that a tag leaves at the end of a line belongs to its break.
    body = F.replace(F.regexp_replace(clean_text(F.col("raw")), r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))
    parts = lines.select("path", "block", "line", F.posexplode(F.split(body, "\n")).alias("part", "text"))
    place = ["block", "line", "part"]
    blank = F.when(F.col("text") == "", 1).otherwise(0)
    counted = running(slice_rows(parts, ["path"], place), ["path"], place, {"paragraph_no": blank})
    ordered = F.sort_array(F.collect_list(F.struct(*place, "text")))
    whole = counted.filter(F.col("text") != "").groupBy("path", "paragraph_no").agg(ordered.alias("rows"))
    texts = compute_once(whole, ["path", "paragraph_no"], text=ustrip(F.array_join("rows.text", "\n")))
    return texts.filter(F.col("text") != "")


def write_corpus(df: DataFrame, path: str, text: str = "text") -> None:
    """One cleaned line per row, replacing what the path held."""
    df.select(text).write.mode("overwrite").text(path)


def write_run(df: DataFrame, path: str) -> None:
    """Parquet output of a run, replacing what the path held."""
    df.write.mode("overwrite").parquet(path)
