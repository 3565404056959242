"""Encoding with a learned vocabulary, and back.

Both directions work row by row in Arrow batches, so the corpus is not
shuffled. The vocabulary is bounded and its size is checked before it is
broadcast. The most frequent words are encoded once, as a table, and looked up.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.text import strip_fences_and_controls
from corpusprep.functions.tokens import (
    BOS, EOS, FIRST_BYTE, FIRST_LEARNED, MARKER_IDS, MARKER_PATTERN, SPACE_MARK, UNK, WORD_PATTERN,
)
from corpusprep.session import cut_lineage

# The helpers travel with the functions, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_VOCAB = 2_000_000
#: Words whose ids are looked up; rarer ones are encoded where they stand.
HEAD_WORDS = 1 << 17
#: Ids that a task holds before it hands them on, about; a batch of long texts has many times more.
BATCH_IDS = 1 << 18
#: Characters up to which a word is merged without a heap.
SHORT_WORD = 32
_NO_ID = 1 << 62


def _bounded_rows(df: DataFrame) -> list:
    rows = df.limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary may have at most {MAX_VOCAB} rows")
    return rows


def _merge_short(word: str, ids: dict[str, int]) -> list[str]:
    """`merge_word` by looking through all neighbours for each merge."""
    pieces = list(word)
    joined = [a + b for a, b in zip(pieces, pieces[1:])]
    found = [ids.get(piece, _NO_ID) for piece in joined]
    while found:
        best = min(found)
        if best == _NO_ID:
            break
        i = found.index(best)
        pieces[i : i + 2] = [joined[i]]
        del joined[i], found[i]
        for k in (i - 1, i):
            if 0 <= k < len(found):
                joined[k] = piece = pieces[k] + pieces[k + 1]
                found[k] = ids.get(piece, _NO_ID)
    return pieces


def merge_word(word: str, ids: dict[str, int]) -> list[str]:
    """Join neighbours into known pieces: lowest id first, leftmost first."""
    if len(word) <= SHORT_WORD:
        return _merge_short(word, ids)
    pieces: list[str | None] = list(word)
    size = len(pieces)
    follow = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and follow[i] < size:
            joined = pieces[i] + pieces[follow[i]]
            if joined in ids:
                heapq.heappush(heap, (ids[joined], i, joined))

    for i in range(size):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if pieces[i] is None or follow[i] >= size:
            continue
        j = follow[i]
        if pieces[i] + pieces[j] != joined:
            continue  # one side has been joined in the meantime
        pieces[i], pieces[j] = joined, None
        follow[i] = follow[j]
        if follow[i] < size:
            before[follow[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in pieces if p is not None]


def word_ids(word: str, ids: dict[str, int]) -> list[int]:
    """Ids of one word; characters outside the vocabulary become their UTF-8 bytes."""
    out: list[int] = []
    for piece in merge_word(word, ids):
        if piece in ids:
            out.append(ids[piece])
        else:
            out.extend(FIRST_BYTE + b for b in piece.encode())
    return out


def _learned(vocab: DataFrame) -> dict[str, int]:
    return {r.piece: r.id for r in _bounded_rows(vocab.filter(F.col("id") >= FIRST_LEARNED).select("piece", "id"))}


def word_table(counts: DataFrame, vocab: DataFrame, limit: int = HEAD_WORDS) -> DataFrame:
    """(word, ids) of the `limit` most frequent words of (word, n), each encoded once; a written table."""
    table = vocab.sparkSession.sparkContext.broadcast(_learned(vocab))
    schema = pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            coded = [word_ids(w, table.value) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(coded, pa.list_(pa.int32()))], schema=schema)

    head = counts.orderBy(F.desc("n"), "word").limit(limit).select("word")
    spread = head.repartition(vocab.sparkSession.sparkContext.defaultParallelism, "word")
    return cut_lineage(spread.mapInArrow(encode, "word string, ids array<int>"))


def bounded_series(coded: Iterable[list[int] | None]) -> Iterator[pd.Series]:
    """The rows in series that end with the row that brings them to `BATCH_IDS` ids."""
    part: list[np.ndarray | None] = []
    size = 0
    for ids in coded:
        part.append(None if ids is None else np.array(ids, np.int32))
        size += len(ids or ())
        if size >= BATCH_IDS:
            yield pd.Series(part, dtype=object)
            part, size = [], 0
    if part:
        yield pd.Series(part, dtype=object)


def bpe_ids(vocab: DataFrame, words: DataFrame | None = None) -> Callable[[Column], Column]:
    """A function text column -> array of ids, begin and end included.

    Chat markers become their own ids, characters outside the vocabulary their UTF-8 bytes.
    `words` is the table that `word_table` makes; its words, most of any text, are only looked
    up. At most `HEAD_WORDS` rows of it are broadcast. Others are merged where they stand, which
    gives the same ids.
    """
    context = vocab.sparkSession.sparkContext
    table = context.broadcast(_learned(vocab))
    known = words.limit(HEAD_WORDS).toArrow() if words is not None else None
    head = context.broadcast(dict(zip(known["word"].to_pylist(), known["ids"].to_pylist())) if known is not None else {})

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, done = table.value, head.value
        splitter = re.compile(f"({MARKER_PATTERN})")
        word_finder = re.compile(WORD_PATTERN)

        def text_ids(text: str | None) -> list[int] | None:
            if text is None:
                return None
            marked = re.sub(" {2,}", " ", text).strip(" ").replace(" ", SPACE_MARK)
            out = [BOS]
            for part in splitter.split(marked):
                if part in MARKER_IDS:
                    out.append(MARKER_IDS[part])
                    continue
                for word in word_finder.findall(part):
                    found = done.get(word)
                    out.extend(word_ids(word, ids) if found is None else found)
            out.append(EOS)
            return out

        for texts in batches:
            yield from bounded_series(map(text_ids, texts))

    return lambda text: encode(strip_fences_and_controls(text))


def bpe_text(vocab: DataFrame) -> Callable[[Column], Column]:
    """A function ids column -> text. Controls vanish, bytes are joined before decoding."""
    context = vocab.sparkSession.sparkContext
    rows = _bounded_rows(vocab.select("id", "piece", "kind"))

    def raw(row) -> bytes:
        if row.kind == "control":
            return b""
        if row.kind == "byte":
            return bytes([row.id - FIRST_BYTE])
        if row.id == UNK:
            return " ⁇ ".encode()
        return row.piece.replace(SPACE_MARK, " ").encode()

    table = context.broadcast({r.id: raw(r) for r in rows})

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        pieces = table.value
        return ids.map(
            lambda seq: None
            if seq is None
            else b"".join(pieces[i] for i in seq).decode("utf-8", "replace")
        )

    return decode


def token_lookup(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """(id, piece, kind, n): use of each piece; counted before the join."""
    used = tokens.groupBy(F.col(token).alias("id")).agg(F.count("*").alias("n"))
    return vocab.join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
