"""Reply trees from quotations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage

_MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_ATTRIBUTION = re.compile(r"\S.*\bwrote:\s*")


def quote_levels(text: str | None) -> list[tuple[int, str]]:
    """Lines with their number of quote marks; lines that only name an author are left out."""
    out = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        found = _MARKS.match(line)
        level, rest = (found.group().count(">"), line[found.end() :]) if found and ">" in found.group() else (0, line)
        if not _ATTRIBUTION.fullmatch(rest.strip()):
            out.append((level, rest))
    return out


def _passage_lines(levels: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Runs of lines of one level between blank lines, each line in lower case with single spaces."""
    out: list[tuple[int, list[str]]] = []
    last = None
    for level, line in levels:
        words = line.lower().split()
        if not words:
            last = None
            continue
        if level != last:
            out.append((level, []))
        out[-1][1].append(" ".join(words))
        last = level
    return out


def passages(levels: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Runs of lines of one level between blank lines, in lower case with single spaces."""
    return [(level, " ".join(lines)) for level, lines in _passage_lines(levels)]


def parts(lines: list[str]) -> list[str]:
    """The different lines and sentences of a passage, other than the passage itself."""
    whole = " ".join(lines)
    found = dict.fromkeys([*lines, *_SENTENCE.split(whole)])
    found.pop(whole, None)
    return list(found)


def own_text(levels: list[tuple[int, str]]) -> str:
    """What the author wrote: the lines without quote marks."""
    lines = [line.rstrip() for level, line in levels if level == 0]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _parse(min_words: int):
    passage = pa.struct([("p", pa.int32()), ("part", pa.bool_()), ("level", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("own", pa.string()), ("n_quotes", pa.int32()), ("passages", pa.list_(passage))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                levels = quote_levels(text)
                found, quotes = [], 0
                for p, (level, lines) in enumerate(_passage_lines(levels)):
                    quotes += level > 0
                    for k, words in enumerate([" ".join(lines), *parts(lines)]):
                        n = words.count(" ") + 1
                        if n >= min_words:
                            raw = xxhash.xxh3_128_digest(words.encode("utf-8", "surrogatepass"))
                            found.append({"p": p, "part": k > 0, "level": level, "n": n, "h1": int.from_bytes(raw[:8], "little", signed=True),
                                          "h2": int.from_bytes(raw[8:], "little", signed=True)})
                rows.append({"id": row, "own": own_text(levels), "n_quotes": quotes, "passages": found})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _ancestors(parents: DataFrame) -> DataFrame:
    """``id, thread_id, depth`` from ``id, parent_id``, by doubling the length of the known path.

    Messages whose path has reached its root are only looked up from then on.
    """
    rooted = F.col("parent_id").isNull()
    state = cut_lineage(parents.select(
        "id", F.coalesce("parent_id", "id").alias("up"), (~rooted).cast("int").alias("depth"), rooted.alias("done")))
    while not (waiting := state.filter("not done").drop("done")).isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), "done")
        moved = waiting.join(above, "up").select(
            "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "done")
        state = cut_lineage(state.filter("done").unionByName(moved))
    return state.select("id", F.col("up").alias("thread_id"), "depth")


def link_quotes(messages: DataFrame, *, id_col: str = "id", text_col: str = "text", min_words: int = 4) -> DataFrame:
    """Reply trees: ``id, parent_id, thread_id, depth, n_quotes, n_linked, own_text`` for every message.

    Quote marks at the start of lines give each line a level, nested quotes a higher one. Runs
    of lines of a level are passages; a quoted passage belongs to the earliest message (the
    smallest id) that has it as unquoted text. Of a quoted passage that no earlier message has
    as a whole, such as a trimmed one, the lines and sentences are looked up among the lines and
    sentences of all messages; it belongs to the owner of most of its words. The parent of a message is the owner of its
    least nested passage, the longest one first; it must be an earlier message. Ordered by
    ``thread_id, depth, id`` the messages of a thread follow what they reply to, and
    `own_text` has them without quotes and lines that only name an author.

    Passages under `min_words` words link nothing. A message without quotes that are found
    starts a thread. Null and empty texts have no passage and an empty own text. Rows without
    id have no thread and are never an owner. Rows that repeat an id are one message: its
    passages are those of all the rows, its text the first of theirs in code point order.
    """
    rows = messages.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    parsed = cut_lineage(rows.mapInArrow(
        _parse(min_words), "id bigint, own string, n_quotes int, passages array<struct<p:int,part:boolean,level:int,h1:bigint,h2:bigint,n:int>>"))
    known = parsed.filter("id is not null")
    spread = known.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.inline("passages"))
    spread = cut_lineage(spread)
    whole = spread.filter("not part")
    owners = whole.filter("level = 0").groupBy("h1", "h2").agg(F.min("id").alias("owner"))
    linked_as_whole = whole.filter("level > 0").join(owners, ["h1", "h2"]).filter("owner < id")
    quoted = cut_lineage(linked_as_whole.select("id", "row", "p", "level", "n", "owner"))
    open_parts = cut_lineage(spread.filter("level > 0").join(quoted.select("row", "p"), ["row", "p"], "left_anti"))
    if not open_parts.isEmpty():
        # Trimmed quotes: their lines and sentences among those of the messages.
        owners = spread.filter("level = 0").join(open_parts.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        owners = owners.groupBy("h1", "h2").agg(F.min("id").alias("owner"))
        met = open_parts.join(owners, ["h1", "h2"]).filter("owner < id").groupBy("id", "row", "p", "level", "owner").agg(F.sum("n").alias("n"))
        most = met.groupBy("id", "row", "p", "level").agg(F.max(F.struct("n", (-F.col("owner")).alias("o"))).alias("m"))
        quoted = quoted.unionByName(most.select(
            "id", "row", "p", "level", F.col("m.n").cast("int").alias("n"), (-F.col("m.o")).alias("owner")))
    best = quoted.groupBy("id").agg(
        F.min(F.struct("level", (-F.col("n")).alias("n"), "owner")).alias("best"), F.count("*").alias("n_linked"))
    texts = known.groupBy("id").agg(F.min("own").alias("own_text"), F.sum("n_quotes").alias("n_quotes"))
    linked = cut_lineage(texts.join(best, "id", "left").select(
        "id", F.col("best.owner").alias("parent_id"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "own_text"))
    tree = linked.join(_ancestors(linked), "id")
    nameless = parsed.filter("id is null").select(
        "id", F.lit(None).cast("bigint").alias("parent_id"), F.lit(None).cast("bigint").alias("thread_id"),
        F.lit(0).alias("depth"), F.col("n_quotes").cast("bigint").alias("n_quotes"), F.lit(0).cast("bigint").alias("n_linked"),
        F.col("own").alias("own_text"))
    return tree.select("id", "parent_id", "thread_id", "depth", "n_quotes", "n_linked", "own_text").unionByName(nameless)


def conversations(linked: DataFrame) -> DataFrame:
    """Messages in reply order: sorted by thread, depth and id over range partitions, a long thread over many."""
    return linked.repartitionByRange("thread_id", "depth", "id").sortWithinPartitions("thread_id", "depth", "id")
