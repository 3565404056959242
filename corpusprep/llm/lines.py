"""Fuzzy duplicate lines by edit similarity, or by SimHash and edit similarity."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import BROADCAST_ROWS
from corpusprep.llm.components import connected_components
from corpusprep.llm.hashing import _A, WordHashes, mix, word_hashes
from corpusprep.session import cut_lineage, shuffle_width

#: SimHashes of linked lines differ in this many of 64 bits at most.
DISTANCE = 3
#: The bits are cut into this many blocks; two lines within the distance agree in `BLOCKS - DISTANCE` of them.
BLOCKS = 5
#: Words of the longest runs that `similar_lines` takes as keys.
RUN = 2
#: Bits of the slots in which a sample of about `_SAMPLE` texts counts runs.
_SLOT_BITS = 21
_SAMPLE = 10_000
#: Wanted lines up to which a filter of `_FILTER_BITS` bits picks them; beyond that all lines are encoded.
_FILTER_LINES = 4_000_000
_FILTER_BITS = 27
_STEP = 1 << 18
_WORD = re.compile(r"[^\W\d_]+|\d+")


def line_words(line: str) -> list[str]:
    """Lower-cased words without punctuation; any number is the same word."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(line.lower())]


def simhashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of word hashes; runs are not empty."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > lengths[:, None], axis=1).view(np.uint64).ravel()


def parities(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 parities of each run of word hashes; a changed word flips two of them at most, one more or less a single one."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), starts)


def _edits(longer: int, percent: int) -> int:
    return longer * (100 - percent) // 100


@lru_cache(1 << 14)
def key_counts(n: int, percent: int) -> tuple[int, ...]:
    """How many of its smallest runs of 1 to `RUN` words, in any one order, a line of `n` words needs as keys.

    Let the longer line of a linked pair have m words and k edits be allowed. An edit breaks q
    runs of q words of a line at most, a word that only the other line has one less; so
    m - q + 1 - q * k runs stay at least. While that is one or more the lines share a run, and
    as only so many runs of each are not shared, they share one of the first such many and one.
    A pair uses the longest runs for which this holds, which depends on m alone.
    """
    counts = [0] * RUN
    longer = n
    while longer - _edits(longer, percent) <= n:
        k = _edits(longer, percent)
        if k:
            q = max(q for q in range(1, RUN + 1) if q == 1 or longer - q + 1 - q * k >= 1)
            counts[q - 1] = max(counts[q - 1], q * k - (longer - n) + 1)
        longer += 1
    return tuple(counts)


def _runs(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of each run of `size` words that lies in one line."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = mix(total * _A + hashes[k : k + n])
    inside = owner[:n] == owner[size - 1 : size - 1 + n]
    return owner[:n][inside], total[inside]


def _slots(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def line_keys(hashes: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of the runs that each line needs, rare ones first; lines within the edits share a key."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    wanted = np.array([key_counts(int(n), percent) for n in lengths], np.int64).reshape(len(lengths), RUN)
    lines, keys = [], []
    for size in range(1, RUN + 1):
        own, runs = _runs(hashes, owner, size)
        needed = wanted[own, size - 1] > 0
        own, runs = own[needed], runs[needed]
        key = (ranks[_slots(runs)].astype(np.uint64) << np.uint64(56)) | (runs >> np.uint64(8))
        order = np.lexsort((key, own))
        own, key = own[order], key[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        own, key = own[new], key[new]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        first = place < wanted[own, size - 1]
        lines.append(own[first])
        keys.append(key[first])
    return np.concatenate(lines), np.concatenate(keys)


def encoded(hashes: np.ndarray) -> str:
    """A character for each word, so that edits of words are edits of characters."""
    return ((mix(hashes) >> np.uint64(44)).astype("<u4") + np.uint32(0x10000)).tobytes().decode("utf-32-le")


def _line_hash(words: list[str]) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


_LINE = pa.schema([("id", pa.int64()), ("line_no", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("sim", pa.int64())])


def _lines(signature: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        rows: list[tuple] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([r[4] for r in rows], np.int64)
            sims = np.zeros(len(rows), np.uint64)
            full = lengths > 0
            if full.any():
                own = lengths[full]
                starts = np.concatenate(([0], np.cumsum(own)[:-1]))
                sims[full] = signature(mix(np.concatenate(parts)), starts, own)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.array(sims.view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, schema=_LINE)

        for batch in batches:
            for row, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                for number, line in enumerate((text.as_py() or "").split("\n")):
                    words = line_words(line)
                    rows.append((row, number, *(_line_hash(words) if words else (0, 0)), len(words)))
                    if words:
                        parts.append(word_hashes(words, cache))
                    size += len(words) + 1
                    if size >= _STEP:
                        yield flush()
                        rows, parts, size = [], [], 0
        if rows:
            yield flush()

    return run


def _worded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[list[str]], np.ndarray, np.ndarray]]:
    """Words, mixed hashes and lengths of the lines with words, many lines at a time."""
    cache = WordHashes()
    found: list[list[str]] = []
    size = 0

    def step() -> tuple:
        hashes = mix(np.concatenate([word_hashes(words, cache) for words in found]))
        return found, hashes, np.array([len(words) for words in found], np.int64)

    for batch in batches:
        for text in batch.column("text"):
            for line in (text.as_py() or "").split("\n"):
                if words := line_words(line):
                    found.append(words)
                    size += len(words)
                    if size >= _STEP:
                        yield step()
                        found, size = [], 0
    if found:
        yield step()


def _run_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << _SLOT_BITS, np.int64)
    for _, hashes, lengths in _worded(batches):
        owner = np.repeat(np.arange(len(lengths)), lengths)
        for size in range(1, RUN + 1):
            counts += np.bincount(_slots(_runs(hashes, owner, size)[1]), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["slot", "n"])


def run_ranks(texts: DataFrame) -> np.ndarray:
    """How common the runs of each slot are, 0 to 255, in a sample; any ranks give the same links, these the fewest pairs."""
    total = texts.count()
    sample = texts if total <= _SAMPLE else texts.sample(fraction=_SAMPLE / total, seed=7)
    counted = sample.mapInArrow(_run_slots, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")
    found = counted.toArrow()
    ranks = np.zeros(1 << _SLOT_BITS, np.uint8)
    ranks[found["slot"].to_numpy()] = np.minimum(255, 16 * np.log2(found["n"].to_numpy().astype(float)))
    return ranks


def _keys(shared, percent: int):
    """``key, h1`` of all lines; `shared` is a broadcast of the ranks."""
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, hashes, lengths in _worded(batches):
            own, keys = line_keys(hashes, lengths, shared.value, percent)
            h1 = np.array([_line_hash(words)[0] for words in lines], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h1[own])], schema=schema)

    return run


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and line, the distinct ones whose key stands on two lines or more."""
    last: tuple | None = None  # the row before, and whether its key has met two lines
    for batch in batches:
        keys, h1 = batch.column("key").to_numpy(), batch.column("h1").to_numpy()
        if not len(keys):
            continue
        held = last is not None and not last[2]
        if held:
            keys, h1 = np.concatenate(([last[0]], keys)), np.concatenate(([last[1]], h1))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (h1[1:] != h1[:-1])
        if last is not None and not held:
            new[0] = (keys[0], h1[0]) != last[:2]
        keys, h1 = keys[new], h1[new]
        if not len(keys):
            continue
        met = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        met[1:] |= same
        met[:-1] |= same
        if last is not None and not held and keys[0] == last[0]:
            met[keys == last[0]] = True
        last = (keys[-1], h1[-1], bool(met[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[met]), pa.array(h1[met])], ["key", "h1"])


def _filter_slots(h1: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _wanted_codes(shared):
    """``h1, h2, words`` of the lines that the bits of `shared` let through, of all lines without bits."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for lines, _, _ in _worded(batches):
            names = np.array([_line_hash(words) for words in lines], np.int64)
            chosen = np.arange(len(lines))
            if shared is not None:
                slots = _filter_slots(np.ascontiguousarray(names[:, 0]))
                chosen = np.flatnonzero(shared.value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
            codes = [encoded(word_hashes(lines[k], cache)) for k in chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[chosen, 0]), pa.array(names[chosen, 1]), pa.array(codes, pa.string())], schema=schema)

    return run


def _encodings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    schema = pa.schema([("node", pa.int64()), ("words", pa.string())])
    for batch in batches:
        nodes, codes = [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
            split = (text.as_py() or "").split("\n")
            for w in wanted:
                if w["line_no"] < len(split):
                    words = line_words(split[w["line_no"]])
                    if words and _line_hash(words) == (w["h1"], w["h2"]):
                        nodes.append(w["node"])
                        codes.append(encoded(word_hashes(words, cache)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(codes, pa.string())], schema=schema)


def _block_keys(sim: Column, blocks: int, distance: int) -> Column:
    """One key for each choice of blocks that two lines within the distance may agree in."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(masks, blocks - distance)):
        mask = reduce(int.__or__, chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(k), sim.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def _verified(pairs: DataFrame, codes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose edit similarity, in words, reaches the threshold."""
    one = codes.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    two = codes.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    allowed = f"cast(greatest(length(wa), length(wb)) * {100 - percent} div 100 as int)"
    return pairs.join(one, "a").join(two, "b").filter(F.expr(f"levenshtein(wa, wb, {allowed}) >= 0")).select("a", "b")


def fuzzy_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    percent: int = 80,
) -> DataFrame:
    """Groups of like lines: ``id, line_no, n_words, keep_id, keep_line_no, group_size, kept`` for every line.

    Lines are compared by their lower-cased words without punctuation, any number being the
    same word. Two lines are linked if their SimHashes over words differ in `distance` bits
    at most and their edit similarity in words, 1 - distance / longer length, is `percent`
    or more. Of each connected group the line with the smallest (id, number) stays.

    Equal lines are one node first. Lines within the distance agree in some choice of whole
    blocks, so they share a key. In each bucket of a key all lines are compared with one, which
    is linear for a large group of variants; only lines that are not connected to it by then
    are compared with the rest of the bucket.

    Lines without words (empty ones, rulers) are groups of their own and stay, as does the
    one line of a null text. Lines of rows without id come last in a group. Rows that repeat
    an id are told apart by their lines' texts only: of equal lines at the same place, all
    stay or none. No row gives no line. Other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    lines, nodes = _nodes(texts, simhashes)
    # Keys, many per line, travel with the node alone.
    keyed = nodes.select("node", F.explode(_block_keys(F.col("sim"), blocks, distance)).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    shared = cut_lineage(keyed.join(hubs.select("key", "hub"), "key"))

    def alike(s1: str, s2: str, n1: str, n2: str) -> Column:
        near = F.bit_count(F.col(s1).bitwiseXOR(F.col(s2))) <= distance
        return near & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))

    def codes(pairs: DataFrame) -> DataFrame:
        ends = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        wanted = ends.join(nodes, "node").groupBy(F.col("first.id").alias("_id")).agg(
            F.collect_list(F.struct("node", F.col("first.line_no").alias("line_no"), "h1", "h2")).alias("wanted"))
        if ends.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)  # else the texts are shuffled to the lines that are asked for
        found = texts.join(wanted, F.col("id") == F.col("_id")).select("text", "wanted")
        return cut_lineage(found.mapInArrow(_encodings, "node bigint, words string").dropDuplicates(["node"]))

    return _grouped(lines, nodes, shared, alike, codes, percent)


def similar_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Groups of like lines as those of `fuzzy_lines`, where edit similarity alone links two lines.

    No pair is lost: lines within the edits share one of the runs of words that they take as
    keys (`key_counts`). A run that few lines of a sample have comes first, which keeps buckets
    small. Parities of the words and the lengths spare most comparisons of a bucket, and no
    linked pair fails them. Rows, nulls and ties are as in `fuzzy_lines`.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    lines, nodes = _nodes(texts, parities)
    ranks = spark.sparkContext.broadcast(run_ranks(texts))
    keyed = texts.select("text").mapInArrow(_keys(ranks, percent), "key bigint, h1 bigint")
    keyed = keyed.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "h1").mapInArrow(_met, "key bigint, h1 bigint")
    # Lines that share only half of their hash meet some strangers more.
    keyed = cut_lineage(keyed.join(nodes.select("h1", "node"), "h1").select("key", "node"))
    shared = cut_lineage(keyed.join(keyed.groupBy("key").agg(F.min("node").alias("hub")), "key"))

    def alike(s1: str, s2: str, n1: str, n2: str) -> Column:
        edits = F.floor(F.greatest(n1, n2) * (100 - percent) / 100)
        near = F.bit_count(F.col(s1).bitwiseXOR(F.col(s2))) <= 2 * edits
        return near & (F.abs(F.col(n1) - F.col(n2)) <= edits)

    def codes(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = cut_lineage(ends.join(nodes, "node").select("node", "h1", "h2"))
        bits = None
        if ends.count() <= _FILTER_LINES:
            slots = _filter_slots(ends.select("h1").toArrow()["h1"].to_numpy())
            found = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
            np.bitwise_or.at(found, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
            bits = spark.sparkContext.broadcast(found)
        words = texts.select("text").mapInArrow(_wanted_codes(bits), "h1 bigint, h2 bigint, words string")
        return cut_lineage(words.join(ends, ["h1", "h2"]).select("node", "words").dropDuplicates(["node"]))

    return _grouped(lines, nodes, shared, alike, codes, percent)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def _nodes(texts: DataFrame, signature: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """All lines, and the distinct ones with words."""
    lines = cut_lineage(texts.mapInArrow(_lines(signature), "id bigint, line_no bigint, h1 bigint, h2 bigint, n bigint, sim bigint"))
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "line_no")
    nodes = cut_lineage(
        lines.filter("n > 0").groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sim").alias("sim"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    return lines, nodes


def _grouped(
    lines: DataFrame, nodes: DataFrame, shared: DataFrame, alike: Callable[[str, str, str, str], Column],
    codes: Callable[[DataFrame], DataFrame], percent: int,
) -> DataFrame:
    """The groups of all lines from ``key, node, hub``, a row for each line of a bucket."""
    facts = nodes.select("node", "sim", "n")
    stars = (
        shared.filter("node <> hub").select("node", "hub").distinct().join(facts, "node")
        .join(facts.toDF("hub", "hub_sim", "hub_n"), "hub").filter(alike("sim", "hub_sim", "n", "hub_n"))
    )
    stars = cut_lineage(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = cut_lineage(_verified(stars, codes(stars), percent))
    comps = connected_components(links)

    rest = cut_lineage(_rest(shared, comps, stars, facts, alike))
    more = cut_lineage(_verified(rest, codes(rest), percent))
    whole = connected_components(links.unionByName(more))

    return _named(lines, nodes, whole)


def _rest(
    shared: DataFrame, comps: DataFrame, stars: DataFrame, facts: DataFrame, alike: Callable[[str, str, str, str], Column]
) -> DataFrame:
    """The pairs of each bucket that may be alike, were not compared yet and are not connected."""
    own = shared.join(comps, F.col("node") == F.col("id"), "left").select("key", "node", "hub", F.coalesce("component", "node").alias("comp"))
    at = comps.select(F.col("id").alias("hub"), F.col("component").alias("hub_comp"))
    own = own.join(at, "hub", "left").withColumn("apart", F.col("comp") != F.coalesce("hub_comp", "hub"))
    open_keys = own.filter("apart").select("key").distinct()
    own = cut_lineage(own.join(open_keys, "key", "left_semi").join(facts, "node").select("key", "node", "sim", "n", "comp", "apart"))
    others = own.select("key", F.col("node").alias("node2"), F.col("sim").alias("sim2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("apart").alias("apart2"))
    rest = own.filter("apart").join(others, "key").filter(
        (F.col("comp") != F.col("comp2")) & (~F.col("apart2") | (F.col("node") < F.col("node2"))) & alike("sim", "sim2", "n", "n2"))
    return rest.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(
        stars.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")),
        (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def _named(lines: DataFrame, nodes: DataFrame, whole: DataFrame) -> DataFrame:
    """Every line with the one that stays of its group; `whole` has the components of nodes with links."""
    member = nodes.join(whole, F.col("node") == F.col("id"), "left").select(
        "h1", "h2", "first", "copies", F.coalesce("component", "node").alias("group"))
    groups = member.groupBy("group").agg(F.min("first").alias("keep"), F.sum("copies").alias("size"))
    chosen = member.join(groups, "group").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keep", "size")
    joined = lines.join(chosen, (F.col("n") > 0) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    empty = F.col("k1").isNull()
    keep_id = F.when(empty, F.col("id")).otherwise(F.col("keep.id"))
    keep_line = F.when(empty, F.col("line_no")).otherwise(F.col("keep.line_no"))
    return joined.select(
        "id", "line_no", F.col("n").alias("n_words"), keep_id.alias("keep_id"), keep_line.alias("keep_line_no"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (F.col("id").eqNullSafe(keep_id) & (F.col("line_no") == keep_line)).alias("kept"),
    )


def drop_duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with all columns, their texts without the lines that do not stay."""
    gone = similar_lines(docs, id_col=id_col, text_col=text_col, **options).filter("not kept")
    gone = gone.groupBy(F.col("id").alias("_gone_id")).agg(F.collect_set("line_no").alias("_gone"))
    split = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(split, lambda line, k: ~F.array_contains(F.col("_gone"), k.cast("bigint"))), "\n")
    joined = docs.join(gone, docs[id_col].cast("bigint").eqNullSafe(F.col("_gone_id")), "left")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
