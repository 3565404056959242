"""Fuzzy duplicate lines: SimHashes, joined on their blocks, and edit similarity."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache as cached

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import small_side
from corpusprep.llm.components import connected_components
from corpusprep.llm.hashing import _A, mix
from corpusprep.llm.lines import _WORD, _named, _texts, _verified
from corpusprep.session import cut_lineage, shuffle_width, shuffles_removed

#: A SimHash has 64 bits for each of so many hashes of a word.
PARTS = 4
#: Blocks of bits in each 64; two lines are compared if they agree in one of all blocks.
BLOCKS = 3
BLOCK_BITS = 21
#: Bits of the first two parts in which lines that are compared further differ at most. Lines at
#: the similarity of 0.8 differ in 26 of them, give or take 5; strangers in 64, give or take 6.
DISTANCE = 44
#: A block shared by more lines, with more than a sixteenth as many near pairs a line, is compared with one hub first.
BUCKET = 256
#: Neighbours by length that a line of such a block is compared with as well.
_NEIGHBOURS = 8
#: Lines of a block that a task holds; beyond that the block is compared with one hub first.
_HELD = 1 << 20
#: Lines of a block up to which pairs are looked at by their distance in it, else row by row.
_SMALL = 512
#: Characters after which lines are handed on.
_STEP = 1 << 22
#: Words up to which the bits of a line are counted one word after another, with those of all such lines.
_SHORT = 255
#: Slots in which the words of a line are counted, up to 15 each, and the numbers that hold the counts.
SLOTS, COUNTS = 64, 4
#: For each byte, its eight bits as eight byte-wide counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
#: White space for all but lower-case letters.
_LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))
_ODD, _RUN = re.compile(r"[\d_]"), re.compile(r"\w+")
_SIMS, _COUNTS = [f"s{k}" for k in range(PARTS)], [f"c{k}" for k in range(COUNTS)]
_LINE = pa.schema([
    ("id", pa.int64()), ("line_no", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()),
    *[(name, pa.int64()) for name in (*_SIMS, *_COUNTS)], ("words", pa.string()),
])
_LINE_DDL = ", ".join(f"{name} {'string' if name == 'words' else 'bigint'}" for name in _LINE.names)
_FOUND = pa.schema([("key", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


class _Words(dict):
    """The hash of a lower-cased word, that of 0 for any number."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        first = word.decode()[:1] if isinstance(word, bytes) and word[0] > 127 else word[:1]
        value = self[word] = xxhash.xxh3_64_intdigest("0" if first.isdigit() else word)
        return value


def split_words(line: str) -> list:
    """The words of a lower-cased line as `line_words` has them, in bytes where the line is ASCII without digits."""
    if line.isascii():
        raw = line.encode()
        if len(raw.translate(None, b"0123456789_")) == len(raw):
            return raw.translate(_LETTERS).split()
        return _WORD.findall(line)
    return _WORD.findall(line) if _ODD.search(line) else _RUN.findall(line)


@cached
def _classes() -> np.ndarray:
    """For each code point whether it is a letter of a word (1), a digit (2) or neither."""
    found = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(len(found))))
    for kind, pattern in ((1, r"[^\W\d_]+"), (2, r"\d+")):
        for run in re.finditer(pattern, every):
            found[run.start() : run.end()] = kind
    return found


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of a UTF-8 text belongs to."""
    classes = _classes()
    kinds = np.concatenate((classes[:128], np.zeros(128, np.uint8)))[raw]
    leads = np.flatnonzero(raw >= 0xC0)
    first = raw[leads]
    for size, low in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
        at = leads[(first >= low) & (first < (low >> 1 | 0x80))]
        points = (raw[at] & (0x7F >> size)).astype(np.uint32)
        for k in range(1, size):
            points = points << np.uint32(6) | (raw[at + k] & 0x3F)
        for k in range(size):
            kinds[at + k] = classes[points]
    return kinds


def _split(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a lower-cased text, the place among them of each word, and the words of each line."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = _kinds(raw)
    edges = np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1)) if len(raw) else np.zeros(0, np.int64)
    worded = kinds[edges] != 0
    starts = edges[worded]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.diff(edges, append=len(raw))[worded], out=offsets[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[kinds != 0])]).dictionary_encode()
    before = np.searchsorted(starts, np.flatnonzero(raw == 10))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(before, prepend=0, append=len(starts))


def simhashes(hashes: np.ndarray, lengths: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """SimHash of each run of word hashes, a row of `PARTS` numbers; runs are not empty.

    With `places`, the words are those of `hashes` at these places.
    """
    features = mix(hashes[:, None] + np.arange(PARTS, dtype=np.uint64) * _A)
    places = np.arange(len(hashes)) if places is None else places
    begin = np.cumsum(lengths) - lengths
    found = np.zeros((len(lengths), PARTS), np.uint64)
    short = np.flatnonzero(lengths <= _SHORT)
    short = short[np.argsort(-lengths[short], kind="stable")]
    found[short] = _majorities(features, places, begin[short], lengths[short])
    long = np.flatnonzero(lengths > _SHORT)
    if len(long):
        own = lengths[long]
        at = np.repeat(begin[long] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        found[long] = _long_majorities(features[places[at]], own)
    return found


def _majorities(features: np.ndarray, places: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits that more than half of a run's features have, of runs that become shorter.

    A count's binary digits are words of bits: a step adds a feature to the counts of all runs that have one more.
    """
    longest = int(lengths[0]) if len(lengths) else 0
    digits = np.zeros((longest.bit_length(), len(lengths), PARTS), np.uint64)
    more = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    for step in range(longest):
        own = more[step]
        carry = features[places[begin[:own] + step]]
        for digit in digits[: (step + 1).bit_length(), :own]:
            both = digit & carry
            digit ^= carry
            carry = both
    above, same = np.zeros((len(lengths), PARTS), np.uint64), np.full((len(lengths), PARTS), ~np.uint64(0))
    for k in reversed(range(len(digits))):
        half = np.where(lengths // 2 >> k & 1, ~np.uint64(0), np.uint64(0))[:, None]
        above |= same & digits[k] & ~half
        same &= ~(digits[k] ^ half)
    return above


def _long_majorities(features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Those of runs of any length. Bits are counted in bytes, eight at once, over 255 words at most, then added up."""
    pieces = -(-lengths // 255)
    first = np.cumsum(pieces) - pieces
    begin = np.cumsum(lengths) - lengths
    starts = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    counted = np.add.reduceat(_SPREAD[features.view(np.uint8)], starts, axis=0).view(np.uint8)
    ones = np.add.reduceat(counted, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > lengths[:, None], axis=1).view(np.uint64)


def slot_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of word codes how many words are in each slot, as `COUNTS` numbers of 16 counts.

    An edit changes two counts by one at most, so lines within k edits differ by 2 k at most in sum.
    """
    own = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(own * SLOTS + (codes & (SLOTS - 1)), minlength=len(lengths) * SLOTS).reshape(-1, SLOTS)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return (counts[:, ::2] | counts[:, 1::2] << 4).view(np.uint64)


def count_differences(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sum of the differences of the counts of each two rows of `slot_counts`."""
    total = np.zeros(one.shape, np.uint64)
    for shift in (np.uint64(0), np.uint64(4)):
        a, b = ((side >> shift & np.uint64(0x0F0F0F0F0F0F0F0F)).view(np.uint8) for side in (one, two))
        total += (np.maximum(a, b) - np.minimum(a, b)).view(np.uint64)
    total = total[:, 0] + total[:, 1] + total[:, 2] + total[:, 3]
    pairs = (total & np.uint64(0x00FF00FF00FF00FF)) + (total >> np.uint64(8) & np.uint64(0x00FF00FF00FF00FF))
    return (pairs * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def _utf8(codes: np.ndarray) -> np.ndarray:
    """The four bytes of each of `codes`, which are 0x10000 or more, as one number."""
    parts = [0xF0 | codes >> 18, 0x80 | codes >> 12 & 63, 0x80 | codes >> 6 & 63, 0x80 | codes & 63]
    return sum(part.astype("<u4") << np.uint32(8 * k) for k, part in enumerate(parts))


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    ids: list[int | None] = []
    firsts: list[int] = []
    texts: list[str] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, places, lengths = _split("\n".join(texts))
        counts = np.array([text.count("\n") + 1 for text in texts])
        begin = np.cumsum(counts) - counts
        numbers = np.arange(counts.sum()) + np.repeat(np.array(firsts, np.int64) - begin, counts)
        sims = np.zeros((len(lengths), PARTS), np.uint64)
        names = np.zeros((len(lengths), 2), np.uint64)
        hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        full = np.flatnonzero(lengths)
        if len(full):
            sims[full] = simhashes(hashes, lengths[full], places)
            data, ends = memoryview(hashes[places].view(np.uint8)), (8 * np.cumsum(lengths[full])).tolist()
            digests = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip([0, *ends], ends))
            names[full] = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        # A character for each word, so that edits of words are edits of characters.
        codes = (mix(hashes) >> np.uint64(44)).astype(np.uint32) + np.uint32(0x10000)
        counts_of = slot_counts(codes[places], lengths)
        offsets = np.concatenate(([0], 4 * np.cumsum(lengths))).astype(np.int32)
        own = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
        columns = [own, pa.array(numbers), *[pa.array(names[:, k].view(np.int64)) for k in range(2)], pa.array(lengths)]
        columns += [pa.array(sims[:, k].view(np.int64)) for k in range(PARTS)]
        columns += [pa.array(counts_of[:, k].view(np.int64)) for k in range(COUNTS)]
        columns.append(pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(_utf8(codes)[places])]))
        return pa.RecordBatch.from_arrays(columns, schema=_LINE)

    for batch in batches:
        for row, given in zip(batch.column("id").to_pylist(), batch.column("text")):
            text = (given.as_py() or "").lower()
            first = 0
            while True:
                # A long text is cut at the end of a line.
                cut = text.find("\n", _STEP) if len(text) > _STEP else -1
                piece, text = (text, "") if cut < 0 else (text[:cut], text[cut + 1 :])
                ids.append(row)
                firsts.append(first)
                texts.append(piece)
                size += len(piece) + 1
                if size >= _STEP:
                    yield flush()
                    ids, firsts, texts, size = [], [], [], 0
                if cut < 0:
                    break
                first += piece.count("\n") + 1
    if texts:
        yield flush()


def _blocks(part: int) -> Column:
    """The key of each block of a part, with the block's number in it."""
    keys = []
    for block in range(BLOCKS):
        bits = F.shiftrightunsigned(f"s{part}", BLOCK_BITS * block).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        keys.append((bits + ((part * BLOCKS + block) << BLOCK_BITS)).cast("int"))
    return F.array(*keys)


def _near(sims: np.ndarray, others: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(sims ^ others)
    return bits[..., 0] + bits[..., 1] <= DISTANCE


def _close(n: np.ndarray, least: np.ndarray, counts: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs whose words may be within the edits; the second line is the longer one."""
    stay = count_differences(counts[one], counts[two]) <= 2 * (n - least)[two]
    return one[stay], two[stay]


def _small_blocks(keys: np.ndarray, n: np.ndarray, least: np.ndarray, sims: np.ndarray, counts: np.ndarray, steps: int = _SMALL) -> list[tuple[np.ndarray, np.ndarray]]:
    """Near rows of equal key, in rows sorted by key and `n`, as far as they are at most so many steps apart."""
    found = []
    one, step = np.arange(len(keys) - 1), 1
    while len(one) and step <= steps:
        two = one + step
        stay = (keys[one] == keys[two]) & (least[two] <= n[one])
        one, two = one[stay], two[stay]
        near = _near(sims[one], sims[two])
        found.append(_close(n, least, counts, one[near], two[near]))
        step += 1
        one = one[one + step < len(keys)]
    return found


def _large_block(n: np.ndarray, least: np.ndarray, sims: np.ndarray, counts: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Near rows of one key, in rows sorted by `n`; none if there are more than `most`."""
    found, total, high = [], 0, 32
    ends = np.searchsorted(least, n, side="right")
    for low in range(0, len(n), high):
        rows = np.arange(low, min(low + high, len(n)))
        others = np.arange(low + 1, ends[rows[-1]])
        fit = (others > rows[:, None]) & (others < ends[rows][:, None])
        one, two = np.nonzero(fit & _near(sims[rows][:, None], sims[low + 1 : ends[rows[-1]]]))
        found.append(_close(n, least, counts, rows[one], others[two]))
        total += len(found[-1][0])
        if total > most:
            return None
    return found


def _met(percent: int, bucket: int):
    """Of rows sorted by key: ``key, a, b`` of near lines, and ``key, a`` of the lines in a block that has too many of them."""

    def rows_of(*columns: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    def compared(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((columns[1], columns[0]))
        keys, n, nodes, sims, counts = (c[order] for c in columns)
        least = n - n * (100 - percent) // 100
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((begin, [len(keys)])))
        alone = max(1, bucket // 16)
        small = np.repeat((sizes <= min(bucket, _SMALL)) & (sizes > 1), sizes)
        at = np.flatnonzero(small)
        pairs = [(at[a], at[b]) for a, b in _small_blocks(keys[at], n[at], least[at], sims[at], counts[at])] if len(at) else []
        for first, size in zip(begin[sizes > min(bucket, _SMALL)].tolist(), sizes[sizes > min(bucket, _SMALL)].tolist()):
            own = slice(first, first + size)
            more = _large_block(n[own], least[own], sims[own], counts[own], size * (alone if size > bucket else size))
            if more is None:
                yield rows_of(keys[own], nodes[own], None)
                more = _small_blocks(keys[own], n[own], least[own], sims[own], counts[own], _NEIGHBOURS)
            pairs += [(a + first, b + first) for a, b in more]
        if pairs:
            one, two = (np.concatenate(ends) for ends in zip(*pairs))
            yield rows_of(keys[one], np.minimum(nodes[one], nodes[two]), np.maximum(nodes[one], nodes[two]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, crowded = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("key", "n", "node")]
            rows += [np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1) for names in (_SIMS[:2], _COUNTS)]
            if crowded is not None:
                end = int(np.searchsorted(rows[0], crowded, side="right"))
                if end:
                    yield rows_of(rows[0][:end], rows[2][:end], None)
                if end == batch.num_rows:
                    continue
                rows, crowded = [c[end:] for c in rows], None
            # The last block may go on in the next batch.
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last or held and held[0][0][0] != rows[0][-1]:
                held.append([c[:last] for c in rows])
                yield from compared(*(np.concatenate(c) for c in zip(*held)))
                held, count = [], 0
            held.append([c[last:] for c in rows])
            count += len(rows[0]) - last
            if count > _HELD:
                crowded = rows[0][-1]
                yield from (rows_of(h[0], h[2], None) for h in held)
                held, count = [], 0
        if held:
            yield from compared(*(np.concatenate(c) for c in zip(*held)))

    return run


def _met_apart(percent: int):
    """The ``a, b`` of near lines of one key and different components of which one at least is apart; rows are sorted by key, those apart first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("key", "n", "node", "comp")] + [batch.column("apart").to_numpy(zero_copy_only=False)]
            rows += [np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1) for names in (_SIMS[:2], _COUNTS)]
            edges = [0, *(np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1).tolist(), batch.num_rows]
            for low, end in zip(edges, edges[1:]):
                own = [c[low:end] for c in rows]
                if held and held[0][0] != own[0][0]:
                    held = []
                before = len(held[0]) if held else 0
                new = [c[own[4]] for c in own]
                held = [np.concatenate(c) for c in zip(held, new)] if held else new
                place = np.where(own[4], before + np.cumsum(own[4]) - 1, len(held[0]))
                for k in range(len(held[0])):
                    at = np.flatnonzero((place > k) & (own[3] != held[3][k]))
                    at = at[_near(own[5][at], held[5][k])]
                    longer = np.maximum(own[1][at], held[1][k])
                    edits = longer * (100 - percent) // 100
                    differ = count_differences(own[6][at], np.broadcast_to(held[6][k], (len(at), COUNTS)).copy())
                    at = at[(np.abs(own[1][at] - held[1][k]) <= edits) & (differ <= 2 * edits)]
                    if len(at):
                        one, two = own[2][at], held[2][k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return run


def fuzzy_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bucket: int = BUCKET) -> DataFrame:
    """Groups of like lines: ``id, line_no, n_words, keep_id, keep_line_no, group_size, kept`` for every line.

    Lines are compared by their lower-cased words without punctuation, any number being the same
    word. Two lines are linked if their SimHashes of 256 bits agree in one of twelve blocks of 21
    bits and differ in `DISTANCE` of the first 128 bits at most, and if their edit similarity in
    words, 1 - distance / longer length, is `percent` or more. Of each connected group the line
    with the smallest (id, number) stays.

    By the pigeonhole principle lines whose SimHashes differ in 11 bits or fewer always meet.
    Beyond that they meet with a chance that falls with their similarity: a line of 20 words with
    one changed meets its original in three of four cases, one of 40 in 19 of 20.

    Equal lines are one node first. A block's lines are compared in the task that gets it, whose
    comparisons grow with the square of the block and cost some nanoseconds each. Pairs are handed
    on if the words counted in `SLOTS` slots may be within the edits, which loses no link. A block of over
    `bucket` lines with many near ones, or of over a million lines, is compared with one hub, which
    is linear in a group of variants, and then only lines that are not connected to it with the rest.

    Lines without words (empty ones, rulers) are groups of their own and stay, as does the one
    line of a null text. Lines of rows without id come last in a group. Rows that repeat an id
    are told apart by their lines' texts only: of equal lines at the same place, all stay or
    none. Long texts are read line by line. No row gives no line. Other columns are not read.
    Words are equal if their hashes are, of 64 bits for equal lines and of 20 bits in edits.
    """
    spark = docs.sparkSession
    with shuffles_removed(spark):
        lines = cut_lineage(_texts(docs, id_col, text_col).mapInArrow(_lines, _LINE_DDL))
        place = F.struct(F.col("id").isNull().alias("unknown"), "id", "line_no")
        nodes = cut_lineage(
            lines.filter("n > 0").groupBy("h1", "h2")
            .agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in (*_SIMS, *_COUNTS)])
            .withColumn("node", F.monotonically_increasing_id())
        )
        # Lines with no word to change are linked with nothing.
        changed = nodes.filter(F.col("n") >= _shortest(percent))
        # One part after another, so that only its keys are on disk.
        found = None
        for part in range(PARTS):
            keyed = changed.select("node", "n", *_SIMS[:2], *_COUNTS, F.explode(_blocks(part)).alias("key"))
            keyed = keyed.repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
            met = cut_lineage(keyed.mapInArrow(_met(percent, bucket), "key int, a bigint, b bigint"))
            found = met if found is None else found.unionByName(met)
        pairs = found.filter("b is not null").select("a", "b")
        members = found.filter("b is null").select("key", F.col("a").alias("node"))
        crowded = not members.isEmpty()

        facts = nodes.select("node", F.struct("s0", "s1").alias("sim"), "n")
        if crowded:
            shared = cut_lineage(members.join(members.groupBy("key").agg(F.min("node").alias("hub")), "key"))
            stars = shared.filter("node <> hub").select("node", "hub").distinct().join(facts, "node").join(
                facts.toDF("hub", "hub_sim", "hub_n"), "hub").filter(_alike(percent, "sim", "hub_sim", "n", "hub_n"))
            pairs = pairs.unionByName(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))
        pairs = cut_lineage(pairs.distinct())
        whole = _connected(lines, nodes, pairs, percent)
        if crowded:
            rest = cut_lineage(_rest(shared, whole, nodes, percent))
            more = cut_lineage(_verified(rest, _codes(lines, nodes, rest), percent))
            if not more.isEmpty():
                whole = connected_components(_hung(whole).unionByName(more))
    return _named(lines, nodes, whole)


def _shortest(percent: int) -> int:
    """Words of the shortest line that another one can be linked with."""
    longer = 1
    while longer * (100 - percent) // 100 == 0 and percent < 100:
        longer += 1
    return max(1, longer - 1)


def _alike(percent: int, one: str, two: str, n: str, m: str) -> Column:
    """Whether SimHashes are near; no pair within the edits fails the test of lengths."""

    def differ(name: str) -> Column:
        return F.bit_count(F.col(f"{one}.{name}").bitwiseXOR(F.col(f"{two}.{name}")))

    edits = F.floor(F.greatest(n, m) * (100 - percent) / 100)
    return (F.abs(F.col(n) - F.col(m)) <= edits) & (differ("s0") + differ("s1") <= DISTANCE)


def _rest(shared: DataFrame, whole: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs of each block that may be alike and are not connected; `shared` has the ``key, node, hub`` of its lines."""
    own = shared.join(whole, F.col("node") == F.col("id"), "left").select("key", "node", "hub", F.coalesce("component", "node").alias("comp"))
    at = whole.select(F.col("id").alias("hub"), F.col("component").alias("hub_comp"))
    own = cut_lineage(own.join(at, "hub", "left").select("key", "node", "comp", (F.col("comp") != F.coalesce("hub_comp", "hub")).alias("apart")))
    own = own.join(own.filter("apart").select("key").distinct(), "key", "left_semi").join(nodes.select("node", "n", *_SIMS[:2], *_COUNTS), "node")
    own = own.repartition(shuffle_width(own.sparkSession), "key").sortWithinPartitions("key", F.desc("apart"))
    return own.mapInArrow(_met_apart(percent), "a bigint, b bigint").distinct()


def _hung(whole: DataFrame) -> DataFrame:
    """Links that have the components of `whole`: a component is named by a node of its own, so its name stands for the rest of it."""
    return whole.select(F.col("id").alias("a"), F.col("component").alias("b")).filter("a <> b")


def _connected(lines: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The components of all `pairs` that reach the threshold.

    Each line is compared with the smallest of its pairs and with three others first; in a group
    of variants that connects nearly all. Only pairs that are still apart are compared then.
    """
    codes = _codes(lines, nodes, pairs)
    some = [F.min("a"), *[F.min_by("a", F.xxhash64("a", "b", F.lit(k))) for k in range(3)]]
    first = cut_lineage(pairs.groupBy("b").agg(F.array_distinct(F.array(*some)).alias("a")).select(F.explode("a").alias("a"), "b"))
    known = cut_lineage(connected_components(_verified(first, codes, percent)))
    one = known.select(F.col("id").alias("a"), F.col("component").alias("one"))
    two = known.select(F.col("id").alias("b"), F.col("component").alias("two"))
    left = pairs.join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("one", "a") != F.coalesce("two", "b"))
    left = cut_lineage(left.select("a", "b").join(first.select(F.col("a").alias("_a"), F.col("b").alias("_b")),
                                                  (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"))
    more = cut_lineage(_verified(left, codes, percent))
    return known if more.isEmpty() else connected_components(_hung(known).unionByName(more))


def _codes(lines: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, words`` of the ends of `pairs`."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = cut_lineage(ends.join(nodes, "node").select("node", "h1", "h2", "first"))
    # One line of each node: its first place; rows that repeat it have equal words.
    own = ends.select("node", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("first.id").alias("k_id"), F.col("first.line_no").alias("k_no"))
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("id").eqNullSafe(F.col("k_id")) & (F.col("line_no") == F.col("k_no"))
    at = lines.select("h1", "h2", "words", "id", "line_no").join(small_side(own), same)
    return cut_lineage(at.select("node", "words").dropDuplicates(["node"]))


def drop_fuzzy_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with all columns, their texts without the lines that do not stay."""
    gone = fuzzy_lines(docs, id_col=id_col, text_col=text_col, **options).filter("not kept")
    gone = gone.groupBy(F.col("id").alias("_gone_id")).agg(F.collect_set("line_no").alias("_gone"))
    split = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(split, lambda line, k: ~F.array_contains(F.col("_gone"), k.cast("bigint"))), "\n")
    joined = docs.join(gone, docs[id_col].cast("bigint").eqNullSafe(F.col("_gone_id")), "left")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
