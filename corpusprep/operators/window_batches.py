"""Shuffled batches of sliding windows, without shuffling the windows.

A window is many times longer than the token it begins with. So only the starts are ranked, packed
into arrays: from chunks of neighbouring starts to groups of neighbouring hashes, and back as batch
numbers. The tokens go to their chunk, where the windows are cut.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.operators.packing import cut_pieces
from corpusprep.session import shuffles_removed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Starts that one task sorts, about; 2^16 groups at most.
_GROUP = 1 << 20
_MAX_BITS = 16
#: Starts of a chunk: about a 256th of all, within these bounds.
_CHUNK_BITS = (14, 20)
#: Starts of a row from which windows are cut, and of one whose windows are text.
_ROW, _TEXT_ROW = 1024, 256
#: Numbers that are hashed together, about as many as fit the caches.
_LANES = 1 << 14
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_WORDS = [(k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16 for k in range(64)]
_INITIAL = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(prefix: bytes, numbers: np.ndarray, digits: int) -> list[np.ndarray | int]:
    """The 16 words of the padded message prefix + number, for numbers of so many digits; a word that all share is an int."""
    size = len(prefix) + digits
    words: list[np.ndarray | int] = [int.from_bytes((prefix + bytes(digits) + b"\x80").ljust(56, b"\0")[k : k + 4], "little") for k in range(0, 56, 4)]
    rest = numbers.astype(np.uint32 if digits < 10 else np.uint64)
    for at in range(size - 1, len(prefix) - 1, -1):
        above = rest // 10
        digit = (rest - above * 10 + 48).astype(np.uint32)
        words[at // 4] = (digit << np.uint32(8 * (at % 4))) + np.uint32(words[at // 4]) if isinstance(words[at // 4], int) else words[at // 4] + (digit << np.uint32(8 * (at % 4)))
        rest = above
    return [*words, size * 8, 0]


def _md5(words: list[np.ndarray | int], n: int) -> list[np.ndarray]:
    """The four words of the md5 of one block, for `n` messages side by side."""
    a, b, c, d = state = [np.full(n, x, np.uint32) for x in _INITIAL]
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif k < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif k < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.bitwise_not(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        word = words[_WORDS[k]]
        np.add(a, f, a)
        if isinstance(word, int):
            np.add(a, np.uint32((_SINES[k] + word) & 0xFFFFFFFF), a)
        else:
            np.add(a, word, a)
            np.add(a, np.uint32(_SINES[k]), a)
        shift = _SHIFTS[k // 16][k % 4]
        np.left_shift(a, np.uint32(shift), g)
        np.right_shift(a, np.uint32(32 - shift), a)
        np.bitwise_or(a, g, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    return [x + np.uint32(y) for x, y in zip((a, b, c, d), _INITIAL)]


def _hashes(starts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """md5(seed:start) as two 64-bit numbers."""
    prefix = b"%d:" % seed
    high, low = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    bounds = np.array([10**k for k in range(1, 19)])
    for k in range(0, len(starts), _LANES):
        some = starts[k : k + _LANES]
        long = np.searchsorted(bounds, some, "right") + 1  # digits of each
        for digits in np.unique(long).tolist():
            at = slice(k, k + len(some)) if (long == digits).all() else np.flatnonzero(long == digits) + k
            if len(prefix) + digits > 55:
                found = np.frombuffer(b"".join([md5(b"%s%d" % (prefix, s)).digest() for s in starts[at].tolist()]), "<u4").reshape(-1, 4).T
            else:
                found = _md5(_block(prefix, starts[at], digits), len(starts[at]))
            a, b, c, d = [np.ascontiguousarray(x, np.uint32).byteswap().astype(np.uint64) for x in found]
            high[at], low[at] = (a << np.uint64(32)) | b, (c << np.uint64(32)) | d
    return high, low


def _order(starts: np.ndarray, seed: int) -> np.ndarray:
    """The places of ascending starts in the order of their hashes."""
    high, low = _hashes(starts, seed)
    order = np.argsort(high)
    ordered = high[order]
    return np.lexsort((low, high)) if (ordered[1:] == ordered[:-1]).any() else order


def _groups(high: np.ndarray, bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - _MAX_BITS) >> np.uint64(_MAX_BITS - bits)).astype(np.uint16 if bits < _MAX_BITS else np.uint32)


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed, each plane of bytes that they need by itself; the sizes of the planes stand before them."""
    wide = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide].T
    found = [pa.compress(plane.tobytes(), codec="zstd", asbytes=True) for plane in planes]
    return b"".join([bytes([wide]), *[len(p).to_bytes(4, "little") for p in found], *found])


def _unpacked(data: bytes, n: int) -> np.ndarray:
    wide = data[0]
    sizes = np.frombuffer(data, "<u4", wide, 1)
    ends = 1 + 4 * wide + np.cumsum(sizes)
    found = np.zeros(n, np.int64)
    for k, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
        plane = pa.decompress(data[end - size : end], decompressed_size=n, codec="zstd", asbytes=True)
        found |= np.frombuffer(plane, np.uint8).astype(np.int64) << (8 * k)
    return found


_SCHEMA = "part int, chunk bigint, n int, packed binary"
_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])


def _starts(chunk: int, chunk_bits: int, windows: int) -> np.ndarray:
    return np.arange(chunk << chunk_bits, min((chunk + 1) << chunk_bits, windows))


def _counted(windows: int, chunk_bits: int, bits: int, seed: int):
    """How many of a task's starts are in each group of hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                counts += np.bincount(_groups(_hashes(_starts(chunk, chunk_bits, windows), seed)[0], bits), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits)), pa.array(counts)], names=["part", "n"])

    return run


def _dealt(windows: int, chunk_bits: int, bits: int, seed: int):
    """The starts of each chunk, for each group of hashes the gaps between its starts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                group = _groups(_hashes(_starts(chunk, chunk_bits, windows), seed)[0], bits)
                order = np.argsort(group, kind="stable")
                sizes = np.bincount(group, minlength=1 << bits)
                parts = np.flatnonzero(sizes)
                gaps = [_packed(np.diff(p, prepend=0)) for p in np.split(order, np.cumsum(sizes[parts])[:-1])]
                columns = [parts, np.full(len(parts), chunk), sizes[parts], gaps]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def _ranked(bases: np.ndarray, size: int, chunk_bits: int, seed: int):
    """A group of hashes: for each chunk the batches of its starts, above the first batch of the group, as gaps in the order of hashes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks, sizes = table["chunk"].to_pylist(), table["n"].to_pylist()
        starts = np.concatenate([
            (c << chunk_bits) + np.cumsum(_unpacked(data, n)) for c, n, data in zip(chunks, sizes, table["packed"].to_pylist())
        ])
        base = int(bases[table["part"][0].as_py()])
        order = _order(starts, seed)
        batch = (base + np.arange(len(starts))) // size - base // size
        owner = np.repeat(np.arange(len(chunks)), sizes)[order]  # the chunk that has each rank
        batch = batch[np.argsort(owner.astype(np.uint16 if len(chunks) <= 1 << 16 else np.int64), kind="stable")]
        packed = [_packed(np.diff(p, prepend=0)) for p in np.split(batch, np.cumsum(sizes)[:-1])]
        return table.select(["part", "chunk", "n"]).append_column("packed", pa.array(packed, pa.binary())).cast(_ARROW)

    return run


def _lists(values: np.ndarray, begins: np.ndarray, long: int) -> pa.Array:
    """Stretches of an array as rows, which may overlap; all but the last have the same length."""
    parts = [values[k : k + long] for k in begins.tolist()]
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _ids(pieces: pa.Table) -> np.ndarray:
    """The ids of pieces, one after the other."""
    narrow, wide = (pieces[c].combine_chunks() for c in ("bytes", "cut"))
    sizes = np.where(narrow.is_valid(), pc.fill_null(pc.list_value_length(narrow), 0), pc.fill_null(pc.list_value_length(wide), 0))
    near = np.repeat(np.asarray(narrow.is_valid()), sizes)
    ids = np.empty(len(near), np.int32)
    ids[near] = narrow.flatten().to_numpy().astype(np.int32) + 128
    ids[~near] = wide.flatten().to_numpy()
    return ids + np.where(near, np.repeat(pc.fill_null(pieces["low"].combine_chunks(), 0).to_numpy(), sizes), 0).astype(np.int32)


def _placed(bases: np.ndarray, size: int, windows: int, halo: int, chunk_bits: int, seed: int, text: bool):
    """A chunk: its tokens and the batches of its starts, in rows that windows can be cut from.

    As text, a row has its tokens joined by spaces and where each begins, one further than the last.
    """
    body = [("tokens", pa.list_(pa.int32()))]
    if text:
        body = [("text", pa.binary()), ("begins", pa.list_(pa.int32()))]
    schema = pa.schema([("first", pa.int64()), *body, ("batches", pa.list_(pa.int64()))])

    def run(pieces: pa.Table, ranked: pa.Table) -> pa.Table:
        if not len(ranked):
            return schema.empty_table()  # the tokens after the last start
        starts = _starts(ranked["chunk"][0].as_py(), chunk_bits, windows)
        tokens = _ids(pieces.sort_by("start"))
        ranked = ranked.sort_by("part")
        found = zip(ranked["part"].to_pylist(), ranked["n"].to_pylist(), ranked["packed"].to_pylist())
        batch = np.empty(len(starts), np.int64)
        batch[_order(starts, seed)] = np.concatenate([bases[part] // size + np.cumsum(_unpacked(data, n)) for part, n, data in found])
        step = _TEXT_ROW if text else _ROW
        opens = np.arange(0, len(starts), step)
        if text:
            names = {t: b"%d " % t for t in np.unique(tokens).tolist()}
            spelled = [names[t] for t in tokens.tolist()]
            begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))])
            whole, lasts = b"".join(spelled), np.minimum(opens + step + halo, len(tokens))
            rows = [
                pa.array([whole[begins[k] : begins[e] - 1] for k, e in zip(opens.tolist(), lasts.tolist())], pa.binary()),
                pa.array([(begins[k : e + 1] - begins[k]).astype(np.int32) for k, e in zip(opens.tolist(), lasts.tolist())], pa.list_(pa.int32())),
            ]
        else:
            rows = [_lists(tokens, opens, step + halo)]
        return pa.Table.from_arrays([pa.array(starts[opens]), *rows, _lists(batch, opens, step)], names=schema.names).cast(schema)

    return run


def shuffled_windows(
    df: DataFrame, block: int, size: int, seed: int = 0, exact: bool = False, drop_last: bool = True, text: bool = False,
    tokens: int | None = None,
) -> DataFrame:
    """(start, x, y, batch_id): the rows of `make_batches` over `sliding_windows`, shuffled by start.

    A start costs some two bytes of shuffle and a token goes to its chunk once; windows exist only
    in the stage that uses them. The driver sees at most 65,536 counts. With `text` x and y are
    the ids joined by spaces, as bytes, cut from one text for many windows. `tokens` is their number, where
    it is known; else the stream is read once more to find it.
    """
    spark = df.sparkSession
    need = block + 1 if exact else block + 2
    if tokens is None:
        with shuffles_removed(spark):
            tokens = df.agg(F.max(F.col("offset") + F.size("ids"))).first()[0] or 0
    windows = max(0, tokens - need + 1)
    bits = min(_MAX_BITS, max(0, -(-windows // _GROUP) - 1).bit_length())
    chunk_bits = min(_CHUNK_BITS[1], max(_CHUNK_BITS[0], (windows >> 8).bit_length()))
    chunks = -(-windows // (1 << chunk_bits))
    wide = max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism))

    counts = np.zeros(1 << bits, np.int64)
    if bits:
        counted = spark.range(0, chunks, 1, wide).mapInArrow(_counted(windows, chunk_bits, bits, seed), "part bigint, n bigint")
        for row in counted.groupBy("part").agg(F.sum("n").alias("n")).collect():
            counts[row.part] = row.n
    bases = np.cumsum(counts) - counts

    dealt = spark.range(0, chunks, 1, wide).mapInArrow(_dealt(windows, chunk_bits, bits, seed), _SCHEMA)
    ranked = dealt.groupBy("part").applyInArrow(_ranked(bases, size, chunk_bits, seed), _SCHEMA)
    cut = F.col("cut")
    # Pieces whose ids lie near each other go as one byte an id.
    low, reach = F.array_min(cut), F.array_max(cut) - F.array_min(cut)
    pieces = cut_pieces(df, 1 << chunk_bits, need - 1).select(
        F.col("stretch").alias("chunk"), "start", low.alias("low"), "cut", (reach < 256).alias("near")
    ).select(
        "chunk", "start", "low",
        F.when(F.col("near"), F.transform("cut", lambda t: (t - F.col("low") - 128).cast("tinyint"))).alias("bytes"),
        F.when(~F.col("near"), F.col("cut")).alias("cut"),
    )
    body = "text binary, begins array<int>" if text else "tokens array<int>"
    rows = pieces.groupBy("chunk").cogroup(ranked.groupBy("chunk")).applyInArrow(
        _placed(bases, size, windows, need - 1, chunk_bits, seed, text), f"first bigint, {body}, batches array<bigint>"
    )
    placed = rows.select(*[c for c in rows.columns if c != "batches"], F.posexplode("batches").alias("i", "batch_id"))
    if drop_last:
        placed = placed.filter(F.col("batch_id") < windows // size)

    def window(shift: int) -> Column:
        first = F.col("i") + shift
        if not text:
            return F.slice("tokens", first + 1, F.lit(block))
        begin = F.get("begins", first)
        return F.substring(F.col("text"), begin + 1, F.get("begins", first + block) - begin - 1)

    return placed.select((F.col("first") + F.col("i")).alias("start"), window(0).alias("x"), window(1).alias("y"), "batch_id")
