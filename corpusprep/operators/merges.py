"""Learning byte-pair merges with an inverted index from pairs to words.

A merge changes only the words that hold its pair. Spark's own tables are read as a whole, so
the words stay in the tasks of one barrier stage for many rounds: each task has its share of
the words, the index over them, and the counts of all frequent pairs. In a round, all tasks
choose the same merges, change the words their index names, and tell each other by how much
pairs became rarer or more frequent.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage, local_frame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One past the last code point; symbols from here on are merged pairs.
FIRST_MERGE = 0x110000
#: Most frequent pairs whose counts the tasks keep; when they run out, pairs are counted anew.
FRONTIER = 1 << 16
#: Merges of one barrier stage at most, which is what a lost executor has to redo.
STAGE_MERGES = 4096
#: Words that make one more task worth its messages (a round of which takes a second), and most tasks of a stage.
TASK_WORDS = 200_000
MAX_TASKS = 64
#: A pair is one number: left * _SIDE + right.
_SIDE = 1 << 22
#: What stands between words, and the places that are indexed at a time.
_END = -(1 << 31)
_CHUNK = 1 << 20
#: Places from which on a table of all symbols is quicker than sorting.
_MANY = 1 << 14

_SCHEMA = "rank int, left int, right int, n bigint, ids array<int>"


class WordIndex:
    """All words in one chain of places, with the places at which each pair was seen.

    A piece has its symbol at its first place and, if it has several, minus their number at its last
    one; `_END` stands before and behind each word. The pieces before and after follow from that. A
    merge goes to the places of its pair. Those that have changed since are found by looking, so
    nothing is ever taken out of the index. Of the pairs that are there at first only `known` ones are
    indexed, as no others can be merged in this stage. A place costs 12 bytes.
    """

    def __init__(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], known: Iterable[tuple[int, int]], first: int, merges: int) -> None:
        """`parts` are (symbols, symbols of each word, counts); symbols from `first` on are made here, at most `merges`."""
        self.first, self.spans = first, np.ones(merges + 1, np.int32)
        symbols, words, counts, sizes, base = array("i", [_END]), array("i", [0]), [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for flat, lengths, n in parts:
            lengths = lengths.astype(np.int64)
            chain = np.full(len(flat) + len(lengths), _END, np.int32)
            chain[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat
            symbols.frombytes(chain.data.cast("B") if len(chain) else b"")
            words.frombytes(np.repeat(np.arange(base, base + len(lengths), dtype=np.int32), lengths + 1).data.cast("B") if len(chain) else b"")
            counts.append(np.array(n, np.int64))
            sizes.append(lengths)
            base += len(lengths)
        # Views of the buffers, which grew in place.
        self.symbols, self.word = np.frombuffer(symbols, np.int32), np.frombuffer(words, np.int32)
        self.counts = np.concatenate(counts)
        self.ends = np.cumsum(np.concatenate(sizes) + 1)
        self.where: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        self._index(np.unique(np.array([left * _SIDE + right for left, right in known], np.int64)))

    def _index(self, known: np.ndarray) -> None:
        """Note the places of the known pairs, in two passes, so that one array holds them all."""
        if not len(known):
            return

        def found(start: int) -> tuple[np.ndarray, np.ndarray]:
            part = self.symbols[start : start + _CHUNK + 1].astype(np.int64)
            left, right = part[:-1], part[1:]
            at = np.flatnonzero((left >= 0) & (right >= 0))
            codes = left[at] * _SIDE + right[at]
            number = np.searchsorted(known, codes)
            held = known[np.minimum(number, len(known) - 1)] == codes
            return number[held], at[held] + start

        starts = range(0, len(self.symbols), _CHUNK)
        sizes = np.zeros(len(known), np.int64)
        for start in starts:
            sizes += np.bincount(found(start)[0], minlength=len(known))
        ends = np.cumsum(sizes)
        free = ends - sizes
        places = np.empty(int(ends[-1]), np.int32)
        for start in starts:
            number, at = found(start)
            order = np.argsort(number, kind="stable")
            number, at = number[order], at[order]
            more = np.bincount(number, minlength=len(known))
            places[np.repeat(free - (np.cumsum(more) - more), more) + np.arange(len(at))] = at
            free += more
        for pair, end, size in zip(known.tolist(), ends.tolist(), sizes.tolist()):
            if size:
                self.where[pair].append(places[end - size : end])

    def _span(self, symbols: np.ndarray) -> np.ndarray:
        return self.spans[np.maximum(symbols - (self.first - 1), 0)]

    def _before(self, at: np.ndarray) -> np.ndarray:
        """The places of the pieces before; none (-1) at the start of a word."""
        last = self.symbols[at - 1]
        return np.where(last >= 0, at - 1, np.where(last == _END, -1, at + last))

    def _less(self, symbols: np.ndarray, places: np.ndarray, change: defaultdict[int, int], side: int, pair: int) -> None:
        """Take off the words' counts at the places from the pairs of `pair` and the symbol (times `side`) at each."""
        weights = self.counts[self.word[places]]
        if len(symbols) > _MANY:
            total = np.bincount(symbols, weights)  # whole numbers, exact below 2^53
            found = np.flatnonzero(total)
            sums = total[found].astype(np.int64)
        else:
            found, number = np.unique(symbols, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, number, weights)
        for symbol, n in zip(found.tolist(), sums.tolist()):
            change[pair + symbol * side] -= n

    def _more(self, symbols: np.ndarray, places: np.ndarray, change: defaultdict[int, int], side: int, pair: int) -> None:
        """Add the pairs of `pair` and the symbol at each place, which is where the pair begins, to the counts and the index."""
        if not len(symbols):
            return
        order = np.argsort(symbols)
        symbols, places = symbols[order], places[order]
        firsts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        sums = np.add.reduceat(self.counts[self.word[places]], firsts).tolist()
        parts = np.split(places.astype(np.int32), firsts[1:])
        for symbol, n, part in zip(symbols[firsts].tolist(), sums, parts):
            change[pair + symbol * side] += n
            self.where[pair + symbol * side].append(part)

    def merge(self, left: int, right: int, merged: int, change: defaultdict[int, int]) -> None:
        """Join the pair wherever it stands, leftmost first; `change` adds up the pairs' counts."""
        one, two = (int(self._span(np.int64(s))) for s in (left, right))
        self.spans[merged - self.first + 1] = both = one + two
        parts = self.where.pop(left * _SIDE + right, None)
        if parts is None:
            return
        at = (parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))).astype(np.int64)
        at = at[self.symbols[at] == left]
        at = at[self.symbols[at + one] == right]
        if left == right and len(at):
            # In a run of equal symbols, every other place begins a pair.
            at.sort()
            place = np.arange(len(at))
            opens = np.concatenate(([True], at[1:] - at[:-1] != one))
            at = at[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
        if not len(at):
            return
        gone, before, after = at + one, self._before(at), self.symbols[at + both]
        held, first = before >= 0, self.symbols[before]
        self.symbols[gone] = -1
        change[left * _SIDE + right] -= int(self.counts[self.word[at]].sum())
        # What begins at a place that is gone too is counted there.
        alone = held & (self.symbols[before] >= 0)
        self._less(first[alone], at[alone], change, _SIDE, left)
        self._less(after[after >= 0], at[after >= 0], change, 1, right * _SIDE)
        self.symbols[at + both - 1] = -both
        self.symbols[at] = merged
        before, after = self._before(at), self.symbols[at + both]
        first = self.symbols[before]
        alone = (before >= 0) & (first != merged)
        self._more(first[alone], before[alone], change, _SIDE, merged)
        self._more(after[after >= 0], at[after >= 0], change, 1, merged * _SIDE)

    def words(self, size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The symbols that are left, word after word, how many each word has, and the counts, for so many words at a time."""
        for k in range(0, len(self.ends), size):
            ends = self.ends[k : k + size]
            start = int(self.ends[k - 1]) if k else 0
            part = self.symbols[start + 1 : int(ends[-1]) + 1]
            alive = part >= 0
            lengths = np.add.reduceat(alive.astype(np.int64), np.concatenate(([start], ends[:-1])) - start)
            yield part[alive], lengths, self.counts[k : k + size]


class Frontier:
    """Exact counts of all pairs above a floor, best first: by count, then older symbols, then left and right.

    A pair of old symbols can only become rarer, and a pair with a new symbol is told of in the
    round that makes the symbol; so what was below the floor stays there.
    """

    def __init__(self, pairs: Iterable[tuple[int, int, int]], floor: int, lengths: dict[int, int], max_piece: int) -> None:
        self.floor, self.lengths, self.max_piece = floor, dict(lengths), max_piece
        self.counts: dict[int, int] = {}
        self.heap: list[tuple[int, int, int, int]] = []
        for left, right, n in pairs:
            self._put(left * _SIDE + right, n)

    def _put(self, pair: int, n: int) -> None:
        left, right = divmod(pair, _SIDE)
        if n <= self.floor or self.length(left) + self.length(right) > self.max_piece:
            self.counts.pop(pair, None)
            return
        self.counts[pair] = n
        heapq.heappush(self.heap, (-n, max(left, right), left, right))

    def length(self, symbol: int) -> int:
        return self.lengths.get(symbol, 1)

    def take(self, first: int, room: int) -> list[tuple[int, int, int, int]]:
        """(left, right, n, merged) of the leading run of pairs that do not touch.

        Two pairs touch if one can end in the symbol that the other begins with. Equal to merging
        one best pair at a time: merging (a, b) changes the counts of (x, a) and (b, y) alone, and
        the pairs with the new symbol are at most as frequent as those, which touch the run and so
        rank behind it, and lose ties by their age. A pair of equal symbols touches itself and
        ends the run.
        """
        run: list[tuple[int, int, int, int]] = []
        lefts: set[int] = set()
        rights: set[int] = set()
        while self.heap and len(run) < room:
            n, _, left, right = self.heap[0]
            pair = left * _SIDE + right
            if self.counts.get(pair) != -n:
                heapq.heappop(self.heap)  # an older count
                continue
            if left in rights or right in lefts:
                break
            heapq.heappop(self.heap)
            del self.counts[pair]
            merged = first + len(run)
            self.lengths[merged] = self.length(left) + self.length(right)
            run.append((left, right, -n, merged))
            lefts.add(left)
            rights.add(right)
            if left == right:
                break
        return run

    def update(self, change: dict[int, int], first: int) -> None:
        """Apply the changes of a round whose new symbols start at `first`."""
        for pair, more in change.items():
            if pair in self.counts:
                self._put(pair, self.counts[pair] + more)
            elif max(divmod(pair, _SIDE)) >= first:
                self._put(pair, more)


def _summed(context: BarrierTaskContext, change: dict[int, int]) -> dict[int, int]:
    """The changes of all tasks, added up; every task gets the same."""
    told = context.allGather(json.dumps([x for pair, more in change.items() if more for x in (pair, more)]))
    total: defaultdict[int, int] = defaultdict(int)
    for one in told:
        flat = json.loads(one)
        for pair, more in zip(flat[::2], flat[1::2]):
            total[pair] += more
    return total


def _stage(pairs: list[tuple[int, int, int]], floor: int, lengths: dict[int, int], max_piece: int, done: int, wanted: int, total: int):
    """A task of the barrier stage: its words in, and out, in one task the merges and in all, unless these are the
    last of `total`, the words with the merges applied."""
    schema = pa.schema([("rank", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        tasks = len(context.getTaskInfos())
        parts = ((b.column("ids").flatten().to_numpy(), pc.list_value_length(b.column("ids")).to_numpy(), b.column("n").to_numpy()) for b in batches)
        index = WordIndex(parts, [pair[:2] for pair in pairs], FIRST_MERGE + done, wanted)
        frontier, merges = Frontier(pairs, floor, lengths, max_piece), []
        while batch := frontier.take(FIRST_MERGE + done + len(merges), wanted - len(merges)):
            change: defaultdict[int, int] = defaultdict(int)
            for left, right, _, merged in batch:
                index.merge(left, right, merged, change)
            frontier.update(_summed(context, change) if tasks > 1 else change, batch[0][3])
            merges += batch
        if context.partitionId() == 0 and merges:
            columns = [list(range(done, done + len(merges))), *[[m[k] for m in merges] for k in range(3)], [None] * len(merges)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if done + len(merges) == total:
            return
        for symbols, sizes, counts in index.words():
            ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), symbols)
            none = pa.nulls(len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(counts), ids], schema=schema)

    return run


def symbol_lists(counts: DataFrame) -> DataFrame:
    """(ids, n): each word of (word, n) as its code points."""
    return counts.select(F.transform(F.split("word", ""), lambda c: F.ascii(c)).alias("ids"), F.col("n").cast("bigint").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) over the neighbours in (ids, n)."""
    pairs = F.arrays_zip(
        F.slice("ids", F.lit(1), F.size("ids") - 1).alias("left"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("right")
    )
    rows = words.select(F.explode_outer(pairs).alias("p"), "n").filter(F.col("p").isNotNull())
    return rows.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))


def _frontier(words: DataFrame, lengths: dict[int, int], max_piece: int, size: int) -> tuple[list[tuple[int, int, int]], int]:
    """The most frequent pairs that may be merged, and the count that all others have at most."""
    pairs = pair_counts(words)
    if lengths:
        known = F.broadcast(local_frame(words.sparkSession, sorted(lengths.items()), "symbol int, length int"))  # one row a merge
        for side in ("left", "right"):
            pairs = pairs.join(known.withColumnsRenamed({"symbol": side, "length": f"_{side}"}), side, "left")
        pairs = pairs.filter(F.coalesce("_left", F.lit(1)) + F.coalesce("_right", F.lit(1)) <= max_piece)
    best = pairs.orderBy(F.desc("n"), F.greatest("left", "right"), "left", "right").limit(size + 1)
    rows = [(r.left, r.right, r.n) for r in best.select("left", "right", "n").collect()]
    return rows[:size], rows[size][2] if len(rows) > size else 0


def learn(counts: DataFrame, n_merges: int, max_piece: int, frontier: int = FRONTIER) -> list[tuple[str, str, int]]:
    """Up to `n_merges` (left piece, right piece, count) of the words in (word, n), best first.

    The number of tasks follows from the number of words and the cores; all of them must run at
    once, so the stage cannot be used with dynamic allocation. The driver sees the frontier and
    the merges, never the words. Each stage ends in a written table, from which the next goes on.
    """
    if n_merges <= 0 or max_piece < 2:
        return []
    spark = counts.sparkSession
    words = cut_lineage(symbol_lists(counts).filter(F.size("ids") > 1))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, MAX_TASKS, -(-words.count() // TASK_WORDS)))
    lengths: dict[int, int] = {}
    pieces: dict[int, str] = {}
    learned: list[tuple[str, str, int]] = []
    while len(learned) < n_merges:
        pairs, floor = _frontier(words, lengths, max_piece, frontier)
        if not pairs:
            break
        while pairs[0][2] <= floor:  # more pairs with one count than the frontier holds
            frontier *= 2
            pairs, floor = _frontier(words, lengths, max_piece, frontier)
        wanted = min(STAGE_MERGES, n_merges - len(learned))
        task = _stage(pairs, floor, lengths, max_piece, len(learned), wanted, n_merges)
        # By hash, as dealing the words in turn would sort them first.
        out = cut_lineage(words.repartition(tasks, "ids").mapInArrow(task, _SCHEMA, barrier=True))
        for row in out.filter("rank is not null").orderBy("rank").collect():
            left, right = (pieces.get(s) or chr(s) for s in (row.left, row.right))
            merged = FIRST_MERGE + len(learned)
            pieces[merged], lengths[merged] = left + right, len(left) + len(right)
            learned.append((left, right, row.n))
        words = out.filter("rank is null and size(ids) > 1").select("ids", "n")
    return learned
