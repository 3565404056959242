"""Near duplicates by SimHash, searched with a distributed vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.components import connected_components
from corpusprep.llm.hashing import ascii_words
from corpusprep.operators.ordered import group_values, slice_rows
from corpusprep.session import cut_lineage, join_groups, local_frame, shuffle_width

SEED = 42
#: Fingerprints that the tree is fitted on at most; never more than one in `_SAMPLE_PART` of them.
SAMPLE = 32_768
_SAMPLE_PART = 8
#: What moving a fingerprint to one more shard costs, in comparisons of two; a node is split while that saves work.
MOVE = 10_000
#: Fingerprints of one side of a cell; a larger shard is compared in pairs of such groups.
CELL = 1 << 15
#: A split that saves less than this share of a node's work is not worth its place in the tree.
_LEAST_GAIN = 0.07
#: A node with fewer sampled fingerprints is not split.
_LEAST_SAMPLE = 128
_CANDIDATES = 4
_BLOCK = 512
_SLICE = 1 << 15


_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    counts = np.zeros((8, 8), np.int64)
    if len(hashes):
        blocks = np.arange(0, len(hashes), 255)  # a byte counts that many
        for k in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, blocks)
            counts[:, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.ravel()


def simhash(words: list[bytes], width: int) -> int:
    """64-bit SimHash of the runs of `width` words, repeats included; 0 for no word."""
    if not words:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, ends = (ends - sizes)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _SLICE):
        runs = [digest(text[a:b], SEED) for a, b in zip(starts[k : k + _SLICE], ends[k : k + _SLICE])]
        ones += bit_counts(np.array(runs, np.uint64))
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(ascii_words(t.as_py()), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], schema=schema)

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``id, fp`` of every row; the bits of the fingerprint are those of the bigint."""
    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return named.mapInArrow(_fingerprints(width), "id bigint, fp bigint")


class Tree(NamedTuple):
    """Nodes as arrays; node 0 is the root. A leaf has a shard, other nodes have -1 there.

    A fingerprint goes inside if its distance to the vantage point is at most `reach`, and
    outside if it is above `beyond`. The two overlap by the linking distance on one side of the
    node's radius: by the triangle inequality the two ends of a link that the radius parts have
    both come to that side, so every linked pair meets in a shard.
    """

    vantage: np.ndarray
    reach: np.ndarray
    beyond: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    shard: np.ndarray


def _cost(rows):
    return rows * MOVE + rows * rows / 2


def _split(points: np.ndarray, scale: float, distance: int, rng: np.random.Generator) -> tuple | None:
    """The vantage point and overlapping ranges that leave least to do, if that is less than without a split."""
    n = len(points)
    least, best = (1 - _LEAST_GAIN) * _cost(n * scale), None
    radius = np.arange(64)
    # Either those just outside also go in, or those just inside also go out.
    reach = np.concatenate((radius + distance, radius))
    beyond = np.concatenate((radius, radius - distance))
    for vantage in rng.choice(points, min(_CANDIDATES, n), replace=False):
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65))
        low = within[np.minimum(reach, 64)]
        high = n - np.where(beyond >= 0, within[np.maximum(beyond, 0)], 0)
        work = np.where((low < n) & (high < n), _cost(low * scale) + _cost(high * scale), np.inf)
        at = int(work.argmin())
        if work[at] < least:
            least, best = work[at], (vantage, int(reach[at]), int(beyond[at]))
    return best


def build_tree(sample: np.ndarray, total: int, distance: int = 3, seed: int = 11) -> Tree:
    """A tree for `total` fingerprints like those of the sample."""
    rng = np.random.default_rng(seed)
    scale = total / max(1, len(sample))
    nodes: list[list] = [[0, 0, 0, -1, -1, -1]]
    todo, shards = [(0, sample)], 0
    while todo:
        at, points = todo.pop()
        split = _split(points, scale, distance, rng) if len(points) >= _LEAST_SAMPLE else None
        if split is None:
            nodes[at][5] = shards
            shards += 1
            continue
        vantage, reach, beyond = split
        far = np.bitwise_count(points ^ vantage)
        nodes[at][:5] = [int(vantage), reach, beyond, len(nodes), len(nodes) + 1]
        todo += [(len(nodes), points[far <= reach]), (len(nodes) + 1, points[far > beyond])]
        nodes += [[0, 0, 0, -1, -1, -1], [0, 0, 0, -1, -1, -1]]
    columns = list(zip(*nodes))
    return Tree(np.array(columns[0], np.uint64), *[np.array(c, np.int64) for c in columns[1:]])


def route(tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the shards they go to, pruned branch by branch."""
    rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
    found = []
    while len(rows):
        leaf = tree.shard[nodes] >= 0
        found.append((rows[leaf], tree.shard[nodes[leaf]]))
        rows, nodes = rows[~leaf], nodes[~leaf]
        far = np.bitwise_count(points[rows] ^ tree.vantage[nodes])
        near, out = far <= tree.reach[nodes], far > tree.beyond[nodes]
        rows, nodes = (
            np.concatenate((rows[near], rows[out])),
            np.concatenate((tree.inside[nodes[near]], tree.outside[nodes[out]])),
        )
    return np.concatenate([f[0] for f in found] or [rows]), np.concatenate([f[1] for f in found] or [rows])


def _route(tree: Tree):
    schema = pa.schema([("fp", pa.int64()), ("shard", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            rows, shards = route(tree, points)
            yield pa.RecordBatch.from_arrays([pa.array(points[rows].view(np.int64)), pa.array(shards)], schema=schema)

    return run


def join_cell(one: np.ndarray, two: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Linked pairs that connect all that links connect, among `one` or between `one` and `two`.

    The rows stand in shells around a vantage point of the cell; by the triangle inequality a row
    is compared with those in shells within the distance only. A pair that is connected already
    is passed over, so a dense cell gives at most one pair for each of its rows.
    """
    points = one if two is None else np.concatenate((one, two))
    label = np.arange(len(points))
    far = np.bitwise_count(points ^ points[0]).astype(np.int64)
    place = np.arange(len(points))
    left = place if two is None else place[len(one) :]
    right = place if two is None else place[: len(one)]
    right = right[np.argsort(far[right], kind="stable")]
    shells = far[right]
    found = []
    for shell in np.unique(far[left]):
        rows = left[far[left] == shell]
        low = shell if two is None else shell - distance
        others = right[np.searchsorted(shells, low) : np.searchsorted(shells, shell + distance, "right")]
        for k in range(0, len(rows), _BLOCK):
            block = rows[k : k + _BLOCK]
            near = np.bitwise_count(points[block][:, None] ^ points[others]) <= distance
            a, b = np.nonzero(near)
            a, b = block[a], others[b]
            fresh = label[a] != label[b]
            a, b = a[fresh], b[fresh]
            for row in np.unique(a):
                mates = b[a == row]
                labels, first = np.unique(label[mates], return_index=True)
                new = labels != label[row]
                if new.any():
                    found += [(int(row), int(m)) for m in mates[first[new]]]
                    label[np.isin(label, labels[new])] = label[row]
    return [(int(points[a].view(np.int64)), int(points[b].view(np.int64))) for a, b in found]


def _join(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(parts: list[np.ndarray]) -> pa.RecordBatch:
        _, i, j, groups, points = np.concatenate(parts, axis=1)
        points, side = points.view(np.uint64), groups == i[0]
        found = []
        if i[0] == j[0]:
            found = join_cell(points, None, distance)
        elif side.any() and not side.all():
            found = join_cell(points[side], points[~side], distance)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []  # the rows of one cell, as columns
        for batch in batches:
            rows = np.array([batch.column(n).to_numpy() for n in ("shard", "i", "j", "g", "fp")])
            ends = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            for part in np.split(rows, ends, axis=1):
                if parts and part.size and (parts[-1][:3, -1] != part[:3, 0]).any():
                    yield links(parts)
                    parts = []
                if part.size:
                    parts.append(part)
        if parts:
            yield links(parts)

    return run


def link_fingerprints(points: DataFrame, distance: int = 3, *, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """Pairs ``a, b`` of distinct ``fp`` within `distance` bits, enough of them to connect all that links connect.

    1. A tree of vantage points is fitted on `sample` fingerprints at most; it says only where
       fingerprints go, so a poor sample costs time and no link.
    2. Each fingerprint descends it. Next to a node's radius it takes both branches, so it comes
       to every shard that a boundary within the distance overlaps.
    3. Shards are compared exactly. One that is larger than `cell` is cut into groups, and each
       pair of groups is a cell of its own.
    """
    spark = points.sparkSession
    points = cut_lineage(points.select("fp"))
    picked = points.filter(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLE_PART)) == 0)
    taken = picked.orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(sample).toArrow().column("fp").to_numpy()
    tree = build_tree(taken.astype(np.int64).view(np.uint64), points.count(), distance)
    routed = cut_lineage(points.mapInArrow(_route(tree), "fp bigint, shard bigint"))
    large = routed.groupBy("shard").agg(F.expr(f"cast((count(*) + {cell - 1}) div {cell} as int)").alias("c")).filter("c > 1")
    parts = local_frame(spark, [tuple(r) for r in large.collect()], "shard bigint, c int")  # no more rows than leaves
    grouped = routed.join(F.broadcast(parts), "shard", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    grouped = grouped.withColumn("g", F.pmod(F.xxhash64("fp", F.lit(2)), F.col("c")).cast("int"))
    placed = grouped.select(
        "shard", "g", "fp", F.explode(F.expr("transform(sequence(0, c - 1), k -> struct(least(g, k) as i, greatest(g, k) as j))")).alias("at")
    ).select("shard", *[F.col(n).cast("bigint").alias(n.split(".")[-1]) for n in ("at.i", "at.j", "g")], "fp")
    dealt = placed.repartition(shuffle_width(spark), "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return dealt.mapInArrow(_join(distance), "a bigint, b bigint")


def simhash_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 3, **options
) -> DataFrame:
    """Groups of like texts: ``id, fingerprint, component_id`` with a row per input row.

    Words are those of the text with A-Z lower-cased. A bit of the fingerprint is set if more than
    half of the hashes of the text's runs of `width` words have it, repeats included. Texts link
    whose fingerprints differ in `distance` bits at most; a group is named by its smallest id.
    `options` are those of `link_fingerprints`.

    Equal fingerprints are one point, so a large group of copies is compared once. Groups are
    joined back slice by slice, so neither one fingerprint nor one group comes to one task.

    A shorter text is one run; one without words (null, empty) has fingerprint 0, which links
    like any other. A row without id has a fingerprint, links with nothing and has no component.
    Rows that repeat an id are rows of their own: each is in the group of its own text. Texts of
    any length are read whole. No row gives no row. Other columns are not read.
    """
    base = cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    base = slice_rows(base, ["fp"], ["id"])
    points = cut_lineage(base.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    links = connected_components(link_fingerprints(points, distance, **options))
    linked = points.join(links.withColumnsRenamed({"id": "fp"}), "fp")
    named = group_values(slice_rows(linked, ["component"], ["fp"]), ["component"], [F.min("rep").alias("least")])
    each = points.join(named.select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    there = join_groups(base.select("fp", "slice").distinct(), each, [], ["fp"], "left")
    return join_groups(base, there, [], ["fp", "slice"]).select(
        "id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
