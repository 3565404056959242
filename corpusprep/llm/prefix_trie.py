"""The trie of conversation prefixes, with subtree sums by the Euler-tour technique."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusprep.llm.common import small_side
from corpusprep.operators.ordered import previous_value, running, slice_rows
from corpusprep.session import cut_lineage, join_groups, shuffle_width

#: Arcs of the tour that one slice should hold at most.
SLICE = 1 << 20
#: A list of so many chains is finished in one slice.
LAST = 1 << 14
_NONE = -1
_NODE = ["depth", "k1", "k2"]
_ARC = ["c", "d", "s"]
_WEIGHTS = ["rank", "leaves", "saved"]


def _two(digest: Column) -> list[Column]:
    """The first 120 bits of a hexadecimal digest, as two numbers."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, which tells every pair of them apart; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def place_turns(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, pos, d1, d2, size``: the place of each turn from 1, its digest and its code points.

    Turns stand in the order of `turn_col`, null first; those of one number in the order of their
    digests. Rows without conversation are left out. A conversation of any length spans slices.
    """
    digest = turn_digest(F.col(role_col), F.col(text_col))
    narrow = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        *[c.alias(n) for n, c in zip(("d1", "d2"), _two(digest))],
        F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("size"),
    )
    order = ["turn", "d1", "d2"]
    sliced = slice_rows(narrow, ["conv_id"], order)
    return running(sliced, ["conv_id"], order, {"pos": F.lit(1)}).select("conv_id", "pos", "d1", "d2", "size")


def prefix_keys(turns: DataFrame, order: Sequence[str]) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, size``: a key of every prefix, and of the prefix one turn shorter.

    A key is the exclusive or of the hashes of (depth, turn), so it can be carried on from one
    slice of a conversation to the next, and undone by the last turn.
    """
    sliced = slice_rows(turns, ["conv_id"], order)
    deep = running(sliced, ["conv_id"], order, {"depth": F.lit(1)})
    own = F.sha2(F.concat_ws(":", "depth", "d1", "d2"), 256)
    deep = cut_lineage(deep.select("conv_id", "slice", "depth", "size", *[c.alias(n) for n, c in zip(("x1", "x2"), _two(own))]))
    inside = W.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    totals = deep.groupBy("conv_id", "slice").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carried = totals.select("conv_id", "slice", F.bit_xor("x1").over(earlier).alias("c1"), F.bit_xor("x2").over(earlier).alias("c2"))
    # A border between slices cuts one conversation, so there are fewer rows than slices.
    carried = F.broadcast(carried.filter("c1 is not null"))
    keyed = deep.withColumns({f"l{k}": F.bit_xor(f"x{k}").over(inside) for k in "12"}).join(carried, ["conv_id", "slice"], "left")
    keys = {f"k{k}": F.col(f"l{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in "12"}
    return keyed.withColumns(keys).select(
        "conv_id", *_NODE, *[F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in "12"], "size"
    )


def _hash_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined parts of each key, read as a stream in their order."""
    schema = pa.schema([(n, pa.int64()) for n in _NODE] + [("ends_sha256", pa.string())])
    now, digest = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in batches:
        done = []
        for *key, ids in zip(*[batch.column(n).to_pylist() for n in [*_NODE, "ids"]]):
            if key != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield batch_of(done)
    if now is not None:
        yield batch_of([(*now, digest.hexdigest())])


def hash_ends(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of (conv_id, node) rows: the ids ascending, joined by commas.

    The ids of a slice become one string before they meet by node.
    """
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    parts = slice_rows(ends, _NODE, ["conv_id"]).groupBy(*_NODE, "slice").agg(F.array_join(ids, ",").alias("ids"))
    dealt = parts.repartition(shuffle_width(ends.sparkSession), *_NODE).sortWithinPartitions(*_NODE, "slice")
    return dealt.mapInArrow(_hash_lists, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


# --- the tour ------------------------------------------------------------------


def tour_arcs(nodes: DataFrame) -> DataFrame:
    """Two arcs of each node, enter (s = 0) and exit (s = 1), each with the arc before it and its weights.

    A node is named by its smallest conversation and its depth. Enter follows the exit of the
    sibling before, else the parent's enter; exit follows the last child's exit, else the node's
    own enter. Of the weights, the rank counts arcs, the others stand at enter alone.
    """
    own, up = F.col("conv_id"), F.col("depth") - 1
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def arc(side: Column, before: Column, leaves: Column, saved: Column) -> Column:
        named = [own.alias("c"), F.col("depth").alias("d"), side.alias("s"), before.alias("p")]
        return F.struct(*named, one.alias("rank"), leaves.alias("leaves"), saved.alias("saved"))

    def place(c: Column, d: Column, s: Column) -> Column:
        return F.struct(c.alias("c"), d.cast("bigint").alias("d"), s.alias("s"))

    root = place(F.lit(0).cast("bigint"), F.lit(_NONE), F.lit(_NONE).cast("bigint"))
    enter = (
        F.when(F.col("depth") == 0, root)
        .when(F.col("prev_conv").isNotNull(), place(F.col("prev_conv"), F.col("depth"), one))
        .otherwise(place(F.col("parent_conv_id"), up, zero))
    )
    leave = F.when(F.col("n_children") > 0, place(F.col("last_conv"), F.col("depth") + 1, one)).otherwise(place(own, F.col("depth"), zero))
    leaf = (F.col("n_children") == 0).cast("bigint")
    saved = (F.col("n_convs") - 1) * F.col("size")
    both = F.inline(F.array(arc(zero, enter, leaf, saved), arc(one, leave, zero, zero)))
    arcs = nodes.select(both)
    return arcs.select(*_ARC, *[F.col(f"p.{n}").alias(f"p{n}") for n in _ARC], *_WEIGHTS)


def rank_chains(before: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums before each item along its chain, and the first and last item of the chain.

    `before` has the place of the item before each one, or -1 where it is elsewhere. Pointers
    double, so a chain of n items takes log n steps.
    """
    n = len(before)
    total, head, link = weights.copy(), np.arange(n), before.copy()
    while len(live := np.flatnonzero(link >= 0)):
        to = link[live]
        total[live], head[live], link[live] = total[live] + total[to], head[to], link[to]
    tail, link = np.arange(n), np.full(n, -1)
    held = np.flatnonzero(before >= 0)
    link[before[held]] = held
    while len(live := np.flatnonzero(link >= 0)):
        to = link[live]
        tail[live], link[live] = tail[to], link[to]
    return total - weights, head, tail


def _local_places(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted (c, d, s) among the names, or -1."""
    _, code = np.unique(np.concatenate((names[0], wanted[0])), return_inverse=True)
    depth = np.concatenate((names[1], wanted[1])) + 1
    code = (code * (depth.max(initial=0) + 1) + depth) * 2 + np.maximum(np.concatenate((names[2], wanted[2])), 0)
    own, want = code[: names.shape[1]], code[names.shape[1] :]
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], want), max(0, len(own) - 1))
    place = order[at] if len(own) else at
    return np.where((wanted[1] >= 0) & (own[place] == want), place, -1) if len(own) else at


_CHAINED = [*_ARC, *[f"t{n}" for n in _ARC], *[f"e_{n}" for n in _WEIGHTS], *[f"p{n}" for n in _ARC], *_WEIGHTS]
_CHAINED_SCHEMA = ", ".join(f"{n} bigint" for n in _CHAINED)


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item with the last item of its chain and the sums before it in the chain.

    A chain's last item also has what comes before the chain and the sums over all of it; in
    other rows these are null.
    """
    names = [*_ARC, *[f"p{n}" for n in _ARC], *_WEIGHTS]
    parts = [np.array([b.column(n).to_numpy() for n in names]) for b in batches]
    if not parts:
        return
    rows = np.concatenate(parts, axis=1)
    own, before, weights = rows[:3], rows[3:6], rows[6:].T
    ahead, head, tail = rank_chains(_local_places(own, before), weights)
    last = tail == np.arange(len(tail))
    out = [*own, *own[:, tail], *ahead.T]
    ends = [*before[:, head], *(ahead + weights).T]
    for k in range(0, len(tail), 1 << 16):
        cut = slice(k, k + (1 << 16))
        arrays = [pa.array(x[cut]) for x in out] + [pa.array(x[cut], mask=~last[cut]) for x in ends]
        yield pa.RecordBatch.from_arrays(arrays, names=_CHAINED)


def rank_list(arcs: DataFrame, *, slice_rows: int = SLICE, last: int = LAST) -> DataFrame:
    """``c, d, s, rank, leaves, saved``: sums of the weights over all arcs before each one, along the whole list.

    1. Slices of neighbouring names are contracted: what follows one another in a slice becomes
       one chain with the sum of its weights. Siblings and the turns of a conversation lie
       together, so few chains are left.
    2. Chains are contracted again in wider slices, until one is left. Where a round leaves more
       than three quarters, the next one moves half of the chains to their predecessors by the
       toss of a hash, which joins a quarter of any list.
    3. From the last round back, the sum before a chain is added to its items.

    The list has one first item, whose predecessor has depth -1.
    """
    spark = arcs.sparkSession
    arcs = cut_lineage(arcs)
    count, toss, levels = arcs.count(), 0, []
    if not count:
        return arcs.select(*_ARC, *_WEIGHTS)
    width = max(shuffle_width(spark), -(-count // slice_rows))
    dealt = arcs.repartitionByRange(width, "c", "d")
    while True:
        levels.append(cut_lineage(dealt.mapInArrow(_contract, _CHAINED_SCHEMA)))
        chains = levels[-1].filter("rank is not null").select(*_ARC, *[f"p{n}" for n in _ARC], *_WEIGHTS)
        left, before = chains.count(), count
        if left == 1:
            break
        count = left
        if count <= last:
            dealt = chains.repartition(1)
        elif 4 * count <= 3 * before:
            dealt = chains.repartitionByRange(max(1, -(-count // slice_rows)), "c", "d")
        else:
            toss += 1

            def heads(*name: str) -> Column:
                return F.pmod(F.xxhash64(*name, F.lit(toss)), F.lit(2)) == 1

            moves = heads(*_ARC) & ~heads(*[f"p{n}" for n in _ARC]) & (F.col("pd") >= 0)
            home = [F.when(moves, F.col(f"p{n}")).otherwise(F.col(n)) for n in _ARC]
            dealt = chains.repartition(max(shuffle_width(spark), -(-count // slice_rows)), *home)
    sums = [F.col(f"e_{n}").alias(n) for n in _WEIGHTS]
    base = levels.pop().select(*_ARC, *sums)
    while levels:
        level = levels.pop()
        on = base.select(*[F.col(n).alias(f"t{n}") for n in _ARC], *[F.col(n).alias(f"b_{n}") for n in _WEIGHTS])
        joined = level.join(small_side(cut_lineage(on)), [f"t{n}" for n in _ARC])
        base = joined.select(*_ARC, *[(F.col(f"e_{n}") + F.col(f"b_{n}")).alias(n) for n in _WEIGHTS])
    return base


def prefix_trie(turns: DataFrame, members: DataFrame, order: Sequence[str] = ("pos",), **options) -> DataFrame:
    """One row per distinct prefix of the conversations.

    `turns` has ``conv_id, d1, d2, size`` (as `place_turns` makes them) and the columns of the
    order within a conversation; `members` has the ``conv_id`` of all conversations, also of those
    without a turn. `options` are those of `rank_list`. The result has

    - ``conv_id`` (smallest member) and ``depth``, which together name the node; ``parent_conv_id``
    - ``n_convs`` and ``n_children``, the members and the prefixes one turn longer
    - ``enter`` and ``exit``, the places of the node's arcs in the Euler tour
    - ``n_leaves``, ``saved_tokens``: nodes without child, and (n_convs - 1) * size, over the subtree
    - ``ends_sha256`` of the ids of the conversations that end here, ascending, joined by commas

    The tour visits children in the order of their names. Its arcs are ranked as a linked list
    (`rank_list`), which gives the prefix sums of the weights at each arc; a subtree's sum is the
    difference between exit and enter. So the depth of the trie costs no rounds.

    A node's children are cut into slices, so a prefix with a great many of them, like the root,
    is spread. No conversation gives no row. Turns of one place are ordered by the caller. A row
    without conversation must be left out before; null roles and texts count as empty in
    `turn_digest`. Repeated rows are turns of their own. Prefixes are told apart by 120 bits.
    """
    members = cut_lineage(members.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct())
    prefixes = cut_lineage(prefix_keys(turns, order))
    zero = F.lit(0).cast("bigint")
    found = prefixes.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(n).alias(n) for n in ("size", "p1", "p2")]
    )
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[zero.alias(n) for n in _NODE], "conv_id", "n_convs", *[zero.alias(n) for n in ("size", "p1", "p2")])
    nodes = cut_lineage(found.unionByName(root))

    parent = ["depth", "p1", "p2"]
    kids = slice_rows(nodes.filter("depth > 0"), parent, ["conv_id"])
    placed = previous_value(kids, parent, ["conv_id"], "conv_id", "prev_conv")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    there = join_groups(kids.select(*parent, "slice").distinct(), above, [], parent)
    placed = join_groups(placed, there, [], [*parent, "slice"]).drop("slice")
    none = F.lit(None).cast("bigint")
    placed = placed.unionByName(nodes.filter("depth = 0").withColumns({"prev_conv": none, "parent_conv_id": none}))
    below = kids.groupBy(*parent).agg(F.count("*").alias("n_children"), F.max("conv_id").alias("last_conv"))
    below = below.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "last_conv")
    linked = placed.join(below, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    linked = cut_lineage(linked.drop("p1", "p2"))

    ranked = rank_list(tour_arcs(linked), **options)
    sides = {"enter": ("rank", 0), "exit": ("rank", 1), "l0": ("leaves", 0), "l1": ("leaves", 1), "s0": ("saved", 0), "s1": ("saved", 1)}
    values = [F.max(F.when(F.col("s") == side, F.col(name))).alias(out) for out, (name, side) in sides.items()]
    sums = ranked.groupBy(F.col("c").alias("conv_id"), F.col("d").alias("depth")).agg(*values)

    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("at"))
    ends = members.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"at.{n}", zero).alias(n) for n in _NODE])
    return (
        linked.join(hash_ends(ends), _NODE, "left")
        .join(sums, ["conv_id", "depth"])
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "enter", "exit",
            (F.col("l1") - F.col("l0")).alias("n_leaves"),
            (F.col("s1") - F.col("s0")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
