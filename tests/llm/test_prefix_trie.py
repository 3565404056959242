"""The prefix trie against a trie of Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusprep.llm import prefix_trie as T
from corpusprep.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, slice int, k1 string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:30]


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def plain(convs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node, by recursion-free walks."""
    if not convs:
        return []
    members, ends = {(): sorted(convs)}, {}
    for c in sorted(convs):
        path = tuple(convs[c])
        ends.setdefault(path, []).append(c)
        for d in range(1, len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        leaves[path] = leaves.get(path, 0) or 1
        saved[path] = saved.get(path, 0) + own
        if path:
            up = path[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


def values(found):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in found
    )


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(-130, -95), 205, 250, 10**12]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["yes", "no", "über", ""])))
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(700)]  # one conversation with a great many turns
    rows += [(c, t, "user", "hello") for c in range(400, 460) for t in range(3)]  # copies
    rows += [(c, 0, "user", f"opening {c}") for c in range(500, 700)]  # many children of the root
    rows += [(5, None, None, None), (5, None, "user", None), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "system", "tie"), (None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


def test_rebuilt_conversations_against_brute_force(spark):
    rows = made(1)
    turns, members = queries.shared_openings(frame(spark, rows).repartition(5))
    assert values(T.prefix_trie(turns, members, ["part", "pos"]).collect()) == plain(rebuilt(ordered(rows)))


@pytest.mark.parametrize("options", [{}, {"slice_rows": 40, "last": 2}])
def test_plain_conversations_and_the_tour(spark, options):
    rows = made(2)
    df = frame(spark, rows)
    found = T.prefix_trie(T.place_turns(df), df.filter("conv_id is not null"), **options).collect()
    assert values(found) == plain(ordered(rows))
    assert sorted(x for r in found for x in (r.enter, r.exit)) == list(range(2 * len(found)))
    # The nodes between enter and exit are those of the subtree, whose members are a part of the node's.
    nodes = {r.enter: r for r in found}
    for r in found:
        inside = [nodes[k] for k in range(r.enter, r.exit + 1) if k in nodes]
        assert all(k.exit <= r.exit and k.depth >= r.depth and k.conv_id >= r.conv_id for k in inside)
        assert r.n_leaves == sum(k.n_children == 0 for k in inside)


def test_conversations_without_turns_and_empty_tables(spark):
    df = frame(spark, [(1, 0, "user", "a")])
    ids = spark.createDataFrame([(1,), (2,), (3,)], "conv_id bigint")
    assert values(T.prefix_trie(T.place_turns(df), ids).collect()) == plain({1: [("user", "a")], 2: [], 3: []})
    none = T.place_turns(df.filter("false"))
    assert values(T.prefix_trie(none, ids).collect()) == plain({1: [], 2: [], 3: []})
    assert T.prefix_trie(none, ids.filter("false")).collect() == []


def test_rank_a_shuffled_list(spark):
    """Names that say nothing about the order: rounds by range do not help, the tosses must."""
    n = 3000
    names = np.random.default_rng(1).permutation(n)
    rows, before = [], (0, -1, -1)
    for k in range(n):
        here = (int(names[k]), 1, int(k % 2))
        rows.append((*here, *before, 1, k % 3, k))
        before = here
    df = spark.createDataFrame(rows, "c bigint, d bigint, s bigint, pc bigint, pd bigint, ps bigint, rank bigint, leaves bigint, saved bigint")
    got = {(r.c, r.s): (r.rank, r.leaves, r.saved) for r in T.rank_list(df, slice_rows=100, last=50).collect()}
    sums = (0, 0, 0)
    for c, _, s, *_, rank, leaves, saved in rows:
        assert got[c, s] == sums
        sums = (sums[0] + rank, sums[1] + leaves, sums[2] + saved)
    assert len(got) == n


def test_rank_chains():
    sums, head, tail = T.rank_chains(np.array([-1, 0, 1, -1, 3]), np.array([[1], [2], [3], [4], [5]]))
    assert sums.ravel().tolist() == [0, 1, 3, 0, 4]
    assert head.tolist() == [0, 0, 0, 3, 3] and tail.tolist() == [2, 2, 2, 4, 4]


def test_ends_of_several_slices(spark):
    """The ids of one node come from many slices, in the order of the numbers."""
    rows = [(c, 0, 1, 2) for c in range(-50, 3000)] + [(9, 3, 4, 5)]
    df = spark.createDataFrame(rows, "conv_id bigint, depth bigint, k1 bigint, k2 bigint").repartition(7)
    got = {r.depth: r.ends_sha256 for r in T.hash_ends(df).collect()}
    want = hashlib.sha256(",".join(map(str, range(-50, 3000))).encode()).hexdigest()
    assert got == {0: want, 3: hashlib.sha256(b"9").hexdigest()}
