"""SimHash groups against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from corpusprep.llm import queries, vantage
from corpusprep.session import cut_lineage
from tests.llm.helpers import AWKWARD, edited, table, words


def plain_simhash(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    runs = [" ".join(found[k : k + width]) for k in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(points, distance):
    """Component number of each point, by comparing all of them."""
    points = np.array(points, np.uint64)
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= distance):
            a, b = label[i], label[int(j)]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def plain(rows, width, distance=3):
    prints = [plain_simhash(t, width) for _, t in rows]
    with_id = [k for k, (i, _) in enumerate(rows) if i is not None]
    label = plain_groups([prints[k] for k in with_id], distance)
    least = {}
    for k, one in zip(with_id, label):
        least[one] = min(least.get(one, rows[k][0]), rows[k][0])
    group = {k: least[one] for k, one in zip(with_id, label)}
    return sorted(((i is not None, i or 0), f"{prints[k]:016x}", group.get(k) or 0) for k, (i, _) in enumerate(rows))


def ours(df, **options):
    found = vantage.simhash_duplicates(df, **options).collect()
    return sorted(((r.id is not None, r.id or 0), r.fingerprint, r.component_id or 0) for r in found)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in AWKWARD]
    for k in range(40):
        base = words(rng, rng.choice([1, 2, 5, 40, 300]))
        rows.append((k, " ".join(base)))
        rows += [(k + 100 * c, "\t".join(edited(rng, base, min(len(base), c % 3)))) for c in range(1, 6)]
    rows += [(5000 + k, "the same words in every copy of this text") for k in range(60)]
    rows += [(39, "another text under an id that is taken"), (6000, " ".join(words(rng, 40_000)))]
    df = table(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    assert ours(df, width=3) == plain(rows, 3)
    assert ours(df, width=5, cell=16, sample=8) == plain(rows, 5)


def test_bit_counts():
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert vantage.bit_counts(hashes).tolist() == [int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def chains(rng, n):
    """Random fingerprints, chains of small steps through the space, and a dense ball."""
    points = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    steps = [points[: n // 4]]
    for _ in range(4):
        flips = np.uint64(1) << rng.integers(0, 64, (len(steps[0]), 3), dtype=np.uint64)
        steps.append(steps[-1] ^ np.bitwise_xor.reduce(flips, axis=1))
    ball = points[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 10, (n // 4, 4), dtype=np.uint64), axis=1)
    return np.unique(np.concatenate([points, *steps, ball]))


def test_every_link_meets_in_a_shard():
    points = chains(np.random.default_rng(2), 3000)
    # A tree as for many more fingerprints, so that it is deep.
    tree = vantage.build_tree(points[::3], 2_000_000)
    rows, shards = vantage.route(tree, points)
    assert tree.shard.max() > 20
    members = {}
    for row, shard in zip(rows.tolist(), shards.tolist()):
        members.setdefault(row, set()).add(shard)
    assert len(members) == len(points)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 3):
            assert members[i] & members[int(j)]


@pytest.mark.parametrize("cell", [50, 4096])
def test_links_connect_the_same(spark, monkeypatch, cell):
    # Cheap moves make a deep tree of few points.
    monkeypatch.setattr(vantage, "MOVE", 1)
    points = chains(np.random.default_rng(3), 1500)
    df = cut_lineage(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint").repartition(4))
    links = vantage.link_fingerprints(df, 3, cell=cell).collect()
    place = {int(p): k for k, p in enumerate(points.view(np.int64))}
    label = list(range(len(points)))
    for a, b in links:
        assert int(np.bitwise_count(points[place[a]] ^ points[place[b]])) <= 3
        one, two = label[place[a]], label[place[b]]
        label = [min(one, two) if x in (one, two) else x for x in label]
    assert label == plain_groups(points, 3)


def test_empty_table(spark):
    assert ours(table(spark, []), width=3) == []
    assert ours(table(spark, [(None, "no id", "en", "s")]), width=3) == plain([(None, "no id")], 3)


def test_query_contract(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    got = queries.QUERIES["op11_simhash_groups"](spark, folder).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 3)
    assert sorted(((True, r.doc_id), r.fingerprint, r.component_id) for r in got) == want
