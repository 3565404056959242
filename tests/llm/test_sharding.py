from __future__ import annotations

import collections
import math
import random

from corpusprep.llm.sharding import communication_matrix, even_sizes, hypergeometric, shuffle_to_shards
from tests.llm.helpers import AWKWARD, table


def test_hypergeometric_has_the_right_law():
    rng = random.Random(4)
    drawn = collections.Counter(hypergeometric(rng, 6, 9, 5) for _ in range(20000))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(drawn[k] / 20000 - p) < 4 * math.sqrt(p * (1 - p) / 20000) + 1e-9
    big = [hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(50)]
    assert abs(sum(big) / 50 - 250_000) < 500


def test_matrix_sums():
    rows, columns = [5, 0, 17, 8], even_sizes(30, 7)
    matrix = communication_matrix(rows, columns, 3)
    assert [sum(r) for r in matrix] == rows
    assert [sum(c) for c in zip(*matrix)] == columns


def places(spark, rows, shards, **options):
    return shuffle_to_shards(table(spark, rows), shards, **options).collect()


def test_exact_sizes_and_gapless_slots(spark):
    rows = [(i, f"text {i}", "en", "a") for i in range(200)] + [(i, "copy", "en", "b") for i in range(300, 400)] + AWKWARD
    got = places(spark, rows, 9, blocks=5)
    assert sorted(map(str, [r.doc_id for r in got])) == sorted(str(r[0]) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == sorted(even_sizes(len(rows), 9))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = places(spark, list(reversed(rows)), 9, blocks=5)
    known = lambda rows: sorted((r.doc_id, r.shard, r.slot) for r in rows if r.doc_id not in (None, 1005))
    assert known(got) == known(again)


def test_more_shards_than_rows_and_no_rows(spark):
    assert len({r.shard for r in places(spark, AWKWARD, 40)}) == len(AWKWARD)
    assert places(spark, [], 40) == []


def test_shuffle_is_uniform(spark):
    rows = [(i, "t", "en", "a") for i in range(24)]
    hits = collections.Counter()
    for seed in range(12):
        for r in places(spark, rows, 4, blocks=3, seed=seed):
            hits[r.shard, r.doc_id % 4] += 1
    # 16 cells of 18 expected; chi square with 9 degrees of freedom
    assert sum((n - 18) ** 2 / 18 for n in hits.values()) < 28
