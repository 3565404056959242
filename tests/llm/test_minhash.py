from __future__ import annotations

import random

import numpy as np
import pytest

from corpusprep.llm.components import connected_components
from corpusprep.llm.minhash import band_rows, drop_near_duplicates, estimates, minima, near_duplicates, packed
from tests.llm.helpers import AWKWARD, edited, table, words


def shingles(text, width):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components(pairs):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return root


def brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t, width)
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    links.append((a, b))
    root = components(links)
    return {(i, len(shingles(t, width)), None if i is None else root(i)) for i, t, *_ in rows}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)]
    pairs += [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(80)] + [(5, 5)]
    root = components(pairs)
    links = spark.createDataFrame([*pairs, (None, 1)], "a bigint, b bigint")
    got = {(r.id, r.component) for r in connected_components(links).collect()}
    assert got == {(x, root(x)) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(links.limit(0)).collect() == []


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        seen = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            both = int(300 * share)
            one, two = pool[:300], np.concatenate((pool[:both], pool[300 : 600 - both]))
            seen.append(float(estimates(packed(minima(one)), packed(minima(two))[None])[0]))
        assert abs(np.mean(seen) - both / (600 - both)) < 0.02


def test_bands_lose_little():
    for t in (0.8, 0.85):
        assert (1 - t ** band_rows(t)) ** (128 // band_rows(t)) < 1e-6


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = []
    for k in range(40):
        base = words(rng, rng.choice([1, 2, 4, 30, 80, 200]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            text = " ".join(edited(rng, base, rng.randint(0, max(0, len(base) // 25))))
            rows.append((len(rows), text.upper() if rng.random() < 0.3 else text, "en", "a"))
    rows += [(3000, " ".join(words(rng, 20000)), "en", "a"), (3001, rows[-1][1], "en", "a")] + AWKWARD
    given = table(spark, rows)
    got = near_duplicates(given, width=width, percent=percent).collect()
    assert len(got) == len(rows)
    assert {(r.id, r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)
    assert all(r.kept == (r.id is None or r.id == r.component_id) for r in got)
    kept = drop_near_duplicates(given, width=width, percent=percent)
    assert kept.columns == given.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.id) for r in got if r.kept)


def test_one_group_of_many_variants(spark):
    """Most of a large group hang on one text, some only on each other, in cells of more than one step."""
    rng = random.Random(8)
    base = words(rng, 90)
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 5))), "en", "a") for i in range(420)]
    got = near_duplicates(table(spark, rows), width=3, percent=85).collect()
    assert {(r.id, r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).collect() == []
