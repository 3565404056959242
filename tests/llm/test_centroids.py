"""Centroid clustering against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from corpusprep.llm import centroids


def plain(rows, dims, k, rounds, salt="3:"):
    kept = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))
    centres = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    return sorted(((i is not None, i or 0), *reversed(nearest(v))) for i, v in kept), centres


def ours(spark, rows, dims, k, rounds, kind="float"):
    df = spark.createDataFrame([(i, v, "x", 1, b"v") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster string, id int, v binary")
    found, centres = centroids.cluster(df.repartition(3), dims=dims, k=k, rounds=rounds)
    return sorted(((r.id is not None, r.id or 0), r.cluster, r.distance) for r in found.collect()), centres


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(i % 4, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(i + 1000, [0.25] * 6) for i in range(50)]  # copies of one vector
    rows += [(7, [1.0] * 6), (7, [-1.0] * 6), (None, [0.5] * 6), (None, [0.5] * 6)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 5 + [None]), (2004, [math.nan] * 6), (2005, [math.inf] * 6)]
    assert ours(spark, rows, 6, 5, 4) == plain(rows, 6, 5, 4)


@pytest.mark.parametrize("size", [1e4, 1e6, 1e9 / 1024])
def test_wide_components_stay_exact(spark, size):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(60)]
    assert ours(spark, rows, 4, 3, 3, "double") == plain(rows, 4, 3, 3)


def test_ties_go_to_the_smaller_number():
    found = centroids.Bisectors([[0, 0], [2, 0], [0, 2], [2, 0]])
    best, distance = found.nearest(np.array([[1, 0], [1, 1], [2, 0], [0, 1]]))
    assert best.tolist() == [0, 0, 1, 0] and distance.tolist() == [1, 2, 0, 1]


def test_tournament_equals_all_distances():
    rng = np.random.default_rng(3)
    for scale in (10, 2**27, 2**40):
        centres = rng.integers(-scale, scale, (9, 5)).tolist()
        points = rng.integers(-scale, scale, (200, 5))
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres)) for p in points]
        best, distance = centroids.Bisectors(centres).nearest(points)
        assert [(int(d), int(b)) for d, b in zip(distance, best)] == want


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert ours(spark, rows, 2, 8, 10) == plain(rows, 2, 8, 10)
    assert ours(spark, [(1, None)], 2, 8, 10) == ([], [])
    assert ours(spark, [], 2, 8, 10) == ([], [])


def test_too_wide_raises(spark):
    with pytest.raises(Exception, match="does not fit"):
        ours(spark, [(1, [1e300, 0.0])], 2, 8, 1, "double")


def test_inertia(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 0, 7), (3, 2, 1)], "id bigint, cluster int, distance bigint")
    got = {r.id: (r.cluster_inertia, r.inertia) for r in centroids.with_inertia(df).collect()}
    assert got == {1: (12, 13), 2: (12, 13), 3: (1, 13)}
