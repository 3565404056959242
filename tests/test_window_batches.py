"""Batches of shuffled windows against the windows that are shuffled as rows."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprep.operators import packing as P
from corpusprep.operators import window_batches


@pytest.mark.parametrize("exact, drop_last", [(False, True), (True, False)])
def test_equal_to_shuffled_rows(spark, monkeypatch, exact, drop_last):
    monkeypatch.setattr(window_batches, "_GROUP", 1000)
    monkeypatch.setattr(window_batches, "_CHUNK_BITS", (11, 20))
    rows = spark.range(700).withColumn("ids", F.transform(F.sequence(F.lit(0), F.col("id") % 19), lambda i: (i * 7 + F.col("id")).cast("int")))
    rows = P.with_offsets(rows.filter("id % 5 <> 1"), F.when(F.col("id") % 11 != 0, F.col("ids")).otherwise(F.array().cast("array<int>")), key="id")
    old = P.make_batches(P.sliding_windows(rows, 8, exact=exact), 16, key="start", seed=3, drop_last=drop_last)
    new = window_batches.shuffled_windows(rows, 8, 16, seed=3, exact=exact, drop_last=drop_last)
    assert old.select(new.columns).dtypes == new.dtypes
    found = sorted(tuple(r) for r in new.collect())
    assert len(found) > 4096 and found == sorted(tuple(r) for r in old.select(new.columns).collect())


@pytest.mark.parametrize("tokens, windows", [(0, 0), (9, 0), (10, 1), (30, 21)])
def test_short_streams(spark, tokens, windows):
    rows = spark.createDataFrame([(0, 0, list(range(tokens)))], "id long, offset long, ids array<int>")
    new = window_batches.shuffled_windows(rows, 8, 4, drop_last=False)
    assert new.count() == windows


def test_windows_are_not_shuffled(spark):
    rows = spark.createDataFrame([(0, 0, list(range(300)))], "id long, offset long, ids array<int>")
    plan = window_batches.shuffled_windows(rows, 8, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapCoGroups")]


@pytest.mark.parametrize("tokens, exact", [(700, False), (700, True), (10, False), (9, False), (300, True)])
def test_windows_as_text(spark, tokens, exact):
    rows = spark.createDataFrame([(0, 0, [(k * k) % 70_001 if tokens == 300 else k % 260 for k in range(tokens)])], "id long, offset long, ids array<int>")
    plain = window_batches.shuffled_windows(rows, 8, 4, seed=2, exact=exact)
    text = window_batches.shuffled_windows(rows, 8, 4, seed=2, exact=exact, text=True)
    assert text.dtypes[1:3] == [("x", "binary"), ("y", "binary")]
    want = {(r.start, " ".join(map(str, r.x)), " ".join(map(str, r.y)), r.batch_id) for r in plain.collect()}
    assert {(r.start, r.x.decode(), r.y.decode(), r.batch_id) for r in text.collect()} == want


@pytest.mark.parametrize("seed", [0, 7, 10**44])
def test_hashes_are_md5(seed):
    starts = np.array(sorted({*range(120), *[10**k + d for k in range(2, 19) for d in (-1, 0, 1)], 2**32, 2**62, *range(99_000, 120_000)}))
    high, low = window_batches._hashes(starts, seed)
    for start, a, b in zip(starts.tolist(), high.tolist(), low.tolist()):
        assert (a << 64 | b) == int(md5(b"%d:%d" % (seed, start)).hexdigest(), 16)


def test_windows_take_three_bytes_of_shuffle():
    """What one start costs on the way to its group of hashes and back, with as many starts as a group and a chunk have."""
    rng = np.random.default_rng(1)
    gaps, batches = rng.geometric(1 / 512, 2048), np.sort(rng.integers(0, 20_000, 2048))
    there, back = window_batches._packed(gaps), window_batches._packed(np.diff(batches, prepend=0))
    assert (window_batches._unpacked(there, 2048) == gaps).all() and len(there) < 1.7 * 2048 and len(back) < 2048
    wide = np.array([0, 2**40, 1])
    assert (window_batches._unpacked(window_batches._packed(wide), 3) == wide).all()
    assert (window_batches._unpacked(window_batches._packed(np.zeros(5, np.int64)), 5) == 0).all()


def test_digests_are_made_once(spark):
    from corpusprep.plans.packing import _window_digests

    rows = spark.createDataFrame([(0, list(range(300)))], "id long, ids array<int>")
    plan = _window_digests(*P.with_offsets_and_total(rows, F.col("ids"), key="id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("array_join") == 0


def test_total_of_a_stream(spark):
    rows = spark.createDataFrame([(0, [5, 300, 7], "a"), (1, [70_000], "a"), (1, [70_000], "a"), (2, [], "b"), (None, [1], "b")], "id long, ids array<int>, g string")
    found, total = P.with_offsets_and_total(rows, F.col("ids"), F.size("ids"), key="id")
    assert total.first().n_tokens == 5 and sorted(tuple(r) for r in found.select("id", "offset").collect()) == [(0, 0), (1, 3), (1, 4), (2, 5)]
    assert {tuple(r) for r in P.with_offsets_and_total(rows, F.col("ids"), key="id", group=["g"])[1].collect()} == {("a", 5), ("b", 0)}
    assert P.with_offsets_and_total(rows.limit(0), F.col("ids"), key="id")[1].first().n_tokens == 0
    windows = window_batches.shuffled_windows(found, 1, 1, exact=True, drop_last=False)
    assert {(r.start, r.x[0], r.y[0]) for r in windows.collect()} == {(0, 5, 300), (1, 300, 7), (2, 7, 70_000), (3, 70_000, 70_000)}
