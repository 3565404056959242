from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from corpusprep.llm.mixing import mix, mixed_documents
from tests.llm.helpers import AWKWARD, table, words


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Deal out by weight again and again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, left, out = set(order), share * sum(sizes.values()), {}
    while free:
        fair = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if fair[s] >= epochs * sizes[s]]
        if not full:
            return out | fair
        for s in full:
            out[s] = epochs * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def rows():
    rng = random.Random(5)
    made = []
    for i in range(300):
        source = rng.choice(["hot"] * 6 + ["b", "c", "d", "e", None])
        made.append((i, " ".join(words(rng, rng.choice([0, 1, 3, 20, 60]))), "en", source))
    return made + [(900, " ".join(words(rng, 6000)), "en", "c"), (901, "x", "en", "tiny")] + AWKWARD


@pytest.mark.parametrize("block", [16, 256])
def test_mix_meets_targets(spark, block):
    given = rows()
    stream, documents = mix(table(spark, given), block=block)
    sizes, each = collections.Counter(), collections.Counter()
    for i, t, _, s in given:
        sizes[s] += len((t or "").split())
        each[i, len((t or "").split())] += 1
    want = targets(sizes)
    got = documents.collect()
    assert collections.Counter((r.id, r["size"]) for r in got) == each
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by_target = collections.Counter()
    for r in got:
        by_target[round(r.target, 6)] += r.taken
    wanted = collections.Counter()
    for s, t in want.items():
        wanted[round(t, 6)] += int(t + 0.5)
    assert by_target == wanted
    slots = stream.groupBy("slot").agg(F.sum("words").alias("n"), F.count_distinct("source_no").alias("sources")).collect()
    assert all(r.sources == 1 and 0 < r.n <= block for r in slots)
    assert sum(r.n for r in slots) == sum(r.taken for r in got)


def test_schedule_keeps_close_to_the_shares(spark):
    stream, documents = mix(table(spark, rows()), block=4)
    total = {r.source_no: r.n for r in stream.groupBy("source_no").agg(F.sum("words").alias("n")).collect()}
    whole = sum(total.values())
    half = stream.agg(F.expr("percentile(slot, 0.5)")).first()[0]
    early = stream.filter(F.col("slot") < half).groupBy("source_no").agg(F.sum("words").alias("n")).collect()
    seen = sum(r.n for r in early)
    for r in early:
        assert abs(r.n / seen - total[r.source_no] / whole) < 0.02


def test_reruns_agree(spark):
    one = sorted(map(str, mix(table(spark, rows()))[1].collect()))
    two = sorted(map(str, mix(table(spark, rows()[::-1]).repartition(5))[1].collect()))
    assert one == two


def test_mixed_documents(spark):
    given = rows()
    got = collections.Counter(r.doc_id for r in mixed_documents(table(spark, given)).collect())
    assert max(n for i, n in got.items() if i not in (None, 1005)) <= 2
    assert {1000, 1001, 1002} <= set(got)
    assert mixed_documents(table(spark, given)).columns == table(spark, given).columns


def test_empty_table(spark):
    stream, documents = mix(table(spark, []))
    assert stream.collect() == [] and documents.collect() == []
    assert mixed_documents(table(spark, [])).collect() == []
    _, only = mix(table(spark, [(1, None, None, None), (2, "", None, "a")]))
    assert [r.taken for r in only.collect()] == [0, 0]
