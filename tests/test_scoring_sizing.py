from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import scoring as S
from corpusprep.operators import sizing as Z


@pytest.fixture(scope="module")
def table(spark):
    random.seed(2)
    rows = [(1, c, 1, random.uniform(-900, 900)) for c in range(500)]
    rows += [(g, c, 0, random.choice([0.0, 1.0])) for g in range(2, 6) for c in range(4)]
    schema = "group_id int, cand_id int, target int, score double"
    return spark.createDataFrame(rows, schema), rows


def test_picks(table):
    df, rows = table
    best = {r.group_id: r.cand_id for r in S.argmax(df).collect()}
    groups = {g: sorted(((-s, c) for h, c, _, s in rows if h == g)) for g in best}
    assert best == {g: v[0][1] for g, v in groups.items()}
    top = {(r.group_id, r["rank"]): r.cand_id for r in S.top_k(df, 3).collect()}
    assert top == {(g, i + 1): c for g, v in groups.items() for i, (_, c) in enumerate(v[:3])}
    every = {(r.group_id, r["rank"]): r.cand_id for r in S.top_k(df, 0).collect()}
    assert every == {(g, i + 1): c for g, v in groups.items() for i, (_, c) in enumerate(v)}
    assert S.top_k(df, 2000).count() == len(rows)


def test_null_group_and_hot_group(spark):
    rows = [(None, c, 3, float(c % 7)) for c in range(2500)] + [(1, c, 0, 1.0) for c in range(4)]
    df = spark.createDataFrame(rows, "group_id int, cand_id int, target int, score double")
    soft = S.softmax(df)
    assert soft.count() == len(rows)
    sums = {r.group_id: r.s for r in soft.groupBy("group_id").agg(F.sum("probability").alias("s")).collect()}
    assert sums == {None: pytest.approx(1.0), 1: pytest.approx(1.0)}
    assert S.cross_entropy(df).first().groups == 2
    best = [c for _, c, _, _ in sorted(rows[:2500], key=lambda r: (-r[3], r[1]))]
    top = S.top_k(df, 2000).filter("group_id is null").orderBy("rank").collect()
    assert [r.cand_id for r in top] == best[:2000] and [r["rank"] for r in top] == list(range(1, 2001))


def test_softmax_and_loss(table):
    df, rows = table
    for t in (1.0, 0.5):
        sums = {r.group_id: r.s for r in S.softmax(df, t).groupBy("group_id").agg(F.sum("probability").alias("s")).collect()}
        assert all(v == pytest.approx(1.0) for v in sums.values()) and len(sums) == 5
    losses = []
    for g in range(1, 6):
        scores = {c: s for h, c, _, s in rows if h == g}
        target = next(t for h, _, t, _ in rows if h == g)
        top = max(scores.values())
        losses.append(top + math.log(sum(math.exp(s - top) for s in scores.values())) - scores[target])
    row = S.cross_entropy(df).first()
    assert (row.groups, row.loss) == (5, pytest.approx(sum(losses) / 5))


def test_weighted_draw_follows_the_softmax(spark):
    df = spark.range(4000).select(
        F.col("id").alias("group_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cand_id")
    ).withColumn("score", F.log(F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0)), F.col("cand_id") + 1)))
    drawn = Counter(r.cand_id for r in S.weighted_draw(df, 3).collect())
    again = Counter(r.cand_id for r in S.weighted_draw(df.repartition(7), 3).collect())
    assert drawn == again and sum(drawn.values()) == 4000
    for cand, share in enumerate((1 / 8, 2 / 8, 5 / 8)):
        assert drawn[cand] / 4000 == pytest.approx(share, abs=0.03)


def estimate(rows, block, batch, max_bytes, max_examples):
    """The sampling loop, one line at a time."""
    read = seen = tokens = 0
    for n_bytes, parsed, valid, n_tokens in rows:
        read += n_bytes
        if not parsed:
            continue
        if valid:
            tokens += n_tokens
            seen += 1
        if read >= max_bytes or seen >= max_examples:
            break
    if read == 0 or tokens == 0:
        return 1
    return max(1, int(tokens * (sum(r[0] for r in rows) / max(1, read))) // max(1, block * batch))


def test_estimate_steps(spark):
    random.seed(8)
    rows = []
    for _ in range(300):
        parsed = random.random() < 0.7
        valid = parsed and random.random() < 0.8
        rows.append((random.randrange(1, 90), parsed, valid, random.randrange(50) if valid else None))
    schema = "line_no bigint, n_bytes int, parsed boolean, valid boolean, n_tokens int"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    for limits in ((500, 5000), (10**9, 20), (10**9, 10**9), (1, 1)):
        assert Z.estimate_steps(df, 4, 2, *limits).first().steps == estimate(rows, 4, 2, *limits)
    assert Z.estimate_steps(df.limit(0), 4, 2).first().steps == 1


def test_exact_steps(spark):
    df = spark.createDataFrame([(30,), (12,)], "n int")
    row = Z.exact_steps(df, F.col("n"), block=8, batch=5, epochs=3).first()
    assert (row.tokens, row.windows, row.batches, row.steps) == (42, 33, 6, 18)
    assert Z.exact_steps(df.limit(0), F.col("n"), 8, 5, 3).first().steps == 1
