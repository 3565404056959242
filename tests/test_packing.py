from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusprep import plans
from corpusprep.functions.vectors import cut_at_stop, left_truncate, rms_normalise
from corpusprep.operators import packing as P
from corpusprep.operators.ordered import previous_value, running, slice_rows
from corpusprep.operators.prefix import running_totals, shuffled_rank


def stream_of(spark, lengths, keys=None):
    keys = keys or list(range(len(lengths)))
    ids, n = [], 0
    for k, length in zip(keys, lengths):
        ids.append((k, list(range(n, n + length))))
        n += length
    df = spark.createDataFrame(ids, "doc_id bigint, ids array<int>").repartition(3)
    return P.with_offsets(df, F.col("ids")), list(range(n))


@pytest.mark.parametrize("n, windows, blocks", [(4, 0, 0), (5, 0, 1), (6, 1, 1), (8, 3, 1), (9, 4, 2)])
def test_counts(spark, n, windows, blocks):
    frame, _ = stream_of(spark, [n])
    assert P.sliding_windows(frame, 4).count() == windows
    assert P.sliding_windows(frame, 4, exact=True).count() == max(0, n - 4)
    assert P.pack_blocks(frame, 4).count() == blocks


def test_values_over_many_examples(spark):
    random.seed(3)
    lengths = [random.choice([0, 1, 2, 7, 3000]) for _ in range(12)] + [5]
    frame, tokens = stream_of(spark, lengths)
    n, b = len(tokens), 9
    packed = {r.block_id: (r.x, r.y) for r in P.pack_blocks(frame, b).collect()}
    assert packed == {
        i: (tokens[i * b : i * b + b], tokens[i * b + 1 : i * b + b + 1]) for i in range((n - 1) // b)
    }
    windows = {r.start: (r.x, r.y) for r in P.sliding_windows(frame, b).collect()}
    assert windows == {i: (tokens[i : i + b], tokens[i + 1 : i + b + 1]) for i in range(n - b - 1)}
    moved = {r.pos: (r.token, r.target) for r in P.shifted_targets(frame).collect()}
    assert moved == {i: (tokens[i], tokens[i + 1] if i + 1 < n else None) for i in range(n)}
    assert {(r.pos, r.token) for r in P.token_stream(frame).collect()} == set(enumerate(tokens))


def test_running_totals_over_sparse_keys(spark):
    random.seed(5)
    keys = [random.randrange(-(2**62), 2**62) for _ in range(300)] + list(range(2**21 - 5, 2**21 + 5)) + [0, -1]
    rows = [(random.choice("aaab"), k, random.randrange(9)) for k in keys]
    df = spark.createDataFrame(rows, "g string, k bigint, v int")
    got = {r.k: r.before_v for r in running_totals(df, "k", ["v"], ["g"]).collect()}
    assert got == {k: sum(w for h, j, w in rows if h == g and j < k) for g, k, _ in rows}


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "block_id")
    ordered = P.make_batches(df, 4, shuffle=False, drop_last=False).collect()
    assert {r.block_id: r.batch_id for r in ordered} == {i: i // 4 for i in range(10)}
    shuffled = P.make_batches(df, 4, seed=1).collect()
    assert len(shuffled) == 8 and {r.batch_id for r in shuffled} == {0, 1}
    ranks = [r["rank"] for r in shuffled_rank(df, "block_id", 1).orderBy("block_id").collect()]
    assert sorted(ranks) == list(range(10)) and ranks != list(range(10))


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_sliced_running_values_with_a_hot_group(spark, slices):
    random.seed(slices)
    rows = [("hot", i, random.randrange(20)) for i in range(200)]
    rows += [(f"g{i % 60}", i, random.randrange(20)) for i in range(100)]
    rows += [(None, i, i) for i in range(9)]  # null is a group too
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int")
    cut = slice_rows(df, ["g"], ["i"], slices)
    got = running(cut, ["g"], ["i"], {"s": F.col("v")})
    got = running(got, ["g"], ["i"], {"m": F.col("v")}, F.max, inclusive=False)
    got = previous_value(got, ["g"], ["i"], "v", "p").collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = sorted((i, v) for g, i, v in rows if g == r.g and i < r.i)
        assert r.s == sum(v for _, v in earlier) + r.v
        assert r.m == max([v for _, v in earlier], default=0)
        assert r.p == (earlier[-1][1] if earlier else None)


def test_prefix_delta(spark):
    rows = [(1, 0, "a"), (1, 1, "ab"), (1, 2, "a"), (1, 3, "ab"), (1, 4, "abc"), (2, 0, ""), (2, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id int, step int, text string")
    got = P.prefix_delta(slice_rows(df, ["doc_id"], ["step"], 3)).orderBy("doc_id", "step").collect()
    assert [(r.doc_id, r.step, r.delta) for r in got] == [(1, 0, "a"), (1, 1, "b"), (1, 4, "c"), (2, 1, "x")]


def test_prefix_delta_shuffles_no_beginnings(spark, tmp_path, monkeypatch):
    """Only lengths are sliced, and the deltas are those of the texts written out step by step."""
    long = "\n".join(f"line {i} ☃" * (i % 3) for i in range(400))
    rows = [(1, long), (2, ""), (3, None), (None, "a\n\nb"), (4, "x\ny"), (4, "x\ny"), (5, "\n\n\n\n\n\n"), (6, "a\nb\nc\nd\ne\nf\ng")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    columns = []
    monkeypatch.setattr(P, "slice_rows", lambda df, *a: columns.extend(df.dtypes) or slice_rows(df, *a))
    got = plans.QUERIES["prefix_delta"](spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in dict(rows).items():
        lines, sent = (text.split("\n") if text is not None else []), 0
        for step in range(len(lines)):
            shown = "\n".join(lines[: step - 1 if step % 5 == 4 else step + 1])
            if shown[sent:]:
                want.append((doc_id, step, shown[sent:]))
            sent = max(sent, len(shown))
    assert Counter(map(tuple, got)) == Counter(want)
    assert columns and all(kind in ("int", "bigint") for _, kind in columns)


def test_array_functions(spark):
    df = spark.createDataFrame([([1, 2, 3, 9, 4],), ([],), ([9],)], "a array<int>")
    assert [r[0] for r in df.select(left_truncate(F.col("a"), 2)).collect()] == [[9, 4], [], [9]]
    assert [r[0] for r in df.select(cut_at_stop(F.col("a"), 9, 4)).collect()] == [[1, 2, 3], [], []]
    assert [r[0] for r in df.select(cut_at_stop(F.col("a"), 9, 3)).collect()] == [[1, 2, 3], [], []]
    vector = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "v array<float>, w array<float>")
    scaled = vector.select(rms_normalise(F.col("v"), 0.0, F.col("w"))).first()[0]
    assert scaled == pytest.approx([3 / 12.5**0.5, 8 / 12.5**0.5])


def test_or_default(spark):
    df = spark.createDataFrame([(1, [5])], "doc_id bigint, ids array<int>")
    assert [r.ids for r in P.or_default(df).collect()] == [[5]]
    assert [(r.doc_id, r.ids) for r in P.or_default(df.filter("false")).collect()] == [(None, [1, 2])]


def test_null_and_repeated_keys_keep_every_token_once(spark):
    rows = [(1, [1, 2, 3]), (1, [1, 2, 3]), (1, [9]), (None, [7, 7]), (0, [4]), (5, []), (2, [5, 6])]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>").repartition(3)
    for n_tokens in (None, F.size("ids")):
        frame = P.with_offsets(df, F.col("ids"), n_tokens)
        got = [r.token for r in P.token_stream(frame).orderBy("pos").collect()]
        assert [r.pos for r in P.token_stream(frame).orderBy("pos").collect()] == list(range(10))
        assert got[0] == 4 and got[8:] == [5, 6] and sorted(got[1:8]) == [1, 1, 2, 2, 3, 3, 9]
    left = P.without_key(df).collect()
    assert [r.ids for r in left] == [[7, 7]]


def test_repeated_keys_and_whole_rows(spark):
    """Every token has its place once, rows of a key follow each other, copies of a row too."""
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.choice([1, 2, 3, 50, 51]), [rng.randrange(9) for _ in range(rng.randrange(4))], "x") for _ in range(120)]
    rows += [("a", 7, [1, 2, 3], "copy")] * 40 + [("a", 7, [4], str(k)) for k in range(200)] + [("b", None, [5], "no key")]
    df = spark.createDataFrame(rows, "g string, k bigint, ids array<int>, slice string").repartition(4)
    for n_tokens in (F.size("ids"), None):
        placed = P.with_offsets(df, F.col("ids"), n_tokens, key="k", group=["g"]).collect()
        for g in "ab":
            mine = sorted((r.offset, len(r.ids), r.k, r.ids) for r in placed if r.g == g)
            assert sorted((k, i) for _, _, k, i in mine) == sorted((r[1], r[2]) for r in rows if r[0] == g and r[1] is not None)
            assert sum(n for _, n, _, _ in mine) == max(o + n for o, n, _, _ in mine)
            ends = 0
            for offset, n, _, _ in mine:
                assert offset == ends
                ends = offset + n
            keys = [k for _, n, k, _ in mine if n]
            assert keys == sorted(keys)


def test_packing_reads_the_corpus_twice(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.range(500).selectExpr("id as doc_id", "repeat(cast(id as string), 9) as text").write.parquet(path)
    texts = spark.read.parquet(path)
    frame = P.with_offsets(texts, F.split("text", "").cast("array<int>"), F.length("text"))
    plan = P.pack_blocks(frame, 16)._jdf.queryExecution().executedPlan().toString()
    # The other read was that of the sizes, which are in a table of their own.
    assert plan.count("/texts]") == 1
