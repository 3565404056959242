from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprep.functions.tokens import FIRST_LEARNED, WORD_PATTERN
from corpusprep.operators import encode, merges, vocab
from corpusprep.session import cut_lineage

spm = pytest.importorskip("sentencepiece")


def corpus(seed=1, alphabet="abcd", lines=40):
    random.seed(seed)

    def word():
        return "".join(random.choice(alphabet) for _ in range(random.randrange(1, 9)))

    return [" ".join(word() for _ in range(20)) for _ in range(lines)]


def textbook(lines, n_merges, max_piece=16):
    """One best pair at a time over all words."""
    counts = Counter(w for t in lines for w in re.findall(WORD_PATTERN, t.replace(" ", "▁")))
    state = {w: [ord(c) for c in w] for w in counts}
    piece, merges = {}, []

    def text(s):
        return piece.get(s) or chr(s)

    while len(merges) < n_merges:
        pairs = Counter()
        for w, s in state.items():
            for pair in zip(s, s[1:]):
                pairs[pair] += counts[w]
        pairs = {p: n for p, n in pairs.items() if len(text(p[0]) + text(p[1])) <= max_piece}
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda kv: (-kv[1], max(kv[0]), kv[0]))
        new = 0x110000 + len(merges)
        piece[new] = text(a) + text(b)
        merges.append((len(merges), text(a), text(b), n))
        for w, s in state.items():
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            state[w] = out
    return merges


@pytest.mark.parametrize("alphabet, max_piece", [("abcd", 16), ("ab", 4), ("aaab", 16)])
def test_merges_equal_the_textbook(spark, alphabet, max_piece):
    lines = corpus(alphabet=alphabet)
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    got = vocab.learn_merges(vocab.word_counts(df), 25, max_piece)
    assert got == textbook(lines, 25, max_piece)


def test_two_thousand_merges(spark, monkeypatch):
    """Several stages, and a small frontier that is counted anew."""
    monkeypatch.setattr(merges, "STAGE_MERGES", 900)
    lines = corpus(seed=8, alphabet="abcdefghijklmnopqrstuvwxyz", lines=150)
    counts = vocab.word_counts(spark.createDataFrame([(t,) for t in lines], "text string"))
    got = [(rank, *m) for rank, m in enumerate(merges.learn(counts, 2000, 6, frontier=400))]
    assert len(got) == 2000
    assert got == textbook(lines, 2000, 6)


def test_merges_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(merges, "TASK_WORDS", 100)
    lines = corpus(seed=8, alphabet="abcdefgh", lines=40)
    counts = vocab.word_counts(spark.createDataFrame([(t,) for t in lines], "text string"))
    got = [(rank, *m) for rank, m in enumerate(merges.learn(counts, 40, 16, frontier=50))]
    assert got == textbook(lines, 40)


def test_merges_in_rounds_are_the_same(spark):
    df = spark.createDataFrame([(t,) for t in corpus(seed=9, alphabet="abc")], "text string")
    counts = vocab.word_counts(df)
    assert vocab.learn_merges_in_rounds(counts, 30) == vocab.learn_merges(counts, 30)


def test_merges_run_out_and_ties_fill_the_frontier(spark):
    counts = spark.createDataFrame([("ab", 5), ("cd", 5), ("ef", 5), ("x", 9)], "word string, n bigint")
    assert merges.learn(counts, 10, 16, frontier=1) == [("a", "b", 5), ("c", "d", 5), ("e", "f", 5)]
    assert merges.learn(counts, 10, 1) == []
    assert merges.learn(counts.filter("false"), 10, 16) == []


def test_word_table_gives_the_same_ids(spark):
    lines = corpus(seed=3, lines=20) + ["", "  ab  <|eot_id|> ünknown", None]
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    counts = vocab.word_counts(df)
    pieces, _ = vocab.train_on_words(counts, FIRST_LEARNED + 40)
    plain = encode.bpe_ids(pieces)
    for limit in (1, 7, 10_000):
        looked_up = encode.bpe_ids(pieces, encode.word_table(counts, pieces, limit))
        rows = df.select(plain(F.col("text")).alias("a"), looked_up(F.col("text")).alias("b")).collect()
        assert all(r.a == r.b for r in rows)


def test_short_words_merge_as_long_ones(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        ids = {c: 100 + k for k, c in enumerate("abc")}
        for k in range(40):
            ids.setdefault("".join(rng.choice("abc") for _ in range(rng.randint(2, 5))), k)
        words = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 32))) for _ in range(30)]
        monkeypatch.setattr(encode, "SHORT_WORD", 32)
        short = [encode.merge_word(w, ids) for w in words]
        monkeypatch.setattr(encode, "SHORT_WORD", -1)
        assert short == [encode.merge_word(w, ids) for w in words]


def test_reserved_ids(spark):
    rows = vocab.base_vocab(spark).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(FIRST_LEARNED))
    assert [r.piece for r in rows[:9]] == [
        "<unk>", "<s>", "</s>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>",
        "<|end_header_id|>", "<|eot_id|>", "<0x00>",
    ]
    assert [r[0] for r in vocab.stop_ids(vocab.base_vocab(spark)).collect()] == [[2, 7]]


def test_encoding_equals_sentencepiece(spark, tmp_path):
    """Same ids as the public tokenizer, given its vocabulary and options."""
    path = tmp_path / "corpus.txt"
    path.write_text("\n".join(corpus(seed=9, alphabet="abcdeé", lines=200)))
    spm.SentencePieceTrainer.Train(
        input=str(path), model_prefix=str(tmp_path / "m"), vocab_size=400, model_type="bpe",
        character_coverage=1.0, bos_id=1, eos_id=2, unk_id=0, pad_id=-1, byte_fallback=True,
        normalization_rule_name="identity", add_dummy_prefix=False, hard_vocab_limit=False,
        user_defined_symbols=list(vocab.MARKERS), minloglevel=2,
    )
    model = spm.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    rows = [(i, model.id_to_piece(i), "piece") for i in range(FIRST_LEARNED, model.vocab_size())]
    pieces = vocab.base_vocab(spark).unionByName(vocab.local_frame(spark, rows, vocab.VOCAB_SCHEMA))
    texts = corpus(seed=10, alphabet="abcdeé", lines=30) + [
        "", "  a  b ", "ab\ncd\tx", "жab 😀", "ab<|eot_id|>cd ab", "<|begin_of_text|> a", "a" * 500,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", encode.bpe_ids(pieces)(F.col("text")).alias("ids"))
    got = got.withColumn("back", encode.bpe_text(pieces)(F.col("ids"))).orderBy("i").collect()
    for text, row in zip(texts, got):
        assert row.ids == [1, *model.encode(text), 2], text
        assert row.back == model.decode(row.ids), text


def test_long_word_and_unknown_characters(spark):
    df = spark.createDataFrame([("ab" * 50 + " a",)], "text string")
    pieces, merges = vocab.train_bpe(df, FIRST_LEARNED + 3 + 6)
    assert merges.count() <= 6 and pieces.count() <= FIRST_LEARNED + 9
    text = "ab" * 40_000 + " ж"
    row = spark.createDataFrame([(text,)], "text string").select(
        encode.bpe_ids(pieces)(F.col("text")).alias("ids")
    ).withColumn("back", encode.bpe_text(pieces)(F.col("ids"))).first()
    assert row.back == text
    assert row.ids[-3:-1] == [8 + b for b in "ж".encode()]


def test_check_vocab(spark):
    configs = spark.createDataFrame([("a", 264), ("b", 300)], "model string, vocab_size int")
    assert [r.model for r in vocab.check_vocab(configs, vocab.base_vocab(spark)).collect()] == ["b"]


def test_ids_leave_a_task_in_bounded_series(spark):
    rows = [[1] * 3000 if i % 3 else (None if i % 2 else []) for i in range(2000)]
    parts = list(encode.bounded_series(rows))
    assert [None if r is None else r.tolist() for p in parts for r in p] == rows
    assert all(sum(len(r) for r in p if r is not None) < encode.BATCH_IDS + 3000 for p in parts)
    pieces, _ = vocab.train_bpe(spark.createDataFrame([("abc abd",)], "text string"), 270)
    df = spark.range(0, 300, 1, 1).selectExpr("id", "if(id % 7 = 0, null, repeat('abc xyz ', 900)) AS text")
    got = df.select("id", encode.bpe_ids(pieces)(F.col("text")).alias("ids")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(300)) and {r.ids is None for r in got if r.id % 7 == 0} == {True}
    assert len({tuple(r.ids) for r in got if r.id % 7}) == 1


def test_word_index_holds_few_bytes_a_place():
    """Places take twelve bytes, and only pairs that can be merged in the stage are indexed."""
    rng = random.Random(3)
    sizes = np.array([rng.randrange(2, 14) for _ in range(20_000)])
    symbols = np.array([ord(rng.choice("abcdefgh")) for _ in range(int(sizes.sum()))], np.int32)
    known = [(ord(a), ord(b)) for a in "abcdefgh" for b in "abcdefgh"]
    tracemalloc.start()
    index = merges.WordIndex([(symbols, sizes, np.ones(len(sizes), np.int64))], known, merges.FIRST_MERGE, 5)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 * len(symbols)
    few = merges.WordIndex([(symbols, sizes, np.ones(len(sizes), np.int64))], known[:2], merges.FIRST_MERGE, 5)
    assert len(index.where) == 64 and len(few.where) == 2


def test_the_last_stage_hands_no_words_on(spark, monkeypatch):
    written = []
    monkeypatch.setattr(merges, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    counts = vocab.word_counts(spark.createDataFrame([(t,) for t in corpus()], "text string"))
    assert len(merges.learn(counts, 7, 16)) == 7
    assert [t.count() for t in written[1:]] == [7]


@pytest.mark.parametrize("many", [0, 1 << 14])
def test_merges_of_pairs_that_overlap(spark, monkeypatch, many):
    monkeypatch.setattr(merges, "_MANY", many)
    monkeypatch.setattr(merges, "_CHUNK", 7)
    monkeypatch.setattr(merges, "STAGE_MERGES", 9)
    lines = corpus(seed=4, alphabet="aaab") + ["aaaaaaa aaaa bbbbb abababab aa"]
    counts = vocab.word_counts(spark.createDataFrame([(t,) for t in lines], "text string"))
    assert [(rank, *m) for rank, m in enumerate(merges.learn(counts, 30, 16))] == textbook(lines, 30)


def test_word_counts_of_marks_and_spaces(spark):
    lines = ["a▁▁b", "▁a", "a▁", "  a   b ", "▁", " ", "", "a ▁ b", "▁  ▁", "a\tb  c", "x\r\n\r\ny z\rw"]
    found = Counter(w for t in lines for one in re.split("\r\n|\r|\n", t) for w in re.findall(WORD_PATTERN, re.sub(" {2,}", " ", one).strip(" ").replace(" ", "▁")))
    df = spark.createDataFrame([(t,) for t in [*lines, None]], "text string")
    counted = vocab.word_counts(df)
    assert {r.word: r.n for r in counted.collect()} == dict(found)
    assert "regexp_extract_all" not in counted._jdf.queryExecution().executedPlan().toString()
