from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusprep.functions.chat import render_chat
from corpusprep.operators import records as R

BEGIN, EOT = "<|begin_of_text|>", "<|eot_id|>"


def turn(role, text):
    return f"<|start_header_id|>{role}<|end_header_id|>\n\n{text}{EOT}"


def pair(user, answer):
    return BEGIN + turn("user", user) + turn("assistant", answer)


CASES = [
    ("   ", None),
    ("{bad", "unparsable"),
    ("[1]", "not an object"),
    ('{"text":"t","prompt":"p","answer":"a"}', ("text", "t")),
    ('{"text":"CR","prompt":"p","answer":"a"}', None),
    ('{"prompt":"","user":"u","answer":"a"}', ("pair", pair("u", "a"))),
    ('{"question":"","answer":"a","messages":[{"role":"user","content":"m"}]}', ("pair", pair("", "a"))),
    (
        json.dumps(
            {
                "messages": [
                    {"role": r, "content": c}
                    for r, c in (("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2"))
                ]
            }
        ),
        ("pair", pair("u2", "a2")),
    ),
    ('{"messages":[{"role":"assistant","content":"a"},{"role":"user","content":"u"}]}', ("pair", pair("u", "a"))),
    ('{"prompt":"p"}', None),
    ('{"prompt":"p","answer":""}', ("pair", pair("p", ""))),
    ('{"prompt":5,"answer":"a"}', "field is not a string"),
    ('{"prompt":0,"user":"u","answer":"a"}', ("pair", pair("u", "a"))),
    ('{"prompt":"p","user":5,"answer":"a"}', ("pair", pair("p", "a"))),
    ('{"question":false,"answer":"a"}', ("pair", pair("", "a"))),
    ('{"system":7,"prompt":"p","answer":"a"}', "field is not a string"),
    ('{"text":["x"]}', "text is not a string"),
    ('{"prompt":"p","messages":["x"]}', "message is not an object"),
    ('{"prompt":"p","answer":"a","messages":["x"]}', ("pair", pair("p", "a"))),
    ('{"prompt":"p","messages":[{"role":"assistant","content":null}]}', None),
    ('{"prompt":"p","messages":[{"role":"assistant"}]}', ("pair", pair("p", ""))),
    ('{"prompt":"p","messages":7}', None),
    ('{"prompt":" ```x\\nq ","answer":"a"}', ("pair", pair("\nq", "a"))),
]


@pytest.fixture(scope="module")
def outcome(spark):
    lines = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    good, broken = R.split_rejects(R.parse_lines(lines))
    examples, odd = R.sft_examples(good, ["i"])
    found = {r.i: (r.kind, r.example) for r in examples.collect()}
    found |= {r.i: r.reject for r in broken.select("i", "reject").unionByName(odd).collect()}
    return found


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sft_examples(outcome, i):
    assert outcome.get(i) == CASES[i][1]


def test_marker_flag_and_system(spark):
    raw = '{"system":"be brief","prompt":"x<|eot_id|>","answer":"a"}'
    good, _ = R.split_rejects(R.parse_lines(spark.createDataFrame([(raw,)], "raw string")))
    row = R.sft_examples(good, [], include_system=True)[0].first()
    assert row.has_marker
    assert row.example == BEGIN + turn("system", "be brief") + turn("user", "x<|eot_id|>") + turn("assistant", "a")


def test_corpus_fields_keep_strings_only(spark):
    raw = '{"answer":"a","text":"  ","user":5,"system":"CR s","messages":[{"content":"m"},{"content":1},{"content":" "}]}'
    good, _ = R.split_rejects(R.parse_lines(spark.createDataFrame([(1, raw)], "i int, raw string")))
    fields = R.corpus_fields(good, ["i"]).orderBy("field_rank").collect()
    assert [(r.field, r.text) for r in fields] == [("system", " s"), ("answer", "a")]
    assert [r.text for r in R.corpus_messages(good, ["i"]).collect()] == ["m"]


def test_render_chatml(spark):
    df = spark.createDataFrame([("s", "u", None)], "s string, u string, a string")
    got = df.select(render_chat(F.col("s"), F.col("u"), F.col("a"), "chatml")).first()[0]
    assert got == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"


def test_pair_from_messages(spark):
    rows = [(1, 0, "assistant", "a"), (1, 1, "user", "u"), (1, 2, "system", "s2"), (1, 3, "system", "s3"), (2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.system, r.user, r.assistant) for r in R.pair_from_messages(turns).collect()}
    assert got == {1: ("s2", "u", "a"), 2: (None, "x", None)}
    assert R.complete_pairs(R.pair_from_messages(turns)).count() == 1
