from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import text as T
from corpusprep.functions.labels import size_label
from corpusprep.functions.tokens import byte_ids, byte_token_count


def apply(spark, values, function):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i int, t string").select("i", function(F.col("t")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("self wolf selfé LF10x CR13 lf.", "se wo selfé LF10x  ."),
        ("<0x41><0xD0><0x9F>", "AÐ\u009f"),
        ("```py\ncode\n```", "\ncode\n"),
        ("\x01a\t\r﷐\x85", "a\t\r\x85"),
        ("a<0x0A>```x", "a\n"),
        ("a\r```x", "a\r```x"),
        ("lf́", "́"),
        ("<0x0D>x<0xZZ>", "\rx<0xZZ>"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_text(spark, raw, cleaned):
    assert apply(spark, [raw], T.clean_text) == [cleaned]


def test_whole_word_markers_and_null_policy(spark):
    assert apply(spark, ["self CR LF10x"], lambda c: T.strip_diag_markers(c, "whole_word")) == [
        "self  LF10x"
    ]
    assert apply(spark, [None], lambda c: T.clean_text(c, null_policy="keep")) == [None]


def test_ustrip_equals_python_strip(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [s + "a" + s + "b" + s for s in spaces] + ["​ a", "".join(spaces), "plain"]
    assert apply(spark, values, T.ustrip) == [v.strip() for v in values]
    assert apply(spark, values, T.is_blank) == [not v.strip() for v in values]


def test_drop_bad_utf8_equals_python_ignore(spark):
    values = [
        b"plain", b"a\xe2\x82A\xff\xd0\x9f", b"\xf0\x9f\x98\x80\xf0\x9f", b"\xed\xa0\x80x", b"\xc0\xafy", b"\xf5\x80z", b"",
    ]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, b binary")
    got = df.select("i", T.drop_bad_utf8(F.col("b")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [v.decode("utf-8", "ignore") for v in values]


def test_size_label_rounds_the_binary_value(spark):
    counts = [0, 999, 1000, 1050, 1150000, 1250000, 350000000, 999949, 999950, 10**9, 2450000000, 10**13 + 5]
    counts += [50_000 * k for k in range(20, 400)]

    def label(n):
        for bound, unit in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
            if n >= bound:
                return f"{n / bound:.1f}".rstrip("0").rstrip(".") + unit
        return str(n)

    df = spark.createDataFrame([(n,) for n in counts], "n bigint")
    got = {r.n: r.label for r in df.select("n", size_label(F.col("n")).alias("label")).collect()}
    assert got == {n: label(n) for n in counts}


def test_byte_ids_keep_markers(spark):
    values = ["aé<|eot_id|>", "", "<|eot_id|", "😀<|begin_of_text|><|end_of_text|>"]
    ids = apply(spark, values, byte_ids)
    assert ids[0] == [1, 105, 203, 177, 7, 2]
    assert ids[1] == [1, 2]
    assert ids[2] == [1, *[b + 8 for b in b"<|eot_id|"], 2]
    assert ids[3] == [1, *[b + 8 for b in "😀".encode()], 3, 4, 2]
    assert apply(spark, values, byte_token_count) == [len(i) for i in ids]
