"""Small tables with the awkward rows that each operator has to bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, size string, `key` int, bucket string, rep string"


def table(spark, rows):
    """Documents from (doc_id, text, lang, source), with extra columns whose names operators use inside."""
    full = [(i, t, la, s, None if t is None else len(t), 7, "x", 1, "b", "r") for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def edited(rng: random.Random, base: list[str], changes: int) -> list[str]:
    out = list(base)
    for k in rng.sample(range(len(out)), changes):
        out[k] = "".join(rng.choice("qrstuvwxyz") for _ in range(6))
    return out


AWKWARD = [
    (1000, None, None, None), (1001, "", "en", "a"), (1002, " \t\n", "en", "a"), (1003, "one", None, "a"),
    (1004, "Two words", "en", None), (1005, "two WORDS", "en", None), (1005, "two WORDS", "en", None),
    (None, "a row without id", "en", "b"), (None, "a row without id", "en", "b"), (1006, "12 34 !?", "en", "b"),
]
