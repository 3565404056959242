from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from corpusprep.llm import langid
from tests.llm.helpers import AWKWARD, table

SOUNDS = {"xx": ["ka", "mo", "ti", "sel", "ora"], "yy": ["zu", "vra", "nö", "ik", "ül"], "zz": ["пра", "во", "ни", "ста"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, text(rng, lang, rng.randint(2, 40)), lang, "a"))
    return rows


def pad(t):
    words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
    return "   " + " ".join(words) + " " if words else ""


class Plain:
    """Interpolated Kneser-Ney with dictionaries, for one language."""

    def __init__(self, texts):
        self.c = {4: collections.Counter(p[k : k + 4] for t in texts for p in [pad(t)] for k in range(len(p) - 3))}
        for n in (3, 2, 1):
            self.c[n] = collections.Counter(g[1:] for g in self.c[n + 1])
        self.d, self.total, self.types = {}, {}, {}
        for n, c in self.c.items():
            once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
            self.d[n] = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            self.total[n], self.types[n] = collections.Counter(), collections.Counter()
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.types[n][g[:-1]] += 1

    def p(self, g):
        n = len(g)
        lower = self.p(g[1:]) if n > 1 else 1 / (self.types[1][""] + 1)
        if g[:-1] not in self.total[n]:
            return lower
        t, k, d = self.total[n][g[:-1]], self.types[n][g[:-1]], self.d[n]
        return max(self.c[n][g] - d, 0) / t + d * k / t * lower

    def bits(self, t):
        p = pad(t)
        return -sum(math.log2(self.p(p[k : k + 4])) for k in range(len(p) - 3)) / (len(p) - 3)


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus(random.Random(2), 150)
    given = table(spark, rows + [(500, "no language", None, "a"), (501, None, "xx", "a"), (502, "12", "yy", "a")])
    return rows, langid.collect_model(langid.learn(given)), given


def test_probabilities_are_those_of_the_plain_model(learned):
    rows, model, _ = learned
    assert model.languages == sorted(SOUNDS)
    plain = [Plain([t for _, t, la, _ in rows if la == lang]) for lang in model.languages]
    rng = random.Random(6)
    texts = [text(rng, rng.choice(list(SOUNDS)), 12) for _ in range(20)] + ["Quite OTHER words, 12 of them!", "ka"]
    got = model.entropies(texts)
    for row, t in zip(got, texts):
        assert np.allclose(row, [m.bits(t) for m in plain], rtol=1e-4, atol=1e-4)
    for lang, m in zip(model.languages, plain):
        some = {g[:3] for g in m.c[4]}
        letters = {g for g in m.c[1]} | {"￿"}
        context = sorted(some)[0]
        assert abs(sum(m.p(context + c) for c in letters) - 1) < 1e-9


def test_held_out_accuracy(spark, learned):
    _, model, _ = learned
    fresh = corpus(random.Random(77), 200)
    got = {r.id: r for r in langid.identify(table(spark, fresh), model).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang, _ in fresh)
    assert right >= 196
    assert all(0 <= r.score <= 1 for r in got.values())


def test_awkward_rows_and_rejection(spark, learned):
    _, model, given = learned
    model = langid.calibrate(model, given)
    rows = AWKWARD + [(1, "ka mo tisel " * 30000, "xx", "a"), (2, "qqqq wwww pppp jjjj hhhh gggg", "xx", "a")]
    got = langid.identify(table(spark, rows), model).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[1].lang_pred == "xx" and by[2].lang_pred == "und" and by[2].rejected
    for i in (1000, 1001, 1002, 1006):
        assert (by[i].lang_pred, by[i].score, by[i].bits) == ("und", 0.0, None)
    open_ = {r.id: r for r in langid.identify(table(spark, rows), model, reject=False).collect()}
    assert open_[2].lang_pred in SOUNDS and open_[2].rejected


def test_limits_come_from_all_rows(spark, learned):
    _, model, _ = learned
    rows = corpus(random.Random(8), 5_000)
    model = langid.calibrate(langid.LanguageModel(model.arrays, {}), table(spark, rows))
    bits = model.entropies([t for _, t, _, _ in rows])
    for k, lang in enumerate(model.languages):
        own = bits[[la == lang for _, _, la, _ in rows], k]
        assert math.isclose(model.limits[lang], own.mean() + 4 * max(own.std(ddof=1), 0.05), rel_tol=1e-9)


def test_no_labels_and_no_rows(spark, learned):
    none = langid.collect_model(langid.learn(table(spark, [])))
    assert none.languages == []
    got = langid.identify(table(spark, AWKWARD), langid.calibrate(none, table(spark, []))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(table(spark, []), learned[1]).collect() == []


def test_every_ngram_has_its_own_place(spark):
    n = 300_000
    seen = spark.range(n).selectExpr("'xx' AS lang", "'p' AS kind", "4 AS size", "id * 7 + (1L << 60) AS key", "-cast(id AS double) AS value")
    rest = [("xx", "g", 1, 0, -1.0)] + [("xx", k, s, 0, -2.0) for k, s in (("g", 2), ("g", 3), ("g", 4), ("p", 1), ("p", 2), ("p", 3))]
    model = langid.collect_model(seen.unionByName(spark.createDataFrame(rest, "lang string, kind string, size int, key bigint, value double")))
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7) + np.uint64(1 << 60)
    found, values = model._find("xx", "p", 4, keys)
    assert found.all() and (values == -np.arange(n, dtype=np.float32)).all()
    assert not model._find("xx", "p", 4, keys + np.uint64(1))[0].any()
