from __future__ import annotations

import random

import pytest

from corpusprep.llm import toxicity
from tests.llm.helpers import AWKWARD, table, words

BAD = ["grumblat", "zorkish", "vexilor"]


def corpus(rng, n):
    rows = []
    for i in range(n):
        body, toxic = words(rng, rng.randint(5, 60)), rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                body.insert(rng.randint(0, len(body)), rng.choice(BAD) + rng.choice(["", "en", "ous", "er"]))
        elif rng.random() < 0.02:
            body.append("vexilorium")
        rows.append((i, " ".join(body), int(toxic)))
    return rows


def test_fold():
    assert toxicity.fold("L0ser, IDI0T! ｍｏｒоn 1t's 2024 a-b") == " ioser idiot moron it s 2024 a b "
    assert toxicity.fold("Sch$n p@thetic re​al é") == " schsn pathetic reai e "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(random.Random(1), 800) + [(9000, None, 0), (9001, "", 1), (9002, "unlabelled", None)]
    return toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))


def test_learned_terms_and_exceptions(model):
    for word in BAD:
        assert any(toxicity.fold(word)[:-1].startswith(t.rstrip()) for t in model.terms)
    assert any("vexiiorium" in e for e in model.exceptions)


def test_held_out_accuracy(spark, model):
    fresh = corpus(random.Random(50), 300)
    given = table(spark, [(i, t, "en", "a") for i, t, _ in fresh])
    got = {r.id: r.score for r in toxicity.score(given, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in fresh) >= 296
    kept = {r.doc_id for r in toxicity.clean_documents(given, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}


def test_matches_are_those_of_a_plain_search(model):
    matcher = toxicity.Matcher(model.terms, ["zorkish delight"])
    rng = random.Random(4)
    for _ in range(50):
        text = " ".join(rng.choice([*BAD, "Z0RK1SH", "zorkish delight", "plain", "vex1lorous"]) for _ in range(12))
        folded = toxicity.fold(text)
        phrase = toxicity.fold("zorkish delight")
        spared = [k for k in range(len(folded)) if folded.startswith(phrase, k)]
        total = hits = 0
        for term, weight in model.terms.items():
            for k in range(len(folded)):
                if folded.startswith(term, k) and not any(s <= k and k + len(term) <= s + len(phrase) for s in spared):
                    total, hits = total + weight, hits + 1
        found = matcher(text)
        assert found[1] == hits and abs(found[0] - total) < 1e-9


def test_disguises_and_long_texts_are_caught(spark, model):
    rows = [(1, "wоrds and Ｇrumbl@t", "en", "a"), (2, "plain " * 30000 + "z0rk1sh", "en", "a"), (3, "plain " * 30000, "en", "a")]
    got = {r.id: r.score for r in toxicity.score(table(spark, rows + AWKWARD), model).collect() if r.id is not None}
    assert got[1] > 0.5 > got[3]
    assert got[2] > got[3]
    assert got[1000] == got[1001] == got[1002] < 0.5
    assert toxicity.score(table(spark, rows + AWKWARD), model).count() == 13


def test_without_labels(spark):
    empty = spark.createDataFrame([], "text string, toxic int")
    plain = toxicity.learn(empty)
    rows = [(1, "you stupid IDI0T", "en", "a"), (2, "a pond scum photograph", "en", "a"), (3, "nice", "en", "a")]
    got = {r.id: r.score for r in toxicity.score(table(spark, rows), plain).collect()}
    assert got[1] > 0.5 > got[2] == got[3]
    assert toxicity.score(table(spark, []), plain).collect() == []
    one_kind = toxicity.learn(spark.createDataFrame([("fine words", 0)] * 5, "text string, toxic int"))
    assert one_kind.weights == list(toxicity._PLAIN)


def test_words_of_every_copy_count_once(spark):
    rng = random.Random(3)
    passage, own = " ".join(words(rng, 300)), ["".join(rng.choice("qrstuvwxyz") for _ in range(9)) for _ in range(40)]
    rows = [(f"{passage} {w} blortish", 1) for w in own] + [(f"{' '.join(words(rng, 30))} plainest", 0) for _ in range(20)]
    rows += [(f"{passage} scarcely", 0)] * 30 + [("common words plainest", 0)]
    terms, _ = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), evidence=0.0, purity=0.5)
    assert all(any(toxicity.fold(w).startswith(t) for t in terms) for w in own)
    few, _ = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), purity=0.5)
    assert not any(" scarceiy ".startswith(t) for t in few)


def test_texts_that_share_a_passage_are_no_copies():
    rng = random.Random(6)
    passage, cache = words(rng, 60), toxicity.WordHashes()
    keys = {toxicity._copy_key(passage + words(rng, 60), cache) for _ in range(200)}
    assert len(keys) > 150
    base = words(rng, 300)
    changed = [base[:k] + ["other"] + base[k + 1 :] for k in range(0, 300, 3)]
    assert sum(toxicity._copy_key(w, cache) == toxicity._copy_key(base, cache) for w in changed) > 85
