from __future__ import annotations

import random

from corpusprep.llm import quotes
from tests.llm.helpers import words

SCHEMA = "id bigint, text string, level int, owner string, passages string"


def messages(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def test_levels():
    text = "Hi\r\n> one\n>> two\n> > two more\n  > back\nOn Monday A. wrote:\n5 > 3"
    assert quotes.quote_levels(text) == [(0, "Hi"), (1, "one"), (2, "two"), (2, "two more"), (1, "back"), (0, "5 > 3")]
    assert quotes.passages(quotes.quote_levels("A  b\nc\n\nd\n> E\n>\n> f")) == [(0, "a b c"), (0, "d"), (1, "e"), (1, "f")]
    assert quotes.own_text(quotes.quote_levels("a\n> q\n\n\n\nb  \n")) == "a\n\nb"


def quote(text):
    return "\n".join("> " + line for line in text.split("\n"))


def test_against_known_trees(spark):
    rng = random.Random(3)
    own, full, parent = {}, {}, {}
    for i in range(200):
        own[i] = " ".join(words(rng, rng.randint(5, 30)))
        if i and rng.random() < 0.85:
            parent[i] = rng.choice([0, rng.randrange(i)])
            quoted = full[parent[i]].upper().replace(" ", "  ", 3)
            full[i] = own[i] + "\n\nSomebody wrote:\n" + quote(quoted) if i % 2 else quote(quoted) + "\n\n" + own[i]
        else:
            full[i] = own[i]
    chain = [(1000 + k, f"message number {k} of the long chain" + (f"\n> message number {k - 1} of the long chain" if k else "")) for k in range(70)]
    got = {r.id: r for r in quotes.link_quotes(messages(spark, list(full.items()) + chain)).collect()}
    assert len(got) == 270
    for i in own:
        path = [i]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        assert (got[i].parent_id, got[i].thread_id, got[i].depth, got[i].own_text) == (parent.get(i), path[-1], len(path) - 1, own[i])
    assert got[1069].depth == 69 and got[1069].thread_id == 1000


def test_awkward_messages(spark):
    rows = [
        (1, None), (2, ""), (3, "> quoted from a mail that nobody has"), (4, "the very same words again"),
        (5, "the very same words again"), (6, "> the very same words again\nyes"), (7, "> > the very same words again\n> no mail has this line\nno"),
        (None, "> the very same words again"), (8, "> short one\nx"), (9, "short one"), (10, "first row of mail ten"), (10, "> the very same words again"),
        (0, "> the very same words again\nbefore the original"),
    ]
    got = quotes.link_quotes(messages(spark, rows)).collect()
    assert len(got) == 12
    by = {r.id: r for r in got}
    assert [by[i].parent_id for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [None, None, None, None, None, None, 4, 4, None, None, 4]
    assert by[None].thread_id is None and by[1].own_text == "" and by[7].n_quotes == 2 and by[7].n_linked == 1
    order = [(r.thread_id, r.depth, r.id) for r in quotes.conversations(quotes.link_quotes(messages(spark, rows))).collect()]
    assert [x for x in order if x[0] == 4] == [(4, 0, 4), (4, 1, 6), (4, 1, 7), (4, 1, 10)]


def test_empty_table(spark):
    assert quotes.link_quotes(messages(spark, [])).collect() == []


def test_trimmed_and_interleaved_quotes(spark):
    first = "The first point is about the budget. It was never agreed by anyone here.\nthe second line has a thought of its own\nand the third line asks who pays for it"
    other = "some message about quite other things\nand the third line asks who pays for it"
    rows = [
        (1, first), (2, other), (3, "> the second line has a thought of its own\n\nI do not think so at all"),
        (4, "> It was never agreed by anyone here.\n\nYes it was"),
        (5, "> the second line has a thought of its own\nmy answer stands between the lines\n> and the third line asks who pays for it\nnot me"),
        (6, "> quite unknown words that nobody ever wrote\n\nhm"),
        (7, "> some message about quite other things\n> [...]\n\nreply to the other"),
    ]
    given = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.id: (r.parent_id, r.thread_id, r.n_linked) for r in quotes.link_quotes(given).collect()}
    assert got == {1: (None, 1, 0), 2: (None, 2, 0), 3: (1, 1, 1), 4: (1, 1, 1), 5: (1, 1, 2), 6: (None, 6, 0), 7: (2, 2, 1)}
