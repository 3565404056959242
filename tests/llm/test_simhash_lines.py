from __future__ import annotations

import collections
import random

import numpy as np
import pytest
import xxhash

from corpusprep.llm import lines, simhash_lines
from tests.llm.helpers import AWKWARD, edited, table, words
from tests.llm.test_lines import components, corpus, distance

M = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_simhash(ws):
    """The four parts as numbers; bits of a byte and bytes of a part stand as they are stored."""
    parts = []
    for k in range(4):
        hashes = [mixed((xxhash.xxh3_64_intdigest(w) + k * 0x9E3779B97F4A7C15) & M) for w in ws]
        part = 0
        for byte in range(8):
            for bit in range(8):
                if 2 * sum(h >> (8 * byte + bit) & 1 for h in hashes) > len(ws):
                    part |= 1 << (8 * byte + bit)
        parts.append(part)
    return parts


def linked(a, b, s, t, percent=80):
    longest = max(len(a), len(b))
    if sum((x ^ y).bit_count() for x, y in zip(s[:2], t[:2])) > simhash_lines.DISTANCE:
        return False
    blocks = [(x >> 21 * k ^ y >> 21 * k) & 0x1FFFFF for x, y in zip(s, t) for k in range(3)]
    return 0 in blocks and distance(a, b) <= longest * (100 - percent) // 100


def brute(rows):
    places = []
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            places.append((i, k, tuple(lines.line_words(line))))
    distinct = sorted({p[2] for p in places if p[2]})
    sims = {ws: plain_simhash(ws) for ws in distinct}
    root = components([(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if linked(a, b, sims[a], sims[b])])
    groups = collections.defaultdict(list)
    for i, k, ws in places:
        if ws:
            groups[root(ws)].append((i is None, i or 0, k))
    out = []
    for i, k, ws in places:
        own = groups[root(ws)] if ws else [(i is None, i or 0, k)]
        none, keep, at = min(own)
        keep = None if none else keep
        out.append((i, k, len(ws), keep, at, len(own), (i, k) == (keep, at)))
    return sorted(map(str, out))


def test_simhash_of_short_and_long_lines():
    rng = random.Random(1)
    many = [words(rng, n) for n in (1, 2, 7, 50, 255, 256, 700)]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for ws in many for w in ws], np.uint64)
    got = simhash_lines.simhashes(hashes, np.array([len(ws) for ws in many]))
    # A byte's bits are counted from its highest one, as it is stored.
    assert [[int(x) for x in row] for row in got] == [plain_simhash(ws) for ws in many]


@pytest.mark.parametrize("line", [
    "", "  ", "Plain words, here.", "a1b2 c_d 007", "caf\u00e9 \u00c9t\u00e9_3 na\u00efve", "\u4f60\u597d world", "x\u00b2 \u0664\u0665 \u0130stanbul", "tab\tand\x1fseparator",
])
def test_words_of_a_line(line):
    cache = simhash_lines._Words()
    got = [cache[w] for w in simhash_lines.split_words(line.lower())]
    assert got == [xxhash.xxh3_64_intdigest(w) for w in lines.line_words(line)]


@pytest.mark.parametrize("bucket", [simhash_lines.BUCKET, 2])
def test_against_brute_force(spark, bucket):
    rows = corpus()
    got = simhash_lines.fuzzy_lines(table(spark, rows), bucket=bucket).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert sum(r.group_size > 1 and not r.kept for r in got) > 40


def test_a_large_group_of_variants_is_one_group(spark):
    rng = random.Random(3)
    base = words(rng, 60)
    rows = [(i, " ".join(edited(rng, base, 1)), "en", "a") for i in range(700)]
    got = simhash_lines.fuzzy_lines(table(spark, rows), bucket=64).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 700)}
    assert sum(r.kept for r in got) == 1


def test_recall_of_pairs_at_high_similarity(spark):
    """Of pairs of lines with at most one word in twenty changed, nine of ten or more are linked."""
    rng = random.Random(9)
    rows = []
    for k in range(600):
        n = rng.randint(20, 120)
        base = words(rng, n)
        rows += [(2 * k, " ".join(base), "en", "a"), (2 * k + 1, " ".join(edited(rng, base, rng.randint(1, n // 20))), "en", "a")]
    got = simhash_lines.fuzzy_lines(table(spark, rows)).collect()
    assert all(r.keep_id // 2 == r.id // 2 for r in got)
    assert sum(not r.kept for r in got) >= 0.9 * 600


def test_texts_without_duplicate_lines(spark):
    rows = [(1, "Same line here\nown one", "en", "a"), (2, "same LINE, here\n\nown two", "en", "a"), (3, None, "en", "a"), (4, "same line here!", "en", "a")]
    given = table(spark, rows)
    kept = simhash_lines.drop_fuzzy_lines(given)
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "Same line here\nown one", 2: "\nown two", 3: None, 4: ""}
    assert kept.columns == given.columns


def test_empty_and_awkward_tables(spark):
    assert simhash_lines.fuzzy_lines(table(spark, [])).collect() == []
    got = simhash_lines.fuzzy_lines(table(spark, AWKWARD)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(AWKWARD)


def test_words_of_many_lines_at_once():
    rng = random.Random(5)
    letters = "ab cZ1_\n\n \x1f\t.,-'²٤٥éİΣ你好\U0001d7d9\U00010400ͅ­９"
    cache = simhash_lines._Words()
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        found, places, lengths = simhash_lines._split(text.lower())
        want = [lines.line_words(line) for line in text.split("\n")]
        assert list(lengths) == [len(ws) for ws in want]
        assert [cache[found[k]] for k in places] == [xxhash.xxh3_64_intdigest(w) for ws in want for w in ws]


def test_unlike_lines_of_common_words_are_not_verified(spark, monkeypatch):
    """SimHashes of lines that share most of their words are near, whatever the order; the words' counts tell them apart."""
    rng = random.Random(11)
    common = words(rng, 36)
    rows = [(k, " ".join(rng.sample(line := common + words(rng, 24), len(line))), "en", "a") for k in range(400)]
    verified = []

    def counted(pairs, *args):
        verified.append(pairs.count())
        return lines._verified(pairs, *args)

    monkeypatch.setattr(simhash_lines, "_verified", counted)
    got = simhash_lines.fuzzy_lines(table(spark, rows)).collect()
    assert all(r.kept for r in got)
    assert sum(verified) < 20
