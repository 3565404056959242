from __future__ import annotations

import collections
import random

import numpy as np
import pyarrow as pa

from corpusprep.llm import lines
from corpusprep.llm.hashing import WordHashes, mix, word_hashes
from tests.llm.helpers import AWKWARD, edited, table, words
from tests.llm.test_minhash import components


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def sim(ws):
    hashes = mix(word_hashes(ws, WordHashes()))
    return int(lines.simhashes(hashes, np.array([0]), np.array([len(ws)]))[0])


def plain_simhash(ws):
    total = 0
    hashes = [int(h) for h in mix(word_hashes(ws, WordHashes()))]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    out = np.zeros(8, np.uint8)
    for byte in range(8):
        for bit in range(8):
            ones = sum(int(r[byte]) >> (7 - bit) & 1 for r in raw)
            if 2 * ones > len(hashes):
                out[byte] |= 1 << (7 - bit)
    total = int(out.view(np.uint64)[0])
    return total


def brute(rows):
    places, texts = [], {}
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            ws = tuple(lines.line_words(line))
            places.append((i, k, ws))
    distinct = sorted({p[2] for p in places if p[2]})
    sims = {ws: sim(list(ws)) for ws in distinct}
    links = []
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            longest = max(len(a), len(b))
            if (sims[a] ^ sims[b]).bit_count() <= lines.DISTANCE and distance(a, b) <= longest * 20 // 100:
                links.append((a, b))
    root = components(links)
    groups = collections.defaultdict(list)
    for i, k, ws in places:
        if ws:
            groups[root(ws)].append((i is None, i or 0, k))
    out = []
    for i, k, ws in places:
        if not ws:
            out.append((i, k, 0, i, k, 1, True))
            continue
        own = groups[root(ws)]
        none, keep, at = min(own)
        keep = None if none else keep
        out.append((i, k, len(ws), keep, at, len(own), (i, k) == (keep, at)))
    return sorted(map(str, out))


def corpus():
    rng = random.Random(12)
    bases = [words(rng, n) for n in (1, 3, 12, 40, 120, 300)]
    rows = []
    for i in range(60):
        made = []
        for _ in range(rng.randint(0, 6)):
            base = rng.choice(bases)
            line = " ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, len(base) // 20]) if len(base) > 4 else 0))
            made.append(rng.choice([line, line.upper(), line + "!", ""]))
        rows.append((i, "\n".join(made), "en", "a"))
    return rows + AWKWARD + [(700, " ".join(words(rng, 15000)), "en", "a"), (701, "Page 12 of 40\nPage 13 of 41\n---", "en", "a")]


def test_simhash():
    rng = random.Random(1)
    for n in (1, 2, 7, 50):
        ws = words(rng, n)
        assert sim(ws) == plain_simhash(ws)


def test_against_brute_force(spark):
    rows = corpus()
    got = lines.fuzzy_lines(table(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert sum(r.group_size > 1 and not r.kept for r in got) > 40


def test_texts_without_duplicate_lines(spark):
    rows = [(1, "Same line here\nown one", "en", "a"), (2, "same LINE, here\n\nown two", "en", "a"), (3, None, "en", "a"), (4, "same line here!", "en", "a")]
    given = table(spark, rows)
    got = {r.doc_id: r.text for r in lines.drop_duplicate_lines(given).collect()}
    assert got == {1: "Same line here\nown one", 2: "\nown two", 3: None, 4: ""}
    assert lines.drop_duplicate_lines(given).columns == given.columns


def test_empty_table(spark):
    assert lines.fuzzy_lines(table(spark, [])).collect() == []


def test_every_pair_within_the_edits_is_linked(spark):
    rng = random.Random(5)
    rows = [r for r in corpus() if len(r[1] or "") < 300]
    for k, n in enumerate([4, 5, 6, 7, 9, 10, 11, 14, 15, 20, 29, 40, 63]):
        base = words(rng, n)
        most = edited(rng, base, n // 5)
        shorter = [w for i, w in enumerate(base) if i not in rng.sample(range(n), n // 5)]
        rows += [(2000 + 3 * k + i, " ".join(w), "en", "a") for i, w in enumerate((base, most, shorter))]
    got = lines.similar_lines(table(spark, rows)).collect()
    links_by_similarity_alone = brute_by_similarity(rows)
    assert sorted(str(tuple(r)) for r in got) == links_by_similarity_alone
    by_id = {r.id: r for r in got if r.id and r.id >= 2000 and r.line_no == 0}
    assert all(not by_id[2000 + 3 * k + 1].kept for k in range(1, 13))


def brute_by_similarity(rows):
    """The brute force with no bound on SimHashes."""
    law, lines.DISTANCE = lines.DISTANCE, 64
    try:
        return brute(rows)
    finally:
        lines.DISTANCE = law


def test_keys_meet_for_any_ranks():
    rng = random.Random(8)
    cache = WordHashes()
    all_ranks = [np.random.default_rng(k).integers(0, 256, 1 << 21).astype(np.uint8) for k in range(4)]
    for _ in range(4000):
        percent = rng.choice([50, 70, 80, 80, 90])
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz" if rng.random() < 0.9 else "ab") for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) * (100 - percent) // 100))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice("ABCabc")] * rng.randint(0, 1)
        if a == b or not b or distance(a, b) > max(len(a), len(b)) * (100 - percent) // 100:
            continue
        hashes = mix(np.concatenate([word_hashes(w, cache) for w in (a, b)]))
        ranks = rng.choice(all_ranks)
        own, keys = lines.line_keys(hashes, np.array([len(a), len(b)]), ranks, percent)
        assert set(keys[own == 0]) & set(keys[own == 1]), (a, b, percent)


def test_keys_of_two_lines_in_batches_of_any_size():
    rng = random.Random(4)
    for _ in range(200):
        rows = sorted((rng.randint(0, 12), rng.randint(0, 3)) for _ in range(rng.randint(0, 40)))
        cuts = [0, *sorted(rng.randint(0, len(rows)) for _ in range(4)), len(rows)]
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], ["key", "h1"])
            for a, b in zip(cuts, cuts[1:])
        ]
        got = [tuple(r.values()) for b in lines._met(batches) for r in b.to_pylist()]
        assert got == [r for r in sorted(set(rows)) if len({h for k, h in rows if k == r[0]}) > 1]
