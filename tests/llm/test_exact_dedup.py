from __future__ import annotations

import collections
import hashlib
import random

import pytest

from corpusprep.llm.exact_dedup import exact_dedup
from tests.llm.helpers import AWKWARD, table, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("buckets", [1, 7])
def test_groups_equal_texts(spark, keep, buckets):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randint(1, 30))) for _ in range(40)]
    long = "same lead of thirty-two characters and " * 3000
    rows = [(i, rng.choice([str.upper, str])(rng.choice(texts)), "en", "a") for i in range(150)]
    rows += [(200 + i, "HOT copy É", "en", "a") for i in range(120)]
    rows += [(400, long + "x", "en", "a"), (401, long + "y", "en", "a"), (402, long + "X", "en", "a")] + AWKWARD
    got = exact_dedup(table(spark, rows), keep=keep, buckets=buckets, sample_per_bucket=50).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    pick = min if keep == "smallest" else max
    want = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        want[hashlib.sha256(t.encode()).hexdigest()] = (pick(known) if known else None, len(ids))
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.digest]
    assert collections.Counter(r.digest for r in got if r.kept) == collections.Counter(list(want))
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_empty_table(spark):
    assert exact_dedup(table(spark, [])).collect() == []
