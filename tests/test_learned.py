"""The queries over a learned vocabulary against plain learning, encoding and packing in Python.

bpe_merges_corpus, encode_bpe_corpus, sft_blocks_bpe, lm_windows_bpe and exact_steps_bpe have no SQL.
Their inputs (lines, fields, messages, examples, paragraphs) come from operators that have.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusprep import plans
from corpusprep.functions import text as T
from corpusprep.functions.tokens import FIRST_LEARNED, MARKER_IDS, WORD_PATTERN
from corpusprep.plans import packing, tokens
from corpusprep.plans.fixtures import dirty
from corpusprep.plans.records import _examples
from corpusprep.plans.registry import Tables
from corpusprep.sources.text import split_paragraphs

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="tables not present")
MERGES = tokens.CORPUS_MERGES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A part of the smallest tables, so that the plain versions end in time."""
    place = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "conversations", "labels", "benchmark", "pages"):
        table = spark.read.parquet(f"{TABLES}/{name}.parquet")
        first = table.columns[0]
        table.orderBy(first).limit(40).coalesce(1).write.parquet(f"{place}/{name}.parquet")
    return place


def normal(text):
    return re.sub(" {2,}", " ", text).strip(" ").replace(" ", "▁")


def words_of(text):
    return [w for line in re.split("\r\n|\r|\n", text) for w in re.findall(WORD_PATTERN, normal(line))]


def learn(counts, n_merges, max_piece=16):
    """Pieces by rank: one best pair at a time, pair counts kept up by recounting the words that held it."""
    words = {w: list(w) for w in counts}
    pairs, where = Counter(), defaultdict(set)
    for w, s in words.items():
        for p in zip(s, s[1:]):
            pairs[p] += counts[w]
            where[p].add(w)

    merges = []
    # Pieces that are spelled alike but merged at different times are different symbols.
    name = {}
    while len(merges) < n_merges:
        open_ = [(p, n) for p, n in pairs.items() if n > 0 and len(name.get(p[0], p[0])) + len(name.get(p[1], p[1])) <= max_piece]
        if not open_:
            break

        def order(item):
            (a, b), n = item
            a, b = (x if isinstance(x, int) else ord(x) for x in (a, b))
            return -n, max(a, b), a, b

        (a, b), n = min(open_, key=order)
        new = 0x110000 + len(merges)
        name[new] = name.get(a, a) + name.get(b, b)
        merges.append((name.get(a, a), name.get(b, b), n))
        for w in where.pop((a, b)):
            s, out, k = words[w], [], 0
            for p in zip(s, s[1:]):
                pairs[p] -= counts[w]
            while k < len(s):
                if s[k : k + 2] == [a, b]:
                    out.append(new)
                    k += 2
                else:
                    out.append(s[k])
                    k += 1
            words[w] = out
            for p in zip(out, out[1:]):
                pairs[p] += counts[w]
                where[p].add(w)
    return merges


def encoder(counts, merges):
    chars = Counter()
    for w, n in counts.items():
        for c in w:
            chars[c] += n
    pieces = list(dict.fromkeys(a + b for a, b, _ in merges)) + sorted(chars, key=lambda c: (-chars[c], c))
    ids = {p: FIRST_LEARNED + k for k, p in enumerate(pieces)}

    def word(w):
        parts = list(w)
        while True:
            best = min(((ids[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [i for p in parts for i in ([ids[p]] if p in ids else [8 + b for b in p.encode()])]

    def text(t):
        out = [1]
        for part in re.split("(" + "|".join(map(re.escape, MARKER_IDS)) + ")", normal(t)):
            out += [MARKER_IDS[part]] if part in MARKER_IDS else [i for w in re.findall(WORD_PATTERN, part) for i in word(w)]
        return [*out, 2]

    return text


@pytest.fixture(scope="module")
def plain(spark, folder):
    corpus = tokens.merged_corpus(Tables(spark, folder))
    counts = Counter(w for r in corpus.collect() for w in words_of(r.text))
    merges = learn(counts, MERGES)
    return merges, encoder(counts, merges)


def cleaned(df, column):
    """The rows with the text as the encoder sees it."""
    return df.withColumn("seen", T.strip_fences_and_controls(F.col(column))).collect()


def md5(values):
    return hashlib.md5(" ".join(map(str, values)).encode()).hexdigest()


def test_bpe_merges_corpus(spark, folder, plain):
    got = plans.QUERIES["bpe_merges_corpus"](spark, folder).orderBy("rank").collect()
    assert len(got) == MERGES
    assert [(r.left, r.right, r.n) for r in got] == plain[0]


def test_encode_bpe_corpus(spark, folder, plain):
    got = {r.doc_id: (r.n_tokens, r.ids) for r in plans.QUERIES["encode_bpe_corpus"](spark, folder).collect()}
    docs = cleaned(spark.read.parquet(f"{folder}/documents.parquet"), "text")
    want = {r.doc_id: plain[1](r.seen) for r in docs}
    assert got == {k: (len(v), " ".join(map(str, v))) for k, v in want.items()}


def test_sft_blocks_bpe_and_exact_steps_bpe(spark, folder, plain):
    rows = sorted(cleaned(_examples(Tables(spark, folder))[0], "example"), key=lambda r: r.line_no)
    stream = [i for r in rows for i in plain[1](r.seen)]
    size, batch = packing.BLOCK, packing.BATCH
    want = [(k, k // batch, md5(stream[k * size : (k + 1) * size]), md5(stream[k * size + 1 : (k + 1) * size + 1])) for k in range((len(stream) - 1) // size)]
    got = sorted(tuple(r) for r in plans.QUERIES["sft_blocks_bpe"](spark, folder).select("block_id", "batch_id", "x", "y").collect())
    assert got == want and want
    steps = plans.QUERIES["exact_steps_bpe"](spark, folder).first()
    windows = max(0, len(stream) - 64 - 1)
    assert (steps.tokens, steps.windows, steps.batches, steps.steps) == (len(stream), windows, windows // 4, max(1, windows // 4 * 2))


def test_lm_windows_bpe(spark, folder, plain):
    t = Tables(spark, folder)
    parts = split_paragraphs(dirty(t).select("doc_id", T.clean_text(F.col("text")).alias("text")), "text")
    rows = sorted(cleaned(parts, "text"), key=lambda r: (r.doc_id, r.paragraph_no))
    stream = [i for r in rows for i in plain[1](r.seen)]
    width, batch = packing.WINDOW, packing.BATCH
    starts = range(len(stream) - width - 1)
    order = sorted(starts, key=lambda s: hashlib.md5(f"{packing.SEED}:{s}".encode()).hexdigest())
    full = len(order) // batch * batch
    parts = defaultdict(lambda: [0, 0])
    for place, s in enumerate(order[:full]):
        x, y = (" ".join(map(str, stream[s + d : s + d + width])) for d in (0, 1))
        digest = hashlib.md5(f"{place // batch}:{s}:{x}|{y}".encode()).hexdigest()
        part = parts[place // batch // 64]
        part[0] += 1
        part[1] ^= int(digest[:15], 16)
    got = {r.part: [r.windows, r.digest] for r in plans.QUERIES["lm_windows_bpe"](spark, folder).collect()}
    assert got == dict(parts) and got
