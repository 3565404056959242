"""Toxicity by a weighted lexicon, matched after folding of look-alikes."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.hashing import WordHashes, mix, shingle_hashes
from corpusprep.session import cut_lineage

# Letters of other scripts that look like Latin ones, and what stands for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
# Terms that count without labels, and phrases in which they do not.
BASE_TERMS = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "loser": 2.5, "pathetic": 2.5, "worthless": 2.5}
EXCEPTIONS = ("scum line", "pond scum", "loser bracket", "stupid simple")

_SYMBOLS = frozenset("@$!|")


class _Fold(dict):
    """Character to its folded form: Latin, lower-case, without marks; others than letters and digits are spaces.

    The letter l and what looks like it fall together with i.
    """

    def __missing__(self, code: int) -> str:
        text = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            kind = unicodedata.category(c)
            if kind[0] == "M" or kind == "Cf":
                continue
            c = LOOKALIKES.get(c, c)
            text += c if c.isalnum() or c in _SYMBOLS else " "
        self[code] = text = text.replace("l", "i")
        return text


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at both ends.

    Digits next to letters stand for letters; symbols do so only before a letter, so
    that punctuation at the end of a word goes.
    """
    words = (text or "").translate(_FOLD).split()
    out = []
    for word in words:
        if not word.isalpha() and not word.isdigit():
            word = "".join(_letter(word, k) for k in range(len(word)))
            out += word.split()
        else:
            out.append(word)
    return f" {' '.join(out)} "


def _letter(word: str, k: int) -> str:
    c = word[k]
    if c.isalpha():
        return c
    if c in _SYMBOLS:
        return SUBSTITUTES[c] if any(x.isalpha() for x in word[k + 1 :]) else " "
    near = any(x.isalpha() for x in word[max(0, k - 2) : k + 3])
    return SUBSTITUTES.get(c, c) if near else c


#: Texts that share this many least hashes of three words are taken for copies.
_MINIMA = 3
#: Bits of the filter that picks texts with copies, and copy keys up to which it is used.
_FILTER_BITS = 27
_FILTER_KEYS = 4_000_000


def _copy_key(words: list[str], cache: WordHashes) -> int:
    """Equal for most near copies of a text, and hardly for texts that share a passage."""
    found = shingle_hashes(words, 3, cache)
    if not len(found):
        return 0
    key = np.zeros(1, np.uint64)
    for k in range(_MINIMA):
        key = mix(key ^ (mix(found + np.uint64(k)) if k else found).min())
    return int(key[0] >> np.uint64(1))


_PART = 10_000


def _copy_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        keys = [_copy_key(fold(text).split(), cache) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(keys, pa.int64())], ["toxic", "copy"])


def _slot(copy: np.ndarray) -> np.ndarray:
    return copy >> np.int64(63 - _FILTER_BITS)


def _labelled_words(shared):
    """Texts that may have copies as one row of distinct words each; the words of the others counted per batch.

    `shared` is a broadcast of the bits of copy keys that stand on two rows or more; without it every text is a row.
    """
    schema = pa.schema([("toxic", pa.int32()), ("copy", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows, single = [], {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = fold(text).split()
                copy = _copy_key(words, cache)
                slot = copy >> (63 - _FILTER_BITS)
                if shared is None or shared.value[slot >> 3] >> (slot & 7) & 1:
                    rows.append({"toxic": toxic, "copy": copy, "words": list(dict.fromkeys(words)), "counts": None})
                else:
                    single[toxic].update(set(words))
            for toxic, counter in single.items():
                found, counts = list(counter), list(counter.values())
                for k in range(0, len(found), _PART):
                    rows.append({"toxic": toxic, "copy": None, "words": found[k : k + _PART], "counts": counts[k : k + _PART]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _copied(labelled: DataFrame):
    """A broadcast of bits that stand for the copy keys of two rows or more; None for too many of them."""
    keys = labelled.mapInArrow(_copy_keys, "toxic int, copy bigint").groupBy("toxic", "copy").agg(F.count("*").alias("n"))
    repeated = cut_lineage(keys.filter("n > 1").select("copy"))
    if repeated.count() > _FILTER_KEYS:
        return None
    slots = _slot(repeated.toArrow()["copy"].to_numpy())
    bits = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(bits, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
    return labelled.sparkSession.sparkContext.broadcast(bits)


def learn_lexicon(
    labelled: DataFrame, *, shortest: int = 4, longest: int = 8, evidence: float = 15.0, purity: float = 0.8, max_terms: int = 20_000
) -> tuple[dict[str, float], list[str]]:
    """Weights of terms, and exceptions, from all rows of ``text, toxic``.

    Terms are whole words and starts of words (`shortest` to `longest` letters) whose share of
    toxic texts is high beyond chance: log-likelihood ratio of `evidence` or more, `purity` of
    their uses toxic. A word counts once for all texts of one label that seem copies of each
    other, whichever of them has it. Of starts of one word the longest counts that has the
    uses of the shortest. Words under a term whose uses
    are mostly clean are exceptions. The `max_terms` terms with the best evidence bound the
    lexicon.
    """
    seen = cut_lineage(labelled.mapInArrow(
        _labelled_words(_copied(labelled)), "toxic int, copy bigint, words array<string>, counts array<bigint>"))
    copies = seen.filter("copy is not null").select("toxic", "copy", F.explode("words").alias("word")).distinct()
    single = seen.filter("copy is null").select("toxic", F.inline(F.arrays_zip("words", "counts"))).toDF("toxic", "word", "n")
    uses = copies.select("toxic", "word", F.lit(1).cast("bigint").alias("n")).unionByName(single)
    words = cut_lineage(uses.groupBy("word").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")))
    length = F.length("word")
    starts = F.transform(
        F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.least(length, F.lit(longest)))),
        lambda n: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), n)),
    )
    terms = F.when(length >= shortest, starts).otherwise(F.array().cast("array<string>"))
    counts = words.select(
        "t", "c", F.explode(F.array_union(terms, F.array(F.concat(F.lit(" "), "word", F.lit(" "))))).alias("term")
    ).groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t > 0 and length(term) > 3")
    totals = words.agg(F.sum("t"), F.sum("c")).first()
    all_t, all_c = (float(x or 0) for x in totals)
    if not all_t or not all_c:
        return {}, []
    base = all_t / (all_t + all_c)
    n = F.col("t") + F.col("c")
    part = F.col("t") / n
    ratio = 2 * (F.col("t") * F.log(part / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - part) / (1 - base))).otherwise(0.0))
    chosen = counts.withColumn("g", ratio).filter((F.col("g") >= evidence) & (part >= purity))
    best = chosen.orderBy(F.desc("g"), "term").limit(max_terms).collect()
    found = {r.term: math.log((r.t + 0.5) / (all_t + 1)) - math.log((r.c + 0.5) / (all_c + 1)) for r in best}
    uses = {r.term: r.t for r in best}
    first = [t for t in found if not any(t[:k] in found for k in range(shortest + 1, len(t)))]
    # The longest start that loses next to no use of the shortest one meets fewer other words.
    starts = [t for t in found if not t.endswith(" ")]
    longer = [max((u for u in starts if u.startswith(t) and uses[u] >= 0.98 * uses[t]), key=len, default=t) for t in first]
    kept = {t: found[t] for t in longer}
    if not kept:
        return {}, []
    short = {t.strip() for t in kept if not t.endswith(" ")}
    under = F.lit(False)
    for size in sorted({len(t) for t in short}):
        under = under | F.substring("word", 1, size).isin([t for t in short if len(t) == size])
    clean = words.filter(under).filter("c >= 3 and t < 0.2 * (t + c)").orderBy(F.desc("c"), "word").limit(max_terms)
    return kept, [r.word for r in clean.collect()]


class Matcher:
    """Weighted hits of a lexicon in a text; a hit inside an exception phrase does not count."""

    def __init__(self, terms: dict[str, float], exceptions: Sequence[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            folded = fold(phrase)
            self.automaton.add_word(folded, (len(folded), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[float, int, int]:
        """Sum of the weights of distinct and repeated hits, number of hits, number of words."""
        folded = fold(text)
        if not len(self.automaton):
            return 0.0, 0, folded.count(" ") - 1
        hits, spared = [], []
        for end, (length, weight) in self.automaton.iter(folded):
            if weight is None:
                spared.append((end - length + 1, end))
            else:
                hits.append((end - length + 1, end, weight))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        return sum(h[2] for h in hits), len(hits), max(0, folded.count(" ") - 1)


def features(weight: float, hits: int, words: int) -> list[float]:
    return [1.0, float(hits > 0), math.log1p(weight), math.log1p(1000 * weight / max(words, 1)) / 5]


def _fit(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton steps."""
    w = np.zeros(rows.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - labels) + 0.05 * w
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 0.05 * np.eye(rows.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Used where there are no labels to calibrate with.
_PLAIN = (-5.0, 3.0, 1.5, 0.5)


class ToxicityModel:
    """A lexicon with the calibration of its scores."""

    def __init__(self, terms: dict[str, float], exceptions: Sequence[str], weights: Sequence[float]) -> None:
        self.terms, self.exceptions, self.weights = terms, list(exceptions), list(weights)

    def scorer(self):
        matcher = Matcher(self.terms, self.exceptions)

        def score(text: str | None) -> tuple[float, int]:
            weight, hits, words = matcher(text)
            z = sum(a * b for a, b in zip(self.weights, features(max(0.0, weight), hits, words)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits

        return score


def learn(
    labelled: DataFrame, *, base_terms: dict[str, float] = BASE_TERMS, exceptions: Sequence[str] = EXCEPTIONS, fit_rows: int = 20_000, **options
) -> ToxicityModel:
    """A model from ``text, toxic`` rows; rows without a label are left out.

    The lexicon uses all rows. Only its four calibration weights are fitted on a sample of
    `fit_rows` rows. Without labels of both kinds the base terms and plain weights are used.
    """
    labelled = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    terms, clean = learn_lexicon(labelled, **options)
    known = {f" {fold(t).strip()} ": w for t, w in base_terms.items()}
    terms = {t: w for t, w in known.items() if not any(t[:k] in terms for k in range(3, len(t)))} | terms
    spared = [*exceptions, *clean]
    matcher = Matcher(terms, spared)

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [matcher(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), batch.column("toxic")], ["w", "h", "n", "toxic"])

    total = labelled.count()
    sample = labelled if total <= fit_rows else labelled.sample(fraction=fit_rows / total, seed=5)
    found = sample.mapInArrow(points, "w double, h bigint, n bigint, toxic int").collect()
    labels = np.array([r.toxic for r in found], float)
    if not terms or labels.size == 0 or labels.min() == labels.max():
        return ToxicityModel(terms, spared, _PLAIN)
    rows = np.array([features(max(0.0, r.w), r.h, r.n) for r in found])
    return ToxicityModel(terms, spared, _fit(rows, labels))


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, hits`` for every row; a null or empty text gets the score of a text without hits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            rows = [scorer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())],
                ["id", "score", "hits"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, score double, hits bigint")


def clean_documents(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below the threshold."""

    @F.pandas_udf("double")
    def scored(texts):
        scorer = scored_by(model)
        return texts.map(lambda t: scorer(t)[0])

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) < threshold)


_SCORERS: dict[int, object] = {}


def scored_by(model: ToxicityModel):
    """The scorer of a model, built once in each Python worker."""
    key = hash((tuple(model.terms.items()), tuple(model.exceptions), tuple(model.weights)))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = model.scorer()
    return _SCORERS[key]
