"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage

ORDER = 4
#: Characters that one step works on.
_STEP = 1 << 21
_SPACE = np.uint16(32)


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to the 16-bit code of its lower-case letter; all that is no letter is a space."""
    if _TABLE:
        return _TABLE[0]
    table = np.full(0x110000, _SPACE, np.uint16)
    for code in range(0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if unicodedata.category(c)[0] in "LM":
            low = ord(c.lower()[0])
            table[code] = low if low < 0x10000 else 0xD800 + low % 0x800
    _TABLE.append(table)
    return table


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-case letters with one space between words, three before the first and one at the end."""
    if not text:
        return np.empty(0, np.uint16)
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    codes = codes[keep]
    if len(codes) and codes[-1] == _SPACE:
        codes = codes[:-1]
    if len(codes) and codes[0] == _SPACE:
        codes = codes[1:]
    if not len(codes):
        return codes
    pad = np.full(ORDER - 1, _SPACE, np.uint16)
    return np.concatenate((pad, codes, pad[:1]))


def grams(codes: np.ndarray) -> np.ndarray:
    """All runs of four codes, packed into 64 bits."""
    wide = codes.astype(np.uint64)
    n = len(wide) - ORDER + 1
    found = wide[:n]
    for k in range(1, ORDER):
        found = (found << np.uint64(16)) | wide[k : k + n]
    return found


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def flush(waiting: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                schema=schema)

    waiting: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            codes = letter_codes(text.as_py())
            if len(codes):
                waiting.setdefault(lang, []).append(grams(codes))
                size += len(codes)
            if size >= 4 * _STEP:
                yield from flush(waiting)
                waiting, size = {}, 0
    yield from flush(waiting)


def learn(labelled: DataFrame) -> DataFrame:
    """Model rows ``lang, kind, size, key, value`` from all rows of ``lang, text``.

    Kind "p" has the interpolated probability of each n-gram seen, kind "g" the weight that a
    context gives to the shorter model, both as binary logarithms. The longest n-grams count
    their uses, the shorter ones the characters seen before them (Kneser-Ney); each size has
    one absolute discount, from the numbers of n-grams seen once and twice. `key` is the
    packed n-gram. Rows without language are left out; texts without letters count nothing.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    counts = cut_lineage(
        rows.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    )
    by_size = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        # How many different characters stand before each run: the types one longer, by their end.
        by_size[size] = by_size[size + 1].groupBy(
            "lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * size) - 1)).alias("gram")
        ).agg(F.count("*").alias("c"))
    below = None
    parts = []
    for size in range(1, ORDER + 1):
        table = by_size[size].withColumn("context", F.shiftrightunsigned("gram", 16) if size > 1 else F.lit(0).cast("bigint"))
        once, twice = F.sum((F.col("c") == 1).cast("int")), F.sum((F.col("c") == 2).cast("int"))
        discount = table.groupBy("lang").agg(F.least(F.lit(0.95), F.greatest(
            F.lit(0.1), F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5))).alias("d"))
        contexts = table.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        contexts = contexts.join(F.broadcast(discount), "lang").withColumn("g", F.col("d") * F.col("types") / F.col("total"))
        joined = table.join(contexts, ["lang", "context"])
        if below is None:
            # One more than the types seen: what was never seen shares one place.
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("g") / (F.col("types") + 1)
            parts.append(contexts.select("lang", F.lit("g").alias("kind"), F.lit(1).alias("size"), F.lit(0).cast("bigint").alias("key"), F.log2(F.col("g") / (F.col("types") + 1)).alias("value")))
        else:
            joined = joined.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << 16 * (size - 1)) - 1))).join(below, ["lang", "end"])
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("g") * F.col("q")
            parts.append(contexts.select("lang", F.lit("g").alias("kind"), F.lit(size).alias("size"), F.col("context").alias("key"), F.log2("g").alias("value")))
        known = cut_lineage(joined.select("lang", "gram", p.alias("p")))
        parts.append(known.select("lang", F.lit("p").alias("kind"), F.lit(size).alias("size"), F.col("gram").alias("key"), F.log2("p").alias("value")))
        below = known.select("lang", F.col("gram").alias("end"), F.col("p").alias("q"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


class LanguageModel:
    """Sorted arrays of packed n-grams per language, n-gram size and kind, with their values."""

    def __init__(self, arrays: dict[tuple[str, str, int], tuple[np.ndarray, np.ndarray]], limits: dict[str, float]) -> None:
        self.arrays = arrays
        self.languages = sorted({lang for lang, _, _ in arrays})
        self.limits = limits

    def _find(self, lang: str, kind: str, size: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.arrays[lang, kind, size]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return keys[at] == grams, values[at]

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Binary logarithms for each of the n-grams (rows) in each language (columns)."""
        out = np.empty((len(packed), len(self.languages)), np.float32)
        ends = {size: packed & np.uint64((1 << 16 * size) - 1) for size in range(1, ORDER + 1)}
        before = {size: (packed >> np.uint64(16)) & np.uint64((1 << 16 * (size - 1)) - 1) for size in range(2, ORDER + 1)}
        for k, lang in enumerate(self.languages):
            value = np.full(len(packed), self.arrays[lang, "g", 1][1][0], np.float32)
            for size in range(1, ORDER + 1):
                if size > 1:
                    seen, weight = self._find(lang, "g", size, before[size])
                    value = value + np.where(seen, weight, np.float32(0))
                seen, own = self._find(lang, "p", size, ends[size])
                value = np.where(seen, own, value)
            out[:, k] = value
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Bits per character of each text in each language; NaN for a text without letters."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        waiting, rows, size = [], [], 0

        def flush() -> None:
            if not waiting:
                return
            keys, inverse = np.unique(np.concatenate(waiting), return_inverse=True)
            scores = self.log_probabilities(keys)
            lengths = np.array([len(w) for w in waiting])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for k in range(len(self.languages)):
                out[rows, k] = -np.add.reduceat(scores[:, k][inverse], starts, dtype=np.float64) / lengths

        for row, text in enumerate(texts):
            codes = letter_codes(text)
            if not len(codes):
                continue
            waiting.append(grams(codes))
            rows.append(row)
            size += len(codes)
            if size >= _STEP:
                flush()
                waiting, rows, size = [], [], 0
        flush()
        return out


def collect_model(rows: DataFrame) -> LanguageModel:
    """The model rows as sorted arrays, with every n-gram under its own key.

    A row comes to the driver as 16 bytes and stays as 12: the array's number, the packed
    n-gram and its value. All n-grams are kept, so the model grows with their number.
    """
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel({}, {})
    names = [(lang, kind, size) for lang in languages for kind in "gp" for size in range(1, ORDER + 1)]
    place = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1) * 2 + (F.col("kind") == "p").cast("int")
    place = (place * ORDER + F.col("size") - 1).cast("int")
    table = rows.select(place.alias("place"), "key", F.col("value").cast("float").alias("value")).toArrow()
    places, keys, values = (table[c].to_numpy() for c in ("place", "key", "value"))
    keys = keys.view(np.uint64)
    arrays = {}
    for k, name in enumerate(names):
        mine = np.flatnonzero(places == k)
        mine = mine[np.argsort(keys[mine])]
        arrays[name] = (keys[mine], values[mine])
    return LanguageModel(arrays, {})


def calibrate(model: LanguageModel, labelled: DataFrame, spread: float = 4.0) -> LanguageModel:
    """Set the rejection limit of each language: mean and `spread` deviations of the entropy of all its own texts."""
    if not model.languages:
        return model
    known_rows = labelled.select("lang", "text").filter("lang is not null")
    shared = labelled.sparkSession.sparkContext.broadcast((model.arrays, model.limits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = LanguageModel(*shared.value)
        known = {lang: k for k, lang in enumerate(own_model.languages)}
        for batch in batches:
            bits = own_model.entropies(batch.column("text").to_pylist())
            langs = batch.column("lang").to_pylist()
            own = [float(bits[i, known[lang]]) if lang in known else math.nan for i, lang in enumerate(langs)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(own, pa.float64())], ["lang", "bits"])

    found = known_rows.mapInArrow(run, "lang string, bits double").filter("not isnan(bits)").groupBy("lang").agg(
        F.avg("bits").alias("m"), F.coalesce(F.stddev("bits"), F.lit(0.0)).alias("s")).collect()
    model.limits = {r.lang: r.m + spread * max(r.s, 0.05) for r in found}
    return model


def identify(
    docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", reject: bool = True
) -> DataFrame:
    """``id, lang_pred, score, bits, rejected`` for every row, from the whole text.

    The language is that of the least cross-entropy per character; `score` compares it with
    the other languages (1: far better than all of them). A text whose entropy is above the
    limit of its language is `rejected`, and with `reject` its language is ``und``. Null,
    empty and letterless texts, and all texts under a model without languages, are ``und``
    with score 0. Ties go to the first language in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.arrays, model.limits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel(*shared.value)
        for batch in batches:
            bits = known.entropies(batch.column("text").to_pylist())
            langs, scores, best, out = [], [], [], []
            for row in bits:
                if not len(row) or math.isnan(row[0]):
                    langs.append("und"), scores.append(0.0), best.append(None), out.append(False)
                    continue
                k = int(np.argmin(row))
                lang, least = known.languages[k], float(row[k])
                far = least > known.limits.get(lang, math.inf)
                langs.append("und" if far and reject else lang)
                scores.append(float(1 / np.exp2(-8.0 * (row - least)).sum()))
                best.append(least)
                out.append(far)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(best, pa.float64()),
                 pa.array(out, pa.bool_())], ["id", "lang_pred", "score", "bits", "rejected"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, lang_pred string, score double, bits double, rejected boolean")
