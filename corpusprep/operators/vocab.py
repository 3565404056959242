"""Byte-pair vocabularies: reserved pieces, counts, and learning merges.

The working form of a word is a string of symbol ids, ``,12;,7;``. A symbol is a
code point, or FIRST_MERGE + rank for a merged pair, so an older symbol has the
smaller id. Merging a pair is then a plain string replacement, left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.chat import MARKERS
from corpusprep.functions.text import ANY_NEWLINE
from corpusprep.functions.tokens import (
    BOS, EOS, FIRST_BYTE, FIRST_LEARNED, FIRST_MARKER, SPACE_MARK, UNK, spaced,
)
from corpusprep.operators import merges
from corpusprep.operators.merges import FIRST_MERGE
from corpusprep.session import cut_lineage, local_frame

# Fixed value: the longest piece, in characters.
MAX_PIECE = 16
# Pairs fetched per round; a round merges a leading run of them.
_FETCH = 256
# Rounds between two checkpoints; bounds what a lost executor has to redo.
_ROUNDS_PER_CHECKPOINT = 8

VOCAB_SCHEMA = "id int, piece string, kind string"


def base_vocab(spark: SparkSession) -> DataFrame:
    """The reserved pieces: unknown, begin, end, chat markers, byte values."""
    rows = [(UNK, "<unk>", "unknown"), (BOS, "<s>", "control"), (EOS, "</s>", "control")]
    rows += [(FIRST_MARKER + i, m, "marker") for i, m in enumerate(MARKERS)]
    rows += [(FIRST_BYTE + b, f"<0x{b:02X}>", "byte") for b in range(256)]
    return local_frame(spark, rows, VOCAB_SCHEMA)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all lines of a text column."""
    # Outer explodes, as inner ones infer a filter on the array and compute it twice.
    lines = df.select(F.explode_outer(F.split(F.col(text), ANY_NEWLINE)).alias("line"))
    # The words that WORD_PATTERN finds: what follows a space or mark has the mark, put on after counting.
    parts = F.split(spaced(F.col("line")), " ")
    found = lines.select(F.posexplode_outer(parts).alias("place", "part"))
    counts = found.groupBy((F.col("place") > 0).alias("marked"), "part").agg(F.count("*").alias("n"))
    word = F.when(F.col("marked"), F.concat(F.lit(SPACE_MARK), "part")).otherwise(F.col("part"))
    return counts.filter(F.col("marked") | (F.col("part") != "")).select(word.alias("word"), "n")


def char_counts(counts: DataFrame) -> DataFrame:
    """(char, n); never more rows than there are code points."""
    chars = counts.select(F.explode_outer(F.split("word", "")).alias("char"), "n")
    return chars.groupBy("char").agg(F.sum("n").alias("n"))


def symbol_strings(counts: DataFrame) -> DataFrame:
    """(symbols, n): each word as a string of code-point symbols."""
    symbols = F.transform(
        F.split("word", ""), lambda c: F.concat(F.lit(","), F.ascii(c).cast("string"), F.lit(";"))
    )
    return counts.select(F.array_join(symbols, "").alias("symbols"), "n")


def pair_counts(symbols: DataFrame) -> DataFrame:
    """(left, right, n) over neighbouring symbols, weighted by word count."""
    ids = F.regexp_extract_all("symbols", F.lit(r"\d+"), F.lit(0)).cast("array<int>")
    listed = symbols.select(ids.alias("ids"), "n")
    pairs = F.arrays_zip(
        F.slice("ids", F.lit(1), F.size("ids") - 1).alias("left"),
        F.slice("ids", F.lit(2), F.size("ids") - 1).alias("right"),
    )
    rows = listed.select(F.explode_outer(pairs).alias("p"), "n").filter(F.col("p").isNotNull())
    return rows.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(
        F.sum("n").alias("n")
    )


def _replace_pairs(symbols: Column, batch: list[tuple[int, int, int]]) -> Column:
    steps = F.array(
        *[
            F.struct(F.lit(f",{left};,{right};").alias("pair"), F.lit(f",{merged};").alias("merged"))
            for left, right, merged in batch
        ]
    )
    return F.aggregate(steps, symbols, lambda acc, s: F.replace(acc, s["pair"], s["merged"]))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Best pairs first: by count, then older symbols, then left and right."""
    return pairs.orderBy(F.desc("n"), F.greatest("left", "right"), "left", "right").limit(_FETCH)


def learn_merges(counts: DataFrame, n_merges: int, max_piece: int = MAX_PIECE) -> list[tuple]:
    """Up to `n_merges` rows (rank, left piece, right piece, count), best first.

    Equal to merging one best pair at a time: the most frequent, of those the one of older
    symbols. The words stay in the tasks of a barrier stage (`merges.learn`); with dynamic
    allocation, which has no such stages, every round reads them anew.
    """
    if counts.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return learn_merges_in_rounds(counts, n_merges, max_piece)
    return [(rank, *row) for rank, row in enumerate(merges.learn(counts, n_merges, max_piece))]


def learn_merges_in_rounds(counts: DataFrame, n_merges: int, max_piece: int = MAX_PIECE) -> list[tuple]:
    """The merges of `learn_merges` by ordinary jobs, with pairs counted over all words in each round.

    A round takes the leading run of
    ranked pairs that share no symbol: such merges leave each other's counts
    alone, and a pair with a new symbol is at most as frequent as the old pair
    it comes from, which ranks behind the run, and loses ties by its age. A
    pair of equal symbols ends the run, as its merge can make frequent pairs.
    Only the at most 256 best pairs of a round reach the driver.
    """
    state = symbol_strings(counts)
    state = cut_lineage(state.groupBy("symbols").agg(F.sum("n").alias("n")))
    piece: dict[int, str] = {}
    found: list[tuple] = []

    def text(symbol: int) -> str:
        return piece[symbol] if symbol >= FIRST_MERGE else chr(symbol)

    too_long: set[tuple[int, int]] = set()
    rounds = 0
    while len(found) < n_merges:
        pairs = pair_counts(state)
        if too_long:
            known = local_frame(counts.sparkSession, sorted(too_long), "left int, right int")
            pairs = pairs.join(F.broadcast(known), ["left", "right"], "left_anti")
        best = _ranked(pairs).collect()
        if not best:
            break
        used: set[int] = set()
        batch = []
        for row in best:
            if len(text(row.left)) + len(text(row.right)) > max_piece:
                too_long.add((row.left, row.right))
                continue
            if used & {row.left, row.right} or len(found) == n_merges:
                break
            used |= {row.left, row.right}
            merged = FIRST_MERGE + len(found)
            piece[merged] = text(row.left) + text(row.right)
            found.append((len(found), text(row.left), text(row.right), row.n))
            batch.append((row.left, row.right, merged))
            if row.left == row.right:
                break
        if batch:
            state = state.select(_replace_pairs(F.col("symbols"), batch).alias("symbols"), "n")
        rounds += 1
        if rounds % _ROUNDS_PER_CHECKPOINT == 0:
            # A word of one symbol has no pair left to count.
            state = cut_lineage(state.filter(F.substring_index("symbols", ";", 2) != F.col("symbols")))
    return found


MERGES_SCHEMA = "rank int, left string, right string, n bigint"


def train_bpe(
    df: DataFrame, vocab_size: int, text: str = "text", max_piece: int = MAX_PIECE
) -> tuple[DataFrame, DataFrame]:
    """(vocab, merges) of a cleaned corpus.

    Reserved pieces come first, then merged pieces in the order learned, then
    single characters by falling count. The size is a soft limit: a corpus with
    few pairs gives fewer pieces, one with many characters more.
    """
    return train_on_words(cut_lineage(word_counts(df, text)), vocab_size, max_piece)


def train_on_words(
    counts: DataFrame, vocab_size: int, max_piece: int = MAX_PIECE
) -> tuple[DataFrame, DataFrame]:
    """(vocab, merges) as `train_bpe` makes them, of a written table (word, n)."""
    spark = counts.sparkSession
    chars = char_counts(counts).orderBy(F.desc("n"), "char").collect()  # bounded by Unicode
    n_merges = max(0, vocab_size - FIRST_LEARNED - len(chars))
    learned = learn_merges(counts, n_merges, max_piece)
    return vocab_frame(spark, learned, [c.char for c in chars]), local_frame(
        spark, learned, MERGES_SCHEMA
    )


def vocab_frame(spark: SparkSession, learned: list[tuple], chars: list[str]) -> DataFrame:
    # Two merges may spell the same piece; it gets one id.
    pieces = list(dict.fromkeys(left + right for _, left, right, _ in learned))
    rows = [(FIRST_LEARNED + i, p, "piece") for i, p in enumerate([*pieces, *chars])]
    return base_vocab(spark).unionByName(local_frame(spark, rows, VOCAB_SCHEMA))


def check_vocab(configs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Configs whose vocabulary size differs from the vocabulary's."""
    size = vocab.agg(F.count("*").alias("pieces"))
    return configs.join(F.broadcast(size), F.col("vocab_size") != F.col("pieces"))  # one row


def stop_ids(vocab: DataFrame, eos: int = EOS, end_of_turn: str = MARKERS[-1]) -> DataFrame:
    """Ids that end generation: end of text, then end of turn, where the vocabulary has them."""
    wanted = (F.col("id") == eos) | (F.col("piece") == end_of_turn)
    ranked = F.struct((F.col("id") != eos).alias("last"), "id")
    return vocab.filter(wanted).agg(
        F.transform(F.sort_array(F.collect_list(ranked)), lambda s: s["id"]).alias("stop_ids")
    )
