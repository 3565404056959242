"""From token arrays to an ordered stream, training windows and batches.

`ids` is a Column so that it is evaluated after the offsets have been joined
on: the shuffle then carries the text and not the four times larger array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusprep.functions.tokens import BOS, EOS
from corpusprep.operators.ordered import running, slice_rows
from corpusprep.operators.prefix import running_totals, shuffled_rank
from corpusprep.session import compute_once, cut_lineage, join_groups

# Starts per stretch of the sliding windows; bounds the array one row holds.
_STRETCH = 1024
_HASHES = ["_h1", "_h2"]


def stream_offsets(
    df: DataFrame, n_tokens: Column, key: str = "doc_id", group: Sequence[str] = ()
) -> DataFrame:
    """First position of each key's examples in the stream of its group; rows without key have none."""
    sized = df.select(*group, key, n_tokens.cast("bigint").alias("n_tokens")).filter(F.col(key).isNotNull())
    return _key_offsets(cut_lineage(sized), key, group).drop("n_rows")


def _key_offsets(sizes: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """Tokens, rows and first position of each key, from a table of row sizes."""
    each = sizes.groupBy(*group, key).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    return running_totals(each, key, ["n_tokens", "n_rows"], group).drop("before_n_rows").withColumnRenamed(
        "before_n_tokens", "offset"
    )


def _row_offsets(sizes: DataFrame, key: str, group: list[str]) -> DataFrame:
    """First position and number of copies of each distinct row of keys that repeat.

    Rows of one key stand in the order of their hashes. A key may have any number of rows, so
    they are added up in slices.
    """
    row = [*group, key]
    parts = sizes.groupBy(*row, *_HASHES).agg(F.first("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))
    sliced = slice_rows(parts, row, _HASHES)
    inside = running(sliced, row, _HASHES, {"_before": F.col("n_tokens") * F.col("copies")}, inclusive=False)
    firsts = _key_offsets(sizes, key, group).select(*row, "offset")
    there = join_groups(sliced.select(*row, "slice").distinct(), firsts, group, [key])
    placed = join_groups(inside, there, group, [key, "slice"])
    return placed.select(*row, *_HASHES, "n_tokens", "copies", (F.col("offset") + F.col("_before")).alias("offset"))


def without_key(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that `with_offsets` leaves out: they have no place in the order."""
    return df.filter(F.col(key).isNull())


def with_offsets(
    df: DataFrame,
    ids: Column,
    n_tokens: Column | None = None,
    key: str = "doc_id",
    group: Sequence[str] = (),
) -> DataFrame:
    """Group columns, key, ``offset`` and the token array ``ids``: the first of what `with_offsets_and_total` returns."""
    return with_offsets_and_total(df, ids, n_tokens, key, group)[0]


def with_offsets_and_total(
    df: DataFrame,
    ids: Column,
    n_tokens: Column | None = None,
    key: str = "doc_id",
    group: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Group columns, key, ``offset`` and the token array ``ids``; and the number of tokens of each group.

    Rows that share a key follow each other in the order of two hashes of their columns. Without
    `n_tokens` the ids are computed once, into a written table.

    The rows are read twice: for their sizes, written as one narrow table from which all sums
    are made, and to join the positions back. Only where whole rows repeat are they read a third
    time, one row for all its copies.
    """
    group = list(group)
    keyed = df.filter(F.col(key).isNotNull())
    if n_tokens is None:
        keyed = cut_lineage(keyed.select(*group, key, ids.alias("ids")))
        ids, n_tokens = F.col("ids"), F.size("ids")
    hashes = [F.xxhash64(*keyed.columns).alias("_h1"), F.xxhash64(F.lit(1), *keyed.columns).alias("_h2")]
    sizes = cut_lineage(keyed.select(*group, key, *hashes, n_tokens.cast("bigint").alias("n_tokens")))
    columns = [*group, key, "offset", ids.alias("ids")]
    total = sizes.groupBy(*group).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    if sizes.groupBy(*group, key).count().filter("count > 1").isEmpty():
        offsets = running_totals(sizes, key, ["n_tokens"], group).select(*group, key, F.col("before_n_tokens").alias("offset"))
        # Written, so that the join knows its size.
        return join_groups(keyed, cut_lineage(offsets), group, [key]).select(*columns), total
    offsets = cut_lineage(_row_offsets(sizes, key, group))
    rows = keyed.select("*", *hashes)
    once = join_groups(rows, offsets.filter("copies = 1"), group, [key, *_HASHES]).select(*columns)
    if offsets.filter("copies > 1").isEmpty():
        return once, total
    copied = offsets.filter("copies > 1").withColumnRenamed("n_tokens", "_size")
    some = join_groups(rows, copied, group, [key, *_HASHES]).dropDuplicates([*group, key, *_HASHES])
    each = some.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return once.unionByName(each.withColumn("offset", F.col("offset") + F.col("_copy") * F.col("_size")).select(*columns)), total


def token_stream(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(pos, token) rows of a frame made by `with_offsets`."""
    # Outer, as an inner explode infers a filter on the array and computes it twice.
    rows = df.select(*group, "offset", F.posexplode_outer("ids").alias("_i", "token"))
    return rows.filter(F.col("token").isNotNull()).select(
        *group, (F.col("offset") + F.col("_i")).alias("pos"), "token"
    )


def cut_pieces(df: DataFrame, stride: int, halo: int, group: Sequence[str] = ()) -> DataFrame:
    """(stretch, start, length, cut): the examples cut at the borders of stretches, with what a halo repeats."""
    start, end = F.col("offset"), F.col("offset") + F.size("ids").cast("bigint")
    first = F.expr(f"greatest((offset - {halo}) div {stride}, 0)")
    last = F.expr(f"(offset + size(ids) - 1) div {stride}")
    reached = F.when(F.size("ids") > 0, F.sequence(first, last))
    opens = F.col("stretch") * stride
    place = F.greatest(opens, start)
    length = F.least(opens + stride + halo, end) - place
    # Sliced after the explode, where generated code copies only the slice.
    # Outer, as an inner explode infers a filter on the ids and computes them twice.
    placed = df.select(*group, "offset", "ids", F.explode_outer(reached).alias("stretch")).filter(F.col("stretch").isNotNull())
    return placed.select(
        *group,
        "stretch",
        place.alias("start"),
        length.alias("length"),
        F.slice("ids", (place - start + 1).cast("int"), length.cast("int")).alias("cut"),
    )


def _cuts(df: DataFrame, stride: int, halo: int, group: Sequence[str]) -> DataFrame:
    """The pieces of each stretch in their order, and how many tokens they have."""
    return cut_pieces(df, stride, halo, group).groupBy(*group, "stretch").agg(
        F.sort_array(F.collect_list(F.struct("start", "cut"))).alias("cuts"), F.sum("length").alias("n")
    )


def stretches(df: DataFrame, stride: int, halo: int, group: Sequence[str] = ()) -> DataFrame:
    """Cut the stream every `stride` tokens, each piece followed by `halo` tokens of the next.

    Returns the group columns, ``stretch`` and ``tokens`` (at most stride + halo
    of them). Examples are sliced before they are shuffled, by stretch number.
    """
    return _cuts(df, stride, halo, group).select(*group, "stretch", F.flatten("cuts.cut").alias("tokens"))


def pack_blocks(df: DataFrame, block: int, group: Sequence[str] = ()) -> DataFrame:
    """Non-overlapping (x, y) pairs; y is x moved on by one token. The remainder is dropped."""
    full = _cuts(df, block, 1, group).filter(F.col("n") == block + 1)
    whole = compute_once(full, [*group, "stretch"], tokens=F.flatten("cuts.cut"))
    return whole.select(
        *group,
        F.col("stretch").alias("block_id"),
        F.slice("tokens", 1, block).alias("x"),
        F.slice("tokens", 2, block).alias("y"),
    )


def sliding_windows(
    df: DataFrame, block: int, exact: bool = False, group: Sequence[str] = ()
) -> DataFrame:
    """(x, y) pairs at every position.

    N tokens give N - block - 1 windows, one fewer than fit; ``exact=True``
    gives all N - block.
    """
    need = block + 1 if exact else block + 2
    step = max(block, _STRETCH)
    starts = F.least(F.size("tokens") - need + 1, F.lit(step))
    cut = stretches(df, stride=step, halo=need - 1, group=group)
    placed = cut.select(
        *group,
        "stretch",
        "tokens",
        F.explode(F.when(starts > 0, F.sequence(F.lit(0), starts - 1))).alias("i"),
    )
    return placed.select(
        *group,
        (F.col("stretch") * step + F.col("i")).alias("start"),
        F.slice("tokens", F.col("i") + 1, F.lit(block)).alias("x"),
        F.slice("tokens", F.col("i") + 2, F.lit(block)).alias("y"),
    )


def shifted_targets(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(pos, token, target): each token with the one that follows; the last has none."""
    cut = stretches(df, stride=_STRETCH, halo=1, group=group)
    pairs = F.arrays_zip(
        F.col("tokens").alias("token"),
        F.slice("tokens", 2, _STRETCH).alias("target"),
    )
    rows = cut.select(*group, "stretch", F.posexplode(F.slice(pairs, 1, _STRETCH)).alias("i", "p"))
    return rows.select(
        *group,
        (F.col("stretch") * _STRETCH + F.col("i")).alias("pos"),
        F.col("p.token").alias("token"),
        F.col("p.target").alias("target"),
    )


def prefix_delta(
    df: DataFrame, group: Sequence[str] = ("doc_id",), order: Sequence[str] = ("step",), text: str = "text"
) -> DataFrame:
    """Add ``delta``, what each text adds beyond the longest earlier one; rows without it go.

    Rows of a group are the growing text of one generation. `df` comes from
    `slice_rows`.
    """
    sent = running(df, group, order, {"_sent": F.length(text)}, F.max, inclusive=False)
    delta = F.substring(F.col(text), F.col("_sent").cast("int") + 1, F.length(text))
    return sent.withColumn("delta", delta).filter(F.col("delta") != "").drop("_sent", "slice")


def prefix_spans(df: DataFrame, lengths: Column, key: str = "doc_id", text: str = "text", step: str = "step") -> DataFrame:
    """(key, step, delta): `prefix_delta` where the growing texts are beginnings of one whole text.

    `lengths` has the characters of the text that each step shows. Only lengths are cut into slices and
    compared; the whole texts are shuffled once, to cut the deltas, and no beginning is ever written out.
    Rows of one key are one generation; of rows that are equal in key and text, one is cut.
    """
    hashes = [F.xxhash64(F.lit(k), F.isnull(key), key, text).alias(h) for k, h in enumerate(_HASHES)]
    rows = df.select(key, text, *hashes, lengths.alias("_lengths"))
    steps = rows.select(key, *_HASHES, F.posexplode("_lengths").alias(step, "_until"))
    sliced = slice_rows(steps, [key], [step])
    reached = running(sliced, [key], [step], {"_sent": F.col("_until")}, F.max, inclusive=False)
    new = reached.filter(F.col("_until") > F.col("_sent")).drop("slice")
    texts = df.select(F.col(text).alias("_text"), *hashes)
    if not sliced.filter(F.col(step) == 0).groupBy(*_HASHES).count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(_HASHES)
    delta = F.substring(F.col("_text"), (F.col("_sent") + 1).cast("int"), (F.col("_until") - F.col("_sent")).cast("int"))
    return new.join(texts, _HASHES).select(key, step, delta.alias("delta"))


def make_batches(
    df: DataFrame,
    size: int,
    key: str = "block_id",
    shuffle: bool = True,
    drop_last: bool = True,
    seed: int = 0,
) -> DataFrame:
    """Add ``batch_id``.

    Without shuffling the key must count up from 0, as `pack_blocks` makes it.
    """
    if shuffle:
        placed = shuffled_rank(df, key, seed)
        batches = placed.withColumn("batch_id", F.expr(f"rank div {size}")).drop("rank")
    else:
        batches = df.withColumn("batch_id", F.expr(f"`{key}` div {size}"))
    if not drop_last:
        return batches
    filled = F.count("*").over(W.partitionBy("batch_id"))  # at most `size` rows a group
    return batches.withColumn("_n", filled).filter(F.col("_n") == size).drop("_n")


def or_default(df: DataFrame, ids: str = "ids") -> DataFrame:
    """The frame itself, or one row with a begin-end pair where it is empty."""
    default = df.sparkSession.range(1).select(
        *[
            F.array(F.lit(BOS), F.lit(EOS)).alias(f.name)
            if f.name == ids
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )
    some = df.limit(1).select(F.lit(1).alias("_some"))
    missing = default.join(some, F.lit(True), "left_anti")
    return df.unionByName(missing)
