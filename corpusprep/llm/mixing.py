"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import small_side, word_count
from corpusprep.session import cut_lineage, shuffle_width

#: Multiplier of the golden-ratio sequence on 32-bit points.
_GOLDEN = 2654435769
_POINTS = 1 << 32
_CELLS = 4096
_CHUNK = 1 << 16
_BUCKETS = 4096


def source_targets(
    sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2
) -> DataFrame:
    """One row per source with its size and the tokens that the mix should take.

    Sources in code point order, null last, take the weights in turn, from the first
    again after the last. `share` times all tokens are dealt out by weight; a source
    gives `epochs` times its size at most, and what it can't give goes to the others.
    Adds the interval of schedule points that belongs to each source.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy(F.lit(1))
    tight = Window.orderBy("ratio", "source_no")
    # One row per source from here on, which a single task can sort.
    found = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(
            F.sum("weight").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("fair", (F.col("total") - F.col("cap_before")) * F.col("weight") / F.col("weight_left"))
        .withColumn("capped", F.col("fair") >= F.col("cap"))
    )
    free = F.min(F.when(~F.col("capped"), F.struct("ratio", "source_no", "total", "cap_before", "weight_left"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        (F.col("free.total") - F.col("free.cap_before")) * F.col("weight") / F.col("free.weight_left"))
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        found.withColumn("free", free)
        .withColumn("target", target)
        .withColumn("need", F.round("target").cast("bigint"))
        .withColumn("high", F.when(F.sum("target").over(every) > 0, F.floor(
            F.sum("target").over(upto) / F.sum("target").over(every) * F.lit(float(_POINTS)) + 0.5)).otherwise(F.lit(0)))
        .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0)))
        .select("source", "source_no", "source_size", "target", "need", "low", "high")
    )


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The mix as slots: ``slot, source_no, rank``; a slot takes block `rank` of its source.

    Slot k falls on the golden-ratio point k of the unit interval, and goes to the source
    whose share of it holds the point. What a source still lacks at the end, a few blocks
    by the sequence's discrepancy, follows in a tail; what it has too much is left out.
    """
    spark = sources.sparkSession
    needed = sources.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    slots = -(-needed // block)
    point = F.col("slot").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(_GOLDEN) % F.lit(_POINTS)
    width = _POINTS // _CELLS
    points = spark.range(0, slots, 1, shuffle_width(spark)).select(F.col("id").alias("slot")).select(
        "slot", point.alias("point"), F.expr(f"slot div {_CHUNK}").alias("chunk")
    ).withColumn("cell", F.expr(f"point div {width}"))
    spans = sources.filter("high > low").select(
        "source_no", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell")
    )
    dealt = points.join(small_side(spans), "cell").filter("point >= low and point < high").select("slot", "chunk", "source_no")
    chunks = dealt.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut_lineage(chunks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot"))
    ranked = dealt.withColumn("inside", inside).join(chunks.drop("n"), ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("first") + F.col("inside") - 1).alias("rank")
    )
    have = chunks.groupBy("source_no").agg(F.sum("n").alias("have"))
    small = small_side(sources.select("source_no", F.expr(f"(need + {block - 1}) div {block}").alias("blocks")))
    used = ranked.join(small, "source_no").filter("rank < blocks").drop("blocks")
    tail = (
        sources.select("source_no", F.expr(f"(need + {block - 1}) div {block}").alias("blocks"))
        .join(have, "source_no", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter("have < blocks")
        .select("source_no", F.explode(F.sequence("have", F.expr("blocks - 1"))).alias("rank"))
        .select((F.lit(slots) + F.col("rank") * sources.count() + F.col("source_no")).alias("slot"), "source_no", "rank")
    )
    return used.unionByName(tail.select("slot", "source_no", "rank"))


def _positions(sized: DataFrame, sources: DataFrame, ids: Sequence[str], key: Column) -> DataFrame:
    """Where each row starts in the shuffled token stream of its source."""
    small = small_side(sources)
    named = sized.join(small, sized["source"].eqNullSafe(small["source"])).select(
        *ids, "size", "source_no", "source_size", "target", "need", key.alias("key")
    ).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    here = Window.partitionBy("source_no", "bucket").orderBy("key", *ids, "size")
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select(
        "source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    running = F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))
    return named.withColumn("running", running).join(offsets, ["source_no", "bucket"]).withColumn(
        "start", F.col("first") + F.col("running") - F.col("size")
    ).drop("first", "running", "bucket", "key")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    block: int = 256,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """Mix the sources of `docs` to target weights, in words.

    Returns two tables. The mix: ``slot, source_no, rank, id, epoch, from_word, words`` with
    a row for each stretch of a document in a slot; a slot has `block` words, and the last
    one of a source may have less. The documents: ``id, size, source_size, target, taken``
    with one row per input row; `taken` counts the words that the mix takes, repeats included.

    The order in a source is that of the MD5 of seed and id, so the same rows give the same
    mix. A null text has no words and is never taken; a null source is a source; null and
    repeated ids have an order like others. Other columns are not read.
    """
    ids = ["id"]
    sized = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = cut_lineage(sized)
    sources = cut_lineage(source_targets(sized, weights, share, epochs))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    placed = cut_lineage(_positions(sized, sources, ids, key))
    slots = schedule(sources, block)
    start = F.col("start") + F.col("epoch") * F.col("source_size")
    cut = (
        placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("from_pos", start)
        .withColumn("to_pos", F.least(start + F.col("size"), F.col("need")))
        .withColumn("rank", F.explode_outer(F.when(
            F.col("to_pos") > F.col("from_pos"),
            F.sequence(F.expr(f"from_pos div {block}"), F.expr(f"(to_pos - 1) div {block}")))))
    )
    joined = cut.join(slots, ["source_no", "rank"], "left")
    first = F.greatest(F.col("from_pos"), F.col("rank") * block)
    last = F.least(F.col("to_pos"), (F.col("rank") + 1) * block)
    pieces = joined.select(
        "slot", "source_no", "rank", "id", "start", "size", "source_size", "target", "epoch",
        (first - F.col("from_pos")).alias("from_word"),
        F.when(F.col("slot").isNotNull(), last - first).otherwise(F.lit(0)).alias("words"),
    )
    per_doc = pieces.groupBy("source_no", "start", "id", "size").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"),
        F.sum(F.when(F.col("epoch") == 0, F.lit(1))).alias("n"),
    )
    # Rows without words share their start with others; each of them is a row again.
    repeat = F.when(F.col("size") == 0, F.col("n")).otherwise(F.lit(1)).cast("int")
    documents = per_doc.select("id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), repeat)).alias("_copy")).drop("_copy")
    stream = pieces.filter("slot is not null").select("slot", "source_no", "rank", "id", "epoch", "from_word", "words")
    return stream, documents


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` with each row as often as the mix takes it, rounded to whole documents.

    A document without words weighs nothing in any mix and stays as it is.
    """
    _, decided = mix(docs, id_col=id_col, **options)
    copies = decided.groupBy("id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).select(
        F.col("id").alias("_mix_id"),
        F.when(F.col("s") == 0, F.lit(1)).otherwise(F.round(F.col("t") / F.col("s"))).cast("int").alias("_copies"),
    )
    return (
        docs.join(copies, docs[id_col].cast("bigint").eqNullSafe(F.col("_mix_id")))
        .filter("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*[docs[c] for c in docs.columns])
    )
