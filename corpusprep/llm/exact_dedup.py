"""Exact duplicates by a content sort."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import count_at_most, lower_ascii
from corpusprep.session import cut_lineage, shuffle_width

#: Characters of the text that lead the sort key, before its digest.
_LEAD = 32


def _splitters(keyed: DataFrame, buckets: int, per_bucket: int, rows: int) -> list[dict]:
    """Keys that cut the sorted rows into buckets of about the same bytes, from a row sample."""
    if rows == 0 or buckets < 2:
        return []
    rate = min(1.0, buckets * per_bucket / rows)
    sample = keyed.sample(fraction=rate, seed=11).select("lead", "digest", "id", F.octet_length("norm").alias("n"))
    found = [
        (r.lead.encode(), r.digest, -1 if r.id is None else r.id, r.id is not None, r.n + 64) for r in sample.collect()
    ]
    found.sort(key=lambda r: (r[0], r[1], r[3], r[2]))
    step = sum(r[4] for r in found) / buckets
    cuts, gone = [], 0
    for lead, digest, row, known, size in found:
        if gone >= step * (len(cuts) + 1):
            cuts.append({"lead": lead.decode(), "digest": digest, "id": row if known else None})
        gone += size
    return cuts


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=lower_ascii,
    buckets: int | None = None,
    sample_per_bucket: int = 16,
) -> DataFrame:
    """Group rows of equal normalised text and mark the one that stays.

    Splitters from a row sample cut the order of (leading characters, digest, id)
    into buckets of like size; each bucket is sorted (on disk if need be) by that
    key and the whole text, and every row is compared in full with its neighbour.
    The id is part of the key, so a group of any size spreads over many buckets.
    Only the first and last group of a bucket can go on in another one; those, two
    rows a bucket, are joined by their whole text.

    Returns ``id, keep_id, group_size, kept, digest`` with one row per input row;
    `digest` is the SHA-256 of the normalised text. The `keep` ("smallest" or
    "largest") id of a group stays. A null text counts as empty. A null id stays
    only where its group has no other, and `keep_id` is then null. Of rows that
    repeat id and text, one is kept. Other columns are not read, so their names
    do not matter.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    spark = docs.sparkSession
    buckets = buckets or 2 * shuffle_width(spark)
    norm = normalise(F.col(text_col))
    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), norm.alias("norm")).select(
        "id", "norm", F.substring("norm", 1, _LEAD).alias("lead"), F.sha2("norm", 256).alias("digest")
    )
    cuts = _splitters(keyed, buckets, sample_per_bucket, docs.count())
    borders = F.from_json(F.lit(json.dumps(cuts)), "array<struct<lead:string,digest:string,id:bigint>>")
    placed = keyed.withColumn("bucket", count_at_most(borders, len(cuts), F.struct("lead", "digest", "id")))

    order = Window.partitionBy("bucket").orderBy("lead", "digest", "norm", "id")
    before = F.lag("norm").over(order)
    runs = (
        placed.withColumn("starts", before.isNull() | (before != F.col("norm")))
        .withColumn("run", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("is_last", F.lead("norm").over(order).isNull())
    )
    # Texts go on only with the first row of a bucket's first run and the last row of its last run.
    edge = F.when((F.col("starts") & (F.col("run") == 1)) | F.col("is_last"), F.col("norm"))
    best: Column = F.min("id") if keep == "smallest" else F.max("id")
    first = F.asc_nulls_last("id") if keep == "smallest" else F.desc_nulls_last("id")
    run = Window.partitionBy("bucket", "run")
    grouped = cut_lineage(
        runs.select("bucket", "run", "id", "digest", edge.alias("edge")).select(
            "bucket", "run", "id", "digest", "edge",
            F.count(F.lit(1)).over(run).alias("n"),
            best.over(run).alias("best"),
            F.row_number().over(run.orderBy(first)).alias("rank"),
            F.count("edge").over(run).alias("edges"),
        )
    )
    same = Window.partitionBy("edge")
    whole = (
        grouped.filter(F.col("edge").isNotNull())
        .groupBy("bucket", "run", "edge")
        .agg(F.first("n").alias("n"), F.first("best").alias("best"))
        .select(
            F.col("bucket").alias("b"), F.col("run").alias("r"),
            F.sum("n").over(same).alias("all_n"),
            (F.min("best") if keep == "smallest" else F.max("best")).over(same).alias("all_best"),
            F.min("bucket").over(same).alias("low_bucket"),
        )
    )
    # Two rows a bucket at most, whatever the data.
    joined = grouped.join(
        F.broadcast(whole), (F.col("edges") > 0) & (F.col("bucket") == F.col("b")) & (F.col("run") == F.col("r")), "left"
    )
    total = F.coalesce("all_n", "n")
    keep_id = F.when(F.col("b").isNull(), F.col("best")).otherwise(F.col("all_best"))
    home = F.when(F.col("all_best").isNull(), F.coalesce("low_bucket", "bucket")).otherwise(F.col("bucket"))
    return joined.select(
        "id",
        keep_id.alias("keep_id"),
        total.alias("group_size"),
        ((F.col("rank") == 1) & F.col("id").eqNullSafe(keep_id) & (F.col("bucket") == home)).alias("kept"),
        "digest",
    )
