"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node near it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``a, b`` links; a component is named by its smallest id.

    Alternates large-star and small-star steps until nothing changes. Minima are
    pre-aggregated, and the joins have one row per node on one side, so that a node with a
    great many links can be split. Each state is a written table. Links from a node to
    itself and repeated links do not matter; links with a null end are left out.
    """
    links = cut_lineage(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = mark(links)
    while True:
        links = cut_lineage(_small_star(_large_star(links)))
        if (now := mark(links)) == state:
            break
        state = now
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
