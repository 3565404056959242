"""File listings and the choices made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dataset names in order of preference.
DATASET_NAMES = (
    "dataset_llama3_nosystem.jsonl",
    "dataset_llama3_text.jsonl",
    "dataset_chatml_nosystem.jsonl",
    "dataset_chatml_text.jsonl",
    "dataset.jsonl",
)


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(folder, name, path, length) of the files matching `glob`; contents are not read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        .select("path", "length")
    )
    return found.select(
        F.lit(folder).alias("folder"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        "length",
    )


def pick_dataset(files: DataFrame) -> DataFrame:
    """(folder, path) of each folder's dataset: by preference, else the first JSONL by path."""
    order = F.lit(len(DATASET_NAMES))
    for rank, name in reversed(list(enumerate(DATASET_NAMES))):
        order = F.when(F.col("name") == name, rank).otherwise(order)
    jsonl = files.filter(F.endswith("name", F.lit(".jsonl")))
    return jsonl.groupBy("folder").agg(F.min_by("path", F.struct(order, "path")).alias("path"))


def merge_listings(*listings: DataFrame) -> DataFrame:
    """Names of all listings without repeats, sorted."""
    names = listings[0].select("name")
    for listing in listings[1:]:
        names = names.unionByName(listing.select("name"))
    return names.distinct().orderBy("name")


def resolve_paths(requests: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Add the ``path`` of each requested ``name``: from `first`, from `second`, else the name.

    Both listings must hold a name once, as a folder does.
    """
    a = first.select("name", F.col("path").alias("_first"))
    b = second.select("name", F.col("path").alias("_second"))
    return (
        requests.join(a, "name", "left")
        .join(b, "name", "left")
        .withColumn("path", F.coalesce("_first", "_second", "name"))
        .drop("_first", "_second")
    )
