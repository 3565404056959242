"""Named queries over the tables of one folder, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Setting that spreads each table over so many partitions when it is read. Unset by default:
#: it is for small tables of one row group, which would keep a single core busy.
SPREAD = "spark.corpusprep.read.partitions"


class Tables:
    """Lazy access to the parquet tables of a folder: ``tables.documents``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        spread = self.spark.conf.get(SPREAD, None)
        return table.repartition(int(spread)) if spread else table

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL whose ``{table}`` names are the given frames or tables of the folder."""
        return self.spark.sql(text, **frames)


def query(oracle: str | None = None) -> Callable:
    """Register a function of `Tables` under its own name."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))

        QUERIES[function.__name__] = run
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register
