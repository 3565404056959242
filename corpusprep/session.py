"""Session helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def scratch_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs, on storage that all executors share.

    It lies in the folder of ``spark.checkpoint.dir``; where that is not set, in
    the warehouse. It is deleted when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    folder = f"{base.rstrip('/')}/corpusprep-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return files.makeQualified(path).toString()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table into the scratch folder and read it back.

    Unlike ``checkpoint()`` this computes the rows once, and readers of the
    table prune columns and know its size.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile shuffle files go when the query that wrote them ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a narrow table over all tasks before its rows are multiplied.

    A scan has tasks by bytes, so a million rows that compress well stay in one. With the number
    given, adaptive execution leaves the partitions as they are.
    """
    spark = df.sparkSession
    return df.repartition(max(shuffle_width(spark), spark.sparkContext.defaultParallelism), key)


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small literal frame whose size the optimizer knows."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = [[row[i] for row in rows] for i in range(len(fields))]
    return spark.createDataFrame(pa.table(columns, schema=fields))


def compute_once(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """`keep` and the given columns, each computed once.

    A filter on a computed column would otherwise be pushed below the projection
    and compute the column a second time; it is not pushed below a generator.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def join_groups(
    left: DataFrame, right: DataFrame, group: Sequence[str], keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on group columns, where null is a group like any other, and on plain keys."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in [*group, *keys]})
    condition = F.lit(True)
    for c in group:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    for c in keys:
        condition = condition & (F.col(c) == F.col(f"_right_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{c}" for c in [*group, *keys]])
