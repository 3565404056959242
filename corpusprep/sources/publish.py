"""Corpora and runs that are replaced in one step.

Every write goes to a folder of its own under the path; then one small file is swung to name it.
A write that fails, or is killed before that, leaves what was there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"


def _files(spark: SparkSession, path: str):
    """The Hadoop file context of a path, and its path class."""
    fs = spark._jvm.org.apache.hadoop.fs
    place = fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return fs, place.getFileSystem(conf), fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf), place


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the published rows, or None before the first publication."""
    fs, system, _, place = _files(spark, path)
    pointer = fs.Path(place, _POINTER)
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        return fs.Path(place, stream.readUTF()).toString()
    finally:
        stream.close()


def swing(spark: SparkSession, path: str, version: str, keep: int = 1) -> None:
    """Name `version` as the current folder, by one atomic rename, and delete all but `keep` older ones."""
    fs, system, context, place = _files(spark, path)
    fresh = fs.Path(place, f"{_POINTER}-{version}")
    stream = system.create(fresh, True)
    stream.writeUTF(version)
    stream.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context.rename(fresh, fs.Path(place, _POINTER), options)
    older = [s for s in system.listStatus(place) if s.isDirectory() and s.getPath().getName() != version]
    older.sort(key=lambda s: -s.getModificationTime())
    for status in older[keep:]:
        system.delete(status.getPath(), True)


def publish_run(df: DataFrame, path: str, keep: int = 1) -> None:
    """Parquet output of a run in place of the run before, which readers see until all is written.

    `keep` older versions stay, for readers that have begun on one. One writer at a time: the
    next one clears away what a killed one left.
    """
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    swing(df.sparkSession, path, version, keep)


def publish_corpus(df: DataFrame, path: str, text: str = "text", keep: int = 1) -> None:
    """One line per row, in place of the corpus before; see `publish_run`."""
    version = f"v-{uuid.uuid4().hex}"
    df.select(text).write.text(f"{path.rstrip('/')}/{version}")
    swing(df.sparkSession, path, version, keep)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the run published last."""
    return spark.read.parquet(_published(spark, path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the corpus published last, as ``value``."""
    return spark.read.text(_published(spark, path))


def _published(spark: SparkSession, path: str) -> str:
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing has been published at {path}")
    return folder
