"""Publishing in one step: failed and killed writes leave the old rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpusprep.sources import publish


def test_publish_again_and_fail(spark, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        publish.read_run(spark, path)
    publish.publish_run(spark.range(3), path)
    opened = publish.read_run(spark, path)
    publish.publish_run(spark.range(5), path)
    assert publish.read_run(spark, path).count() == 5
    assert opened.count() == 3  # a reader that began before
    bad = spark.range(7).select(F.when(F.col("id") == 6, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish_run(bad, path)
    assert publish.read_run(spark, path).count() == 5


def test_killed_between_write_and_swing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "corpus")
    lines = spark.createDataFrame([("a",), ("b",)], "text string")
    publish.publish_corpus(lines, path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(publish, "swing", killed)
        with pytest.raises(KeyboardInterrupt):
            publish.publish_corpus(lines.limit(1), path)
    assert sorted(r.value for r in publish.read_corpus(spark, path).collect()) == ["a", "b"]
    # The next publication clears away what the killed one left, but for the version before.
    publish.publish_corpus(lines.limit(1), path, keep=0)
    assert publish.read_corpus(spark, path).count() == 1
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 1
