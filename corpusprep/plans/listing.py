"""Queries of the file-listing operators, over files named after the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.plans.fixtures import ctes, files
from corpusprep.plans.registry import Tables, query
from corpusprep.sources import listing

_FILES = ctes(files=None)
_MODELS = "name LIKE '%.gguf'"


@query(
    f"""{_FILES} SELECT folder, arg_min(path, (CASE name WHEN 'dataset_llama3_nosystem.jsonl' THEN 0
        WHEN 'dataset_llama3_text.jsonl' THEN 1 WHEN 'dataset_chatml_nosystem.jsonl' THEN 2
        WHEN 'dataset_chatml_text.jsonl' THEN 3 WHEN 'dataset.jsonl' THEN 4 ELSE 5 END, path)) AS path
      FROM files WHERE name LIKE '%.jsonl' GROUP BY folder"""
)
def dataset_pick(t: Tables) -> DataFrame:
    return listing.pick_dataset(files(t))


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Model files of the even and of the odd folders."""
    models = files(t).filter(_MODELS)
    even = F.regexp_extract("folder", r"(\d+)", 1).cast("int") % 2 == 0
    return models.filter(even), models.filter(~even)


@query(f"{_FILES} SELECT DISTINCT name FROM files WHERE {_MODELS}")
def model_listing(t: Tables) -> DataFrame:
    return listing.merge_listings(*_halves(t))


_HALF = "cast(substr(folder, 4) AS integer) % 2 ="


@query(
    f"""{_FILES}, first AS (SELECT name, min(path) AS path FROM files WHERE {_MODELS} AND {_HALF} 0 GROUP BY name),
      second AS (SELECT name, min(path) AS path FROM files WHERE {_MODELS} AND {_HALF} 1 GROUP BY name),
      requests AS (SELECT doc_id, 'model' || (doc_id % 40) || '.gguf' AS name FROM documents)
    SELECT doc_id, name, coalesce(first.path, second.path, name) AS path FROM requests
      LEFT JOIN first USING (name) LEFT JOIN second USING (name)"""
)
def path_resolve(t: Tables) -> DataFrame:
    """Paths of requested models; requests name few models, so each name is resolved once."""
    requests = t.documents.select(
        "doc_id", F.concat(F.lit("model"), F.col("doc_id") % 40, F.lit(".gguf")).alias("name")
    )
    first, second = [f.groupBy("name").agg(F.min("path").alias("path")) for f in _halves(t)]
    return listing.resolve_paths(requests, first, second)
