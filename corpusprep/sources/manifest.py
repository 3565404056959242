"""Manifest tables of models: key/value rows and tensor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KV_SCHEMA = "model string, key string, value string, vtype string, arr_len int"
TENSOR_SCHEMA = "model string, name string, shape array<int>, dtype string, nbytes bigint"


def read_manifest(
    spark: SparkSession, kv_path: str, tensor_path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """(kv, tensors) from parquet or JSON-lines tables."""
    kv = spark.read.format(fmt).schema(KV_SCHEMA).load(kv_path)
    tensors = spark.read.format(fmt).schema(TENSOR_SCHEMA).load(tensor_path)
    return kv, tensors
