"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the folder that all executors share and read it back: later rounds never compute it again.

    The folder is the one in spark.checkpoint.dir; where that is unset, as in tests, a local one is made and set."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
