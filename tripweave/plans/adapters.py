"""Views of the driver's tables as points, places and surveys (fixed integer arithmetic, the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import with_utm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spot(key: str, a: int, b: int, scale: float) -> dict:
    at = lambda k: (F.col(key) * k % 1000) / F.lit(float(scale))
    return {"lat": F.lit(45.45) + at(a), "lon": F.lit(-73.65) + at(b)}


def points(spark: SparkSession, sf_dir: str, scale: float = 100000.0, clock: int = 100) -> DataFrame:
    """Events as points; `scale` sets how far apart they lie, `clock` by how much time is compressed."""
    df = table(spark, sf_dir, "events").withColumn("t", F.expr(f"unix_micros(cast(ts as timestamp)) div {clock * 1000000}"))
    df = df.select("user_id", F.col("event_id").alias("point_id"), "t", (F.col("value") / F.lit(5.0)).alias("h_accuracy"), "value", *[v.alias(k) for k, v in _spot("event_id", 37, 91, scale).items()])
    return with_utm(df)


def entrances(spark: SparkSession, sf_dir: str, scale: float = 100000.0) -> DataFrame:
    """Suppliers as subway entrances."""
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id"), *[v.alias(k) for k, v in _spot("s_suppkey", 53, 17, scale).items()])
    return with_utm(df)


def surveys(spark: SparkSession, sf_dir: str, scale: float = 100000.0) -> DataFrame:
    """Customers as survey answers with home, work and study (none for some)."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    out = {}
    for label, (a, b) in {"home": (37, 91), "work": (59, 13), "study": (71, 29)}.items():
        spot = _spot("user_id", a, b, scale)
        none = F.col("user_id") % 4 == 0 if label == "study" else F.lit(False)
        out |= {f"location_{label}_{k}": F.when(~none, v) for k, v in spot.items()}
    return df.withColumns(out)
