"""Segmentation on time gaps, and what it yields per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .clean import by_time


def gap_segments(points: DataFrame, gap_s: int) -> DataFrame:
    """Add period_before (s), distance_before (m) and segment_group (from 0): a gap longer than `gap_s` starts a segment."""
    df = points.withColumns({f"_{c}": F.lag(c).over(by_time()) for c in ("t", "easting", "northing")})
    df = df.withColumns({
        "period_before": F.coalesce(F.col("t") - F.col("_t"), F.lit(0)),
        "distance_before": F.coalesce(F.round(F.expr(geo.planar("_easting", "_northing", "easting", "northing")), 3), F.lit(0.0)),
    })
    starts = F.sum((F.col("period_before") > gap_s).cast("long")).over(by_time())
    return df.withColumn("segment_group", starts).drop("_t", "_easting", "_northing")


def logger_segments(points: DataFrame, gap_s: int) -> DataFrame:
    """The same without each user's first point, which the logger rule discards."""
    return gap_segments(points, gap_s).withColumn("_n", F.row_number().over(by_time())).where("_n > 1").drop("_n")


def summaries(points: DataFrame, key: str = "segment_group") -> DataFrame:
    """A row for each segment or trip: ends, number of points, direct and cumulative distance (without the gap before it).

    One aggregation: the points that start and end it are minima and maxima of structs."""
    order = F.struct("t", "point_id", "lat", "lon", "easting", "northing", "distance_before", *[c for c in ("period_before", "h_accuracy") if c in points.columns])
    df = points.groupBy("user_id", key).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_points"), F.sum("distance_before").alias("_sum"),
        F.min(F.struct("t", "point_id", "distance_before")).alias("_lead"),
    )
    direct = F.round(F.expr(geo.planar("first.easting", "first.northing", "last.easting", "last.northing")), 3)
    cumulative = F.round(F.col("_sum") - F.col("_lead.distance_before"), 3)
    return df.withColumns({"direct_distance": direct, "cumulative_distance": cumulative}).drop("_sum", "_lead")


def short_extent(points: DataFrame, min_m: float, key: str = "segment_group") -> DataFrame:
    """Points of the segments that reach farther than `min_m` from their centroid."""
    w = Window.partitionBy("user_id", key)
    df = points.withColumns({"_ce": F.avg("easting").over(w), "_cn": F.avg("northing").over(w)})
    df = df.withColumn("_d", F.max(F.expr(geo.planar("_ce", "_cn", "easting", "northing"))).over(w))
    return df.where(F.col("_d") > min_m).drop("_ce", "_cn", "_d")


def missing_between(trips: DataFrame, min_m: float = 250.0, key: str = "segment_group") -> DataFrame:
    """Jumps of more than `min_m` between consecutive segments: user_id, key of the later one, from, to, distance."""
    w = Window.partitionBy("user_id").orderBy(key)
    df = trips.withColumn("from", F.lag("last").over(w))
    df = df.withColumn("distance", F.round(F.expr(geo.planar("`from`.easting", "`from`.northing", "first.easting", "first.northing")), 3))
    return df.where(F.col("distance") > min_m).select("user_id", key, "from", F.col("first").alias("to"), "distance")
