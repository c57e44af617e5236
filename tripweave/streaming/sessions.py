"""Gap segments on a stream of points (beyond what batch parity asks for)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_segments(points: DataFrame, gap_s: int, late: str = "1 hour") -> DataFrame:
    """A row for each session of a user's points (column ts, a timestamp): its ends and number of points.

    Points at most `gap_s` apart stay together. A session is emitted once the watermark passes its end."""
    session = F.session_window("ts", f"{gap_s} seconds").alias("session")
    return points.withWatermark("ts", late).groupBy("user_id", session).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_points"))
