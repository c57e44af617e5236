"""Logger trips: segments split where a stop location is stayed at, short ones dropped, gaps between them as trips.

All rules are windows: runs of points inside and outside of locations, and which
points of a stay lead towards its location."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .automaton import two_state
from .clean import by_time
from .segment import logger_segments

NEAR_M, REACH_M = 60.0, 200.0


def _located(points: DataFrame, locations: DataFrame) -> DataFrame:
    """Add stop: the first of the user's locations within NEAR_M (place_order, label, position), else null.

    A user's locations are one row, so that the points before are computed once, not once for either side of a join."""
    spots = locations.groupBy("user_id").agg(F.collect_list(F.struct("place_order", "label", F.col("easting").alias("e"), F.col("northing").alias("n"))).alias("_spots"))
    near = F.filter("_spots", lambda q: F.sqrt(F.pow(F.col("easting") - q["e"], 2) + F.pow(F.col("northing") - q["n"], 2)) <= NEAR_M)
    return points.join(spots, "user_id", "left").withColumn("stop", F.array_min(near)).drop("_spots")


def stop_split(segments: DataFrame, locations: DataFrame, period_s: int = 300) -> DataFrame:
    """Points with piece: a stay of `period_s` or more at a location splits a segment.

    Of the stay the piece before gets the approach and the piece after the
    departure: the first and second half as far as they lead towards the
    location and lie within `period_s`. Passing by splits nothing. What a user's
    last segment ends with at a location is an approach too."""
    seg = Window.partitionBy("user_id", "segment_group").orderBy("t", "point_id")
    p = _located(segments, locations).withColumn("inside", F.col("stop").isNotNull())
    p = p.withColumn("_new", F.coalesce((F.lag("inside").over(seg) != F.col("inside")).cast("long"), F.lit(0)))
    p = p.withColumn("stay", F.sum("_new").over(seg)).drop("_new")
    p = p.withColumns({"_before": F.lag("t").over(seg), "_after": F.lead("t").over(seg)})
    stay = Window.partitionBy("user_id", "segment_group", "stay")
    p = p.withColumns({
        "_lasts": F.max("t").over(stay) - F.min("t").over(stay),
        "_final": F.col("stay") == F.max("stay").over(Window.partitionBy("user_id", "segment_group")),
        "_end": F.col("segment_group") == F.max("segment_group").over(Window.partitionBy("user_id")),
    })
    splits = F.col("inside") & ~F.col("_final") & (F.col("_lasts") >= period_s)
    p = p.withColumns({"_splits": splits, "_ends": F.col("inside") & F.col("_final") & F.col("_end")})
    first = F.col("_splits") & (F.row_number().over(stay.orderBy("t", "point_id")) == 1)
    earlier = F.sum(F.col("_first").cast("long")).over(seg)
    p = p.withColumn("_first", first).withColumn("piece", earlier - F.col("_splits").cast("long"))

    # The location of a stay is that of most of its points, of the first seen among equals.
    same = Window.partitionBy("user_id", "segment_group", "stay", "stop.label")
    p = p.withColumns({"_i": F.row_number().over(stay.orderBy("t", "point_id")), "_n": F.count("*").over(stay)})
    p = p.withColumns({"_of": F.count("*").over(same), "_seen": F.min("_i").over(same)})
    p = p.withColumn("_spot", F.min(F.struct(-F.col("_of"), "_seen", "_i", "stop.e", "stop.n")).over(stay))
    p = p.withColumns({"_came": F.max(F.when(F.col("_i") == 1, F.col("_before"))).over(stay), "_left": F.max(F.when(F.col("_i") == F.col("_n"), F.col("_after"))).over(stay)})
    # Each half leads towards the location as long as it comes nearer to its own first point within reach; the second is read backwards.
    p = p.withColumn("_side", (F.col("_i") > F.bround(F.col("_n") / 2)).cast("int"))
    p = p.withColumn("_o", F.when(F.col("_side") == 0, F.col("_i")).otherwise(-F.col("_i")))
    half = Window.partitionBy("user_id", "segment_group", "stay", "_side")
    within = F.expr(geo.planar("_spot.e", "_spot.n", "easting", "northing")) <= REACH_M
    p = p.withColumn("_anchor", F.min(F.when(within, F.struct("_o", "easting", "northing"))).over(half))
    p = p.withColumn("_d", F.when(F.col("_o") > F.col("_anchor._o"), F.expr(geo.planar("_anchor.easting", "_anchor.northing", "easting", "northing"))))
    p = p.withColumn("_turns", F.col("_d") >= F.lag("_d").over(half.orderBy("_o")))
    p = p.withColumn("_turn", F.min(F.when(F.col("_turns"), F.col("_o"))).over(half))
    leads = F.col("_turn").isNull() | (F.col("_o") < F.col("_turn"))
    near = F.when(F.col("_side") == 0, F.col("t") - F.col("_came") <= period_s).otherwise(F.col("_splits") & (F.col("_left") - F.col("t") <= period_s))
    trimmed = F.col("_splits") | F.col("_ends")
    p = p.where(~trimmed | F.coalesce(leads & near, F.lit(False))).withColumn("piece", F.col("piece") + F.when(trimmed, F.col("_side")).otherwise(0))
    return p.drop("inside", "stay", *[c for c in p.columns if c.startswith("_")])


def long_pieces(points: DataFrame, min_m: float = 250.0) -> DataFrame:
    """Points of the pieces that reach farther than `min_m` from their centroid, with key: the piece's number in the user's order."""
    w = Window.partitionBy("user_id", "segment_group", "piece")
    df = points.withColumns({"_ce": F.avg("easting").over(w), "_cn": F.avg("northing").over(w)})
    df = df.withColumn("_d", F.max(F.expr(geo.planar("_ce", "_cn", "easting", "northing"))).over(w)).where(F.col("_d") > min_m)
    key = F.dense_rank().over(Window.partitionBy("user_id").orderBy("segment_group", "piece"))
    return df.withColumn("key", key.cast("long")).drop("_ce", "_cn", "_d")


def diary(points: DataFrame, missing_m: float = 250.0) -> DataFrame:
    """user_id, trip_num, seq, trip_code (1, or 101 for a gap), point_id (null in gaps), t, lat, lon, trip_distance.

    Trips carry the distance before the current point; a gap of more than
    `missing_m` between consecutive trips is a trip of two points."""
    w = Window.partitionBy("user_id", "key").orderBy("t", "point_id")
    own = points.withColumns({"seq": F.row_number().over(w), "trip_distance": F.round(F.coalesce(F.sum("distance_before").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 3)})
    own = own.select("user_id", "key", F.lit(1).alias("_after"), F.lit(1).alias("trip_code"), "seq", "point_id", "t", "lat", "lon", "trip_distance")
    at = F.struct("t", "point_id", "lat", "lon", "easting", "northing")
    ends = points.groupBy("user_id", "key").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    by = Window.partitionBy("user_id").orderBy("key")
    gaps = ends.withColumn("prev", F.lag("last").over(by))
    gaps = gaps.withColumn("m", F.round(F.expr(geo.planar("prev.easting", "prev.northing", "first.easting", "first.northing")), 3)).where(F.col("m") > missing_m)
    two = F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.col("prev").alias("x"), F.lit(0.0).alias("d")), F.struct(F.lit(2).alias("seq"), F.col("first").alias("x"), F.col("m").alias("d"))))
    gaps = gaps.select("user_id", "key", F.lit(0).alias("_after"), F.lit(101).alias("trip_code"), two.alias("g"))
    gaps = gaps.select("user_id", "key", "_after", "trip_code", "g.seq", F.lit(None).cast("long").alias("point_id"), "g.x.t", "g.x.lat", "g.x.lon", F.col("g.d").alias("trip_distance"))
    num = F.dense_rank().over(Window.partitionBy("user_id").orderBy("key", "_after"))
    return own.unionByName(gaps).withColumn("trip_num", num).drop("key", "_after")


def logger_trips(points: DataFrame, locations: DataFrame, gap_s: int = 300) -> DataFrame:
    """The whole of it: points with easting and northing in, diary out."""
    return diary(long_pieces(stop_split(logger_segments(points, gap_s), locations, gap_s)))


def attribute_stops(points: DataFrame, speed: str = "speed_ms", rest_ms: float = 0.15, turn: float = 90.0, least_trip_s: int = 60, least_stop_s: int = 120, most_ratio: float = 1.0) -> DataFrame:
    """Add label, stop or trip, from speed, delta_heading and duration_s: a point's own speed, smoothed by the label of the point before and the speed or turn of the next.

    Between two stops only a trip point of `least_trip_s` or longer stays one,
    between two trips only a stop point of `least_stop_s`; a trip point between
    trip and stop that is more than (1 + `most_ratio`) times as fast as the one before is a
    stop, as speed should fall there. The first point has no label, the last is a
    stop. A label depends on the label before and on nothing else that went
    before: an automaton of two states."""
    window = by_time()
    own = F.col(speed) <= rest_ms
    next_stop = (F.lead(speed).over(window) <= rest_ms) | (F.lead("delta_heading").over(window) > turn)
    df = points.withColumns({"_own": F.coalesce(own, F.lit(False)), "_next": next_stop, "_before": F.lag(speed).over(window), "_number": F.row_number().over(window), "_more": F.lead("t").over(window).isNotNull()})
    df = df.withColumn("_next", F.when(F.col("_more"), F.coalesce("_next", F.lit(False))))
    trip_stays, stop_stays = F.col("duration_s") >= least_trip_s, F.col("duration_s") >= least_stop_s
    jumps = F.when(F.col("_before") == 0, F.col(speed) > 0).otherwise((F.col(speed) - F.col("_before")) / F.col("_before") > most_ratio)
    free = (F.col("_number") <= 2) | F.col("_next").isNull()  # no label before, or no point after
    after_stop = F.when(free | ~F.col("_next"), F.col("_own")).otherwise(F.col("_own") | ~trip_stays)
    after_trip = F.when(free, F.col("_own")).when(F.col("_next"), F.col("_own") | jumps).otherwise(F.col("_own") & stop_stays)
    df = two_state(df, window, after_trip, after_stop, "_stop")
    label = F.when(~F.col("_more") | F.col("_stop"), "stop").otherwise("trip")
    return df.withColumn("label", F.when((F.col("_number") == 1) & F.col("_more"), None).otherwise(label)).drop("_own", "_next", "_before", "_number", "_more", "_stop")
