"""Sinks: CSV files with fixed columns, and GeoJSON built of Spark's JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polyline
from ..functions.time import local
from ..operators.activity import label_points

#: Columns of the CSV files, in order.
TRIP_POINTS = ["id", "uuid", "trip", "latitude", "longitude", "h_accuracy", "timestamp_UTC", "timestamp_epoch", "trip_distance", "distance", "break_period", "trip_code"]
TRIP_SUMMARIES = ["uuid", "trip_id", "start_UTC", "start", "end_UTC", "end", "trip_code", "olat", "olon", "dlat", "dlon", "merge_codes", "direct_distance", "cumulative_distance"]
COMPLETE_DAYS = ["uuid", "date_UTC", "has_trips", "is_complete", "start_latitude", "start_longitude", "end_latitude", "end_longitude", "consecutive_inactive_days", "inactivity_streak"]

ACTIVITY_SUMMARIES = [
    "uuid", "start_timestamp", "end_timestamp", "complete_days", "incomplete_days", "inactive_days", "num_trips", "avg_trips_per_day", "total_trips_distance_m", "avg_trip_distance_m",
    "total_trips_duration_s", "dwell_time_home_s", "dwell_time_work_s", "dwell_time_study_s", "commute_time_study_s", "commute_time_work_s",
]
ACTIVITIES_DAILY = ["uuid", "date", "start_time", "end_time", "num_trips", "num_points", "trips_distance_m", "trips_duration_s"]
ACTIVITY_LOCATIONS = ["UUID", "Label", "Latitude", "Longitude"]
CONDENSED_TRIPS = [
    "uuid", "trip_id", "start_UTC", "start", "end_UTC", "end", "trip_code", "trip_type", "olat", "olon", "dlat", "dlon", "olocation", "dlocation", "direct_distance", "cumulative_distance", "complete_day",
]


def csv(df: DataFrame, path: str, columns: list[str], append: bool = False, one_file: bool = False) -> None:
    """Write `columns` (absent ones empty) as CSV with a header; booleans become 0 and 1."""
    kinds = dict(df.dtypes)
    value = lambda c: F.col(c).cast("int").alias(c) if kinds.get(c) == "boolean" else F.col(c) if c in kinds else F.lit(None).cast("string").alias(c)
    out = df.select(*[value(c) for c in columns])
    (out.coalesce(1) if one_file else out).write.mode("append" if append else "overwrite").csv(path, header=True)


def banner_csv(df: DataFrame, path: str, columns: list[str], banners: list[list], append: bool = False) -> None:
    """CSV lines under one or more title rows; the titles and the header are a part file of their own, all tasks write the rest."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    value = lambda c: F.col(c).cast("int" if kinds[c] == "boolean" else "string").alias(c) if c in kinds else F.lit(None).cast("string").alias(c)
    line = lambda row: F.to_csv(F.struct(*[F.lit(x).cast("string").alias(f"c{i}") for i, x in enumerate(row)]))
    if not append:
        spark.range(1).select(F.explode(F.array(*[line(r) for r in (*banners, columns)])).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    df.select(F.to_csv(F.struct(*[value(c) for c in columns])).alias("value")).write.mode("append").text(path)


def trip_rows(diary: DataFrame, start: int = 1) -> DataFrame:
    """The columns of TRIP_POINTS from a phone diary; ids run from `start` through users, trips and points.

    Users' first ids come from one running sum over a row for each user; points are numbered within their user."""
    sizes = diary.groupBy("user_id").agg(F.count("*").alias("_n"))
    first = sizes.select("user_id", (F.sum("_n").over(Window.orderBy("user_id")) - F.col("_n")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("user_id").orderBy("trip_num", "seq"))
    df = diary.withColumn("_own", own).join(first, "user_id")
    accuracy = F.when(F.col("trip_code").between(101, 199), F.lit(-1.0))
    if "h_accuracy" in diary.columns:
        accuracy = F.coalesce("h_accuracy", accuracy)
    return df.select(
        (F.col("_first") + F.col("_own") + start - 1).alias("id"), F.lit(None).cast("string").alias("uuid"), F.col("trip_num").alias("trip"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        accuracy.alias("h_accuracy"), F.timestamp_seconds("t").cast("timestamp_ntz").alias("timestamp_UTC"), F.col("t").alias("timestamp_epoch"), "trip_distance",
        F.col("distance_before").alias("distance"), F.col("period_before").alias("break_period"), "trip_code",
    )


def summary_rows(summaries: DataFrame) -> DataFrame:
    """The columns of TRIP_SUMMARIES from stitch.diary_summaries()."""
    return summaries.withColumnRenamed("user_id", "uuid").select(*TRIP_SUMMARIES)


def day_rows(days: DataFrame) -> DataFrame:
    """The columns of COMPLETE_DAYS from days with start and end points; the end takes the start's coordinates, as the format's readers expect."""
    at = {f"{end}_{k}": F.col(f"start.{c}") if "start" in days.columns else F.lit(None).cast("double") for end in ("start", "end") for k, c in (("latitude", "lat"), ("longitude", "lon"))}
    return days.withColumns(at).withColumnsRenamed({"user_id": "uuid", "date": "date_UTC"}).select(*COMPLETE_DAYS)


def activity_rows(condensed: DataFrame, summaries: DataFrame) -> DataFrame:
    """The columns of ACTIVITY_SUMMARIES from activity.condensed() and the trips' summaries."""
    far = summaries.where("trip_code < 100").groupBy("user_id").agg(F.round(F.sum("cumulative_distance"), 3).alias("total_trips_distance_m"), F.round(F.avg("cumulative_distance"), 3).alias("avg_trip_distance_m"))
    df = condensed.join(far, "user_id", "left").withColumnsRenamed({
        "user_id": "uuid", "first_seen": "start_timestamp", "last_seen": "end_timestamp", "total_commute_s": "total_trips_duration_s",
        **{f"stay_time_{x}_s": f"dwell_time_{x}_s" for x in ("home", "work", "study")},
    })
    return df.select(*ACTIVITY_SUMMARIES)


def daily_rows(daily: DataFrame, points: DataFrame, timezone: str, extra: list[str] | None = None) -> DataFrame:
    """The columns of ACTIVITIES_DAILY, and `extra` ones, from activity.daily(); start and end are the day's first and last point."""
    at = local(F.timestamp_seconds("t").cast("timestamp_ntz"), timezone)
    seen = points.groupBy("user_id", F.to_date(at).alias("date")).agg(F.min(at).alias("start_time"), F.max(at).alias("end_time"))
    return daily.join(seen, ["user_id", "date"], "left").withColumnRenamed("user_id", "uuid").select(*ACTIVITIES_DAILY, *(extra or []))


def location_rows(locations: DataFrame) -> DataFrame:
    """The columns of ACTIVITY_LOCATIONS from user_id, label, lat and lon."""
    return locations.select(F.col("user_id").alias("UUID"), F.col("label").alias("Label"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"))


def condensed_trip_rows(summaries: DataFrame, days: DataFrame, locations: DataFrame, proximity_m: float = 50.0) -> DataFrame:
    """The columns of CONDENSED_TRIPS: both ends labelled by the first location in reach, and whether the local date is a complete day."""
    out = summaries
    for end in ("o", "d"):
        ends = out.select("user_id", F.col("trip_id").alias("point_id"), F.col(f"{end}lat").alias("lat"), F.col(f"{end}lon").alias("lon"))
        found = label_points(ends, locations, proximity_m, last=False, out=f"{end}location")
        out = out.join(found.select("user_id", F.col("point_id").alias("trip_id"), f"{end}location"), ["user_id", "trip_id"])
    out = out.withColumn("date", F.to_date("start")).join(days.select("user_id", "date", F.col("is_complete").alias("complete_day")), ["user_id", "date"], "left")
    out = out.withColumns({"trip_type": F.when(F.col("trip_code") < 100, "complete").otherwise("missing"), "complete_day": F.coalesce("complete_day", F.lit(False))})
    return out.withColumnRenamed("user_id", "uuid").select(*CONDENSED_TRIPS)


def point_feature(lon: Column, lat: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def line_features(points: DataFrame, key: list[str], properties: list[str]) -> DataFrame:
    """A LineString for each trip: the points of one trip in the order of seq."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "longitude", "latitude"))), lambda p: F.array(p["longitude"], p["latitude"]))
    rows = points.groupBy(*key).agg(line.alias("xy"), *[F.first(c).alias(c) for c in properties])
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("xy").alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*key, *properties).alias("properties"))).alias("value"))


def geojson_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON, a feature in each line, written by all tasks."""
    features.write.mode("overwrite").text(path)


def map_match_request(points: DataFrame) -> DataFrame:
    """user_id, trip_num, coordinates, radiuses, timestamps: the parts of a map matcher's request for each trip."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "longitude", "latitude", "h_accuracy", "t")))
    join = lambda f: F.array_join(F.transform("p", f), ";")
    rows = points.groupBy("user_id", "trip_num").agg(ordered.alias("p"))
    return rows.select(
        "user_id", "trip_num", join(lambda p: F.concat_ws(",", p["longitude"].cast("string"), p["latitude"].cast("string"))).alias("coordinates"),
        join(lambda p: p["h_accuracy"].cast("string")).alias("radiuses"), join(lambda p: p["t"].cast("string")).alias("timestamps"),
    )


#: The map matcher's answer.
MATCH = "struct<tracepoints: array<struct<location: array<double>, name: string, matchings_index: int, waypoint_index: int>>, matchings: array<struct<confidence: double, geometry: string, legs: array<struct<weight: double>>>>>"


def matched_points(answers: DataFrame, json: str = "json") -> DataFrame:
    """A row for each matched point: position, name and the weight of the leg that leads to it (first: 0)."""
    df = answers.withColumn("_a", F.from_json(json, MATCH)).select("*", F.posexplode("_a.tracepoints").alias("seq", "_p")).where(F.col("_p").isNotNull())
    leg = F.get(F.get(F.col("_a.matchings"), F.col("_p.matchings_index"))["legs"], F.col("_p.waypoint_index") - 1)["weight"]
    return df.select(
        *[c for c in answers.columns if c != json], "seq", F.get("_p.location", 0).alias("longitude"), F.get("_p.location", 1).alias("latitude"), F.col("_p.name").alias("name"),
        F.when(F.col("_p.waypoint_index") > 0, F.coalesce(leg, F.lit(0.0))).otherwise(0.0).alias("weight"),
    )


def matched_lines(answers: DataFrame, json: str = "json") -> DataFrame:
    """A LineString for each matching of an answer: matching, confidence, weight (of all its legs) and line, an array of (lon, lat) arrays."""
    df = answers.withColumn("_a", F.from_json(json, MATCH)).select("*", F.posexplode("_a.matchings").alias("matching", "_m"))
    line = F.transform(polyline.decode(F.col("_m.geometry")), lambda p: F.array(p["lon"], p["lat"]))
    weight = F.aggregate("_m.legs", F.lit(0.0), lambda acc, leg: acc + F.coalesce(leg["weight"], F.lit(0.0)))
    return df.select(*[c for c in answers.columns if c != json], "matching", F.col("_m.confidence").alias("confidence"), weight.alias("weight"), line.alias("line"))
