"""One object for a survey: ingest, users, and the operators' results as tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import clean, segment
from .sources import csv
from .sources.catalog import Catalog, Ids, with_row_ids


class Survey:
    """A survey's tables under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.config, self.tables = spark, config or Config(), Catalog(spark, root)
        self.ids = Ids(spark, root, "user_ids")

    def ingest_phone(self, folder: str, force: bool = False) -> None:
        """Read a phone survey's export; tables that exist stay unless `force`."""
        readers = {
            "survey_responses": csv.survey_responses, "coordinates": csv.coordinates, "prompt_responses": csv.prompt_responses, "cancelled_prompts": csv.cancelled_prompts,
        }
        for name, read in readers.items():
            if force or not self.tables.exists(name):
                self.tables.save(name, read(self.spark, os.path.join(folder, f"{name}.csv")))

    def ingest_logger(self, folder: str, force: bool = False) -> None:
        """Read a logger survey: points, constant survey rows, and locations."""
        if force or not self.tables.exists("coordinates"):
            points = csv.logger_coordinates(self.spark, os.path.join(folder, "coordinates.csv"))
            self.tables.save("coordinates", points)
            self.tables.save("survey_responses", csv.null_survey(points))
            self.ids.assign(points, "orig_id")  # names keep their numbers when the survey is read again
            self.tables.save("user_locations", csv.user_locations(self.spark, os.path.join(folder, "locations.csv")))

    def drop(self, keep_locations: bool = True) -> None:
        """Delete the survey's tables; stored locations stay unless told otherwise, as in the tools at hand."""
        for name in ("survey_responses", "coordinates", "prompt_responses", "cancelled_prompts", "detected_trips", "trip_day_summaries", "subway_entrances", *(() if keep_locations else ("user_locations",))):
            self.tables.drop(name)

    def check_setup(self) -> None:
        if not self.tables.exists("survey_responses"):
            raise RuntimeError("no survey has been read into this folder yet")

    def users(self, limit: int | None = None) -> DataFrame:
        """Survey rows of users with points."""
        self.check_setup()
        return self.tables.users_with_points("survey_responses", "coordinates", limit)

    def points(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """All users' points in the columns of the operators, with UTM coordinates."""
        df = self.tables.read("coordinates").select(
            "user_id", F.xxhash64("user_id", "timestamp_UTC", "latitude", "longitude").alias("point_id"),
            F.col("timestamp_epoch").alias("t"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "h_accuracy", "speed",
        )
        return clean.with_utm(clean.in_time_range(clean.utm_range(df), start, end))

    def segments(self) -> DataFrame:
        """Accuracy-filtered points, segmented on time gaps."""
        return segment.gap_segments(clean.accuracy_filter(self.points(), self.config.accuracy_cutoff_m), self.config.break_interval_s)

    def load_trips(self, user_id=None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Stored trip points of a user, or of all, within a time range, in the order of trips and points."""
        rows = self.tables.read("detected_trips") if user_id is None else self.tables.user("detected_trips", user_id)
        return clean.in_time_range(rows, start, end).orderBy("user_id", "trip_num", "seq")

    def load_days(self, user_id=None) -> DataFrame:
        """Stored day summaries of a user, or of all, by date."""
        rows = self.tables.read("trip_day_summaries") if user_id is None else self.tables.user("trip_day_summaries", user_id)
        return rows.orderBy("user_id", "date")

    def save_entrances(self, stations: DataFrame) -> None:
        """Store subway entrances (latitude, longitude), equal positions once, numbered in their order."""
        rows = stations.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
        Catalog(self.spark, self.tables.root, key="place_id").save("subway_entrances", with_row_ids(rows, ["lat", "lon"], out="place_id"))

    def load_entrances(self) -> DataFrame:
        """place_id, lat, lon, easting and northing of the stored entrances."""
        return clean.with_utm(self.tables.read("subway_entrances"))

    def load_locations(self, user_id=None) -> DataFrame:
        """Stored activity locations of a user, or of all: label, lat, lon, easting, northing."""
        rows = self.tables.read("user_locations") if user_id is None else self.tables.user("user_locations", user_id)
        return clean.with_utm(rows.withColumnsRenamed({"latitude": "lat", "longitude": "lon"}))

    def save_trips(self, trip_points: DataFrame) -> None:
        """Replace the trips of the users that `trip_points` has, in one step; its rows get ids that follow on those given before."""
        start = 1
        if self.tables.exists("detected_trips"):
            start = (self.tables.read("detected_trips").agg(F.max("id")).first()[0] or 0) + 1
        self.tables.replace_users("detected_trips", with_row_ids(trip_points, ["user_id", "trip_num", "seq"], start))

    def save_days(self, days: DataFrame) -> None:
        """Replace the day summaries of the users in `days`; users without any keep theirs.

        Where days name the points they start and end with (start_point_id and
        end_point_id, points of stored trips), these become the stored rows' ids."""
        rows = days.withColumn("timezone", F.lit(self.config.timezone))
        if {"start_point_id", "end_point_id"} <= set(days.columns):
            ids = self.tables.read("detected_trips").where("point_id is not null").select("user_id", "point_id", "id")
            for c in ("start_point_id", "end_point_id"):
                rows = rows.join(ids.toDF("user_id", c, "_id"), ["user_id", c], "left").drop(c).withColumnRenamed("_id", c)
        self.tables.replace_users("trip_day_summaries", rows)

    def clear_trips(self, users: DataFrame | None = None) -> None:
        """Drop the trips of the users given, or all."""
        if users is None:
            self.tables.clear("detected_trips")
        else:
            self.tables.delete_users("detected_trips", users)
