"""CSV sources: phone survey exports, logger files, stations, locations, and local-time files.

Everything is read as text with the file's own header and then renamed, cleaned
and cast by column expressions, so that a scan is one pass without inference."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tables that the exports fill, with their Spark types.
SURVEY = {
    "created_at_UTC": "timestamp_ntz", "modified_at_UTC": "timestamp_ntz", "itinerum_version": "string", "location_home_lat": "double",
    "location_home_lon": "double", "location_study_lat": "double", "location_study_lon": "double", "location_work_lat": "double",
    "location_work_lon": "double", "member_type": "string", "model": "string", "os": "string", "os_version": "string",
    "travel_mode_study_primary": "string", "travel_mode_study_secondary": "string", "travel_mode_work_primary": "string", "travel_mode_work_secondary": "string",
}
COORDINATES = {
    "latitude": "double", "longitude": "double", "altitude": "double", "speed": "double", "direction": "double", "h_accuracy": "double",
    "v_accuracy": "double", "acceleration_x": "double", "acceleration_y": "double", "acceleration_z": "double", "point_type": "string",
    "mode_detected": "string", "timestamp_UTC": "timestamp_ntz", "timestamp_epoch": "bigint",
}
PROMPTS = {
    "prompt_uuid": "string", "prompt_num": "int", "response": "string", "latitude": "double", "longitude": "double", "displayed_at_UTC": "timestamp_ntz",
    "recorded_at_UTC": "timestamp_ntz", "edited_at_UTC": "timestamp_ntz",
}
CANCELLED = {"prompt_uuid": "string", "latitude": "double", "longitude": "double", "displayed_at_UTC": "timestamp_ntz", "cancelled_at_UTC": "timestamp_ntz", "is_travelling": "boolean"}
TRIPS = {
    "trip_num": "int", "trip_code": "int", "latitude": "double", "longitude": "double", "h_accuracy": "double", "distance_before": "double",
    "trip_distance": "double", "period_before": "int", "timestamp_UTC": "timestamp_ntz",
}
MODES = {"travel_mode_work": "travel_mode_work_primary", "travel_mode_alt_work": "travel_mode_work_secondary", "travel_mode_study": "travel_mode_study_primary", "travel_mode_alt_study": "travel_mode_study_secondary"}
LOGGER = ["INDEX", "UTC_DATE", "UTC_TIME", "LOCAL_DATE", "LOCAL_TIME", "LATITUDE", "N/S", "LONGITUDE", "E/W", "ALTITUDE", "SPEED", "USER"]
LATLON = [("latitude", "longitude"), ("lat", "lng"), ("lat", "lon"), ("y", "x")]


def scan(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; a byte order mark before the first header goes."""
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def uuid_hex(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))


def _typed(df: DataFrame, kinds: dict[str, str], null_blanks: bool = True) -> DataFrame:
    missing = [c for c in kinds if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    value = lambda c: blank_to_null(F.col(f"`{c}`")) if null_blanks else F.col(f"`{c}`")
    return df.select(uuid_hex(F.col("uuid")).alias("user_id"), *[value(c).try_cast(k).alias(c) for c, k in kinds.items()])


def survey_responses(spark: SparkSession, path: str) -> DataFrame:
    """Answers with a member type; other columns than the table's go."""
    df = scan(spark, path).withColumnsRenamed(MODES)
    return _typed(df.where(blank_to_null(F.col("member_type")).isNotNull()), SURVEY)


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Points with a time."""
    df = scan(spark, path)
    return _typed(df.where(blank_to_null(F.col("timestamp_UTC")).isNotNull()), COORDINATES)


def prompt_responses(spark: SparkSession, path: str) -> DataFrame:
    return _typed(scan(spark, path), PROMPTS)


def cancelled_prompts(spark: SparkSession, path: str) -> DataFrame:
    return _typed(scan(spark, path), CANCELLED)


def detected_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trip points of a platform's export."""
    return _typed(scan(spark, path).withColumnsRenamed({"trip": "trip_num", "timestamp": "timestamp_UTC"}), TRIPS)


def user_key(c: Column) -> Column:
    """A stable id of a logger's user name: the first 32 hex digits of its SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 32)


def user_key_of(name: str) -> str:
    return hashlib.sha1(name.encode()).hexdigest()[:32]


def logger_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Logger points by the fixed header: signs from the hemispheres, two-digit years, zero positions dropped."""
    schema = ", ".join(f"`{c}` string" for c in LOGGER)
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    lat, lon = blank_to_null(F.col("LATITUDE")).try_cast("double"), blank_to_null(F.col("LONGITUDE")).try_cast("double")
    df = df.withColumns({"latitude": lat, "longitude": lon}).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    df = df.where(~((F.col("latitude").cast("int") == 0) & (F.col("longitude").cast("int") == 0)))
    day, hour = F.split("UTC_DATE", "/"), F.split("UTC_TIME", ":")
    year = F.when(F.length(day[0]) <= 2, F.lpad(day[0], 2, "0").cast("int") + 2000).otherwise(day[0].cast("int"))
    ts = F.expr("make_timestamp_ntz(y, mo, d, h, mi, s)")
    df = df.withColumns({"y": year, "mo": day[1].cast("int"), "d": day[2].cast("int"), "h": hour[0].cast("int"), "mi": hour[1].cast("int"), "s": hour[2].cast("decimal(8,6)")})
    signed = lambda c, mark, word: F.when((F.col(c) > 0) & (F.upper(F.trim(F.col(f"`{mark}`"))) == word), -F.col(c)).otherwise(F.col(c))
    return df.select(
        user_key(F.col("USER")).alias("user_id"), F.col("USER").alias("orig_id"), signed("latitude", "N/S", "S").alias("latitude"), signed("longitude", "E/W", "W").alias("longitude"),
        blank_to_null(F.col("ALTITUDE")).try_cast("double").alias("altitude"), blank_to_null(F.regexp_replace("SPEED", "[^0-9.+-]", "")).try_cast("double").alias("speed"),
        F.lit(None).cast("double").alias("h_accuracy"), ts.alias("timestamp_UTC"), (F.unix_micros(ts.cast("timestamp")) / 1000000).cast("long").alias("timestamp_epoch"),
    )


def null_survey(coordinates_df: DataFrame) -> DataFrame:
    """Survey rows with constants, one for each user that has points."""
    fixed = {c: F.lit(None).cast(k) for c, k in SURVEY.items()}
    fixed |= {c: F.lit("2000-01-01").cast("timestamp_ntz") for c in ("created_at_UTC", "modified_at_UTC")} | {c: F.lit("-1") for c in ("itinerum_version", "member_type", "model", "os", "os_version")}
    return coordinates_df.select("user_id").distinct().select("user_id", *[v.alias(c) for c, v in fixed.items()])


def _sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A small file with ; or , between columns; headers in lower case."""
    head = spark.read.text(path).first()
    df = scan(spark, path, ";" if head and head[0].count(";") > head[0].count(",") else ",")
    return df.toDF(*[c.lower() for c in df.columns])


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Subway stations: place_id, latitude, longitude; the last known pair of header names counts, repeated positions go."""
    df = _sniffed(spark, path)
    pairs = [p for p in LATLON if set(p) <= set(df.columns)]
    if not pairs:
        raise ValueError(f"no coordinates among the columns {df.columns}")
    lat, lon = pairs[-1]
    df = df.select(F.col(lat).cast("double").alias("latitude"), F.col(lon).cast("double").alias("longitude")).dropDuplicates()
    return df.withColumn("place_id", F.xxhash64("latitude", "longitude"))


def user_locations(spark: SparkSession, path: str) -> DataFrame:
    """user_id, label, latitude, longitude of logger users; rows without a user go."""
    df = _sniffed(spark, path).where(blank_to_null(F.col("user")).isNotNull())
    label = blank_to_null(F.col("label")) if "label" in df.columns else F.lit(None).cast("string")
    return df.select(user_key(F.trim("user")).alias("user_id"), label.alias("label"), F.col("latitude").cast("double"), F.col("longitude").cast("double"))


def utc_normalised(df: DataFrame, dt_columns: list[str], timezone: str, expected: list[str] = (), rename: dict[str, str] | None = None, split_locations: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Local times to UTC (empty and zero times: 1999-01-01), renamed and missing columns, "lat,lon" columns split."""
    df = df.withColumnsRenamed(rename or {})
    for c in dt_columns:
        v = F.trim(F.col(c))
        utc = F.to_utc_timestamp(F.to_timestamp(v), timezone).cast("timestamp_ntz")
        df = df.withColumn(c, F.when(v.isNull() | v.isin("", "0000-00-00 00:00:00"), F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).otherwise(utc))
    for c, (lat, lon) in (split_locations or {}).items():
        parts = F.split(F.col(c), ",")
        df = df.withColumns({lat: F.trim(F.get(parts, 0)).try_cast("double"), lon: F.trim(F.get(parts, 1)).try_cast("double")}).drop(c)
    return df.withColumns({c: F.lit(None).cast("string") for c in expected if c not in df.columns})
