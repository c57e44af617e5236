"""The registered queries of the travel-diary operators, on the adapter views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geo, polyline, sql
from ..functions.time import local, split_at_midnight, split_days
from ..operators import activity, clean, cluster, days, density, logger, older, segment, stitch
from . import adapters

C = Config()
WIDE, TIGHT = 10000.0, 100000.0
DAY_GAP = 6 * 3600


def _good(spark, d, scale=TIGHT, clock=100) -> DataFrame:
    return clean.accuracy_filter(adapters.points(spark, d, scale, clock), C.accuracy_cutoff_m)


def _segments(spark, d, scale=TIGHT, clock=100, gap=C.break_interval_s) -> DataFrame:
    return segment.gap_segments(_good(spark, d, scale, clock), gap)


def _trips(spark, d, scale=TIGHT, clock=100, gap=C.break_interval_s) -> DataFrame:
    return segment.summaries(_segments(spark, d, scale, clock, gap))


def _ends(trips: DataFrame, *more) -> DataFrame:
    return trips.select("user_id", "segment_group", *more)


def accuracy_filter(spark, d):
    return _good(spark, d).select("user_id", "point_id", "t", "h_accuracy")


def user_semijoin(spark, d):
    return adapters.surveys(spark, d).join(adapters.points(spark, d).select("user_id").distinct(), "user_id", "left_semi").select("user_id")


def time_range_inclusive(spark, d):
    return clean.in_time_range(adapters.points(spark, d), 17045000, 17055000).select("user_id", "point_id", "t")


def time_range_exclusive(spark, d):
    return clean.in_time_range(adapters.points(spark, d), 17045000, 17055000, exclusive=True).select("user_id", "point_id", "t")


def utm_project(spark, d):
    p = adapters.points(spark, d, WIDE)
    return p.select("point_id", "easting", "northing", F.expr(geo.zone("lat", "lon")).alias("zone"), F.expr(geo.zone_letter("lat")).alias("letter"))


def utm_round_trip(spark, d):
    lat, lon = geo.to_latlon("easting", "northing", "18")
    p = adapters.points(spark, d, WIDE)
    return p.select("point_id", F.round(F.expr(lat) - F.col("lat"), 6).alias("dlat"), F.round(F.expr(lon) - F.col("lon"), 6).alias("dlon"))


def kinematics(spark, d):
    k = clean.kinematics(adapters.points(spark, d, WIDE))
    return k.select("user_id", "point_id", "duration_s", *[F.round(c, 4).alias(c) for c in ("distance_m", "bearing", "delta_heading")])


def haversine_standard(spark, d):
    p = adapters.points(spark, d, WIDE)
    return p.select("point_id", F.round(F.expr(geo.haversine(geo.lit(45.5), geo.lit(-73.6), "lat", "lon", False)), 3).alias("distance_m"))


def gap_segments(spark, d):
    return _segments(spark, d).select("user_id", "point_id", "segment_group", "period_before", F.round("distance_before", 1).alias("distance_before"))


def logger_segments(spark, d):
    return segment.logger_segments(_good(spark, d), C.break_interval_s).select("user_id", "point_id", "segment_group")


def segment_summary(spark, d):
    t = _trips(spark, d)
    return _ends(t, F.col("first.t").alias("start_t"), F.col("last.t").alias("end_t"), "n_points", F.round("direct_distance", 1).alias("direct_distance"), F.round("cumulative_distance", 1).alias("cumulative_distance"))


def short_extent(spark, d):
    return segment.short_extent(_segments(spark, d), C.min_trip_m).select("user_id", "point_id")


def missing_segments(spark, d):
    return segment.missing_between(_trips(spark, d)).select("user_id", "segment_group", F.round("distance", 1).alias("distance"))


def nearest_entrance_first(spark, d):
    p = stitch.within(_good(spark, d), adapters.entrances(spark, d), 100.0)
    return p.select("user_id", "point_id", "place")


def subway_links(spark, d):
    return _ends(stitch.subway_links(_trips(spark, d), adapters.entrances(spark, d)), "condition", "link")


def metro_links_older(spark, d):
    return _ends(stitch.subway_links(_trips(spark, d), adapters.entrances(spark, d), differ=True), "link")


def velocity_links(spark, d):
    return _ends(stitch.velocity_links(_trips(spark, d), 2.0), "condition", "link")


def velocity_links_older(spark, d):
    return _ends(stitch.velocity_links(_trips(spark, d), 2.0, chains=True), "link")


def _rules() -> list:
    return [("subway", stitch.subway_condition()), ("walking", stitch.velocity_condition(2.0))]


def _keyed(spark, d, segments: DataFrame) -> DataFrame:
    return stitch.link_keys(stitch.with_gap(stitch.end_places(segment.summaries(segments), adapters.entrances(spark, d), 200.0)), _rules())


def linked_trips(spark, d):
    trips = stitch.linked_trips(_keyed(spark, d, _segments(spark, d)))
    return trips.select("user_id", F.col("segment_group").alias("trip_key"), "n_points", F.array_join("labels", ",").alias("labels"))


def trip_points(spark, d):
    s = _segments(spark, d)
    linked = s.join(_keyed(spark, d, s).select("user_id", "segment_group", "trip_key"), ["user_id", "segment_group"])
    return stitch.trip_points(linked).select("user_id", "trip_num", "seq", "point_id", F.round("trip_distance", 1).alias("trip_distance"))


def missing_trips(spark, d):
    m = stitch.missing_trips(_trips(spark, d), adapters.entrances(spark, d))
    return m.select("user_id", "segment_group", "kind", F.round("gap_m", 1).alias("gap_m"), "gap_s")


def _coded(spark, d):
    trips = _trips(spark, d)
    gaps = stitch.missing_trips(trips, adapters.entrances(spark, d))
    short = gaps.where("kind = 'too_short'").select("user_id", "segment_group", F.lit(True).alias("_s"))
    trips = trips.join(short, ["user_id", "segment_group"], "left").withColumns({"too_short": F.coalesce("_s", F.lit(False)), "labels": F.array().cast("array<string>")})
    return stitch.trip_codes(trips), gaps


def trip_codes(spark, d):
    return _ends(_coded(spark, d)[0], "trip_code")


def merged_diary(spark, d):
    trips, gaps = _coded(spark, d)
    return stitch.diary(trips, gaps).select("user_id", "trip_num", "trip_code", F.col("first.t").alias("start_t"), F.col("last.t").alias("end_t"))


def _known(spark, d) -> DataFrame:
    return clean.with_utm(activity.unpivot_locations(adapters.surveys(spark, d), ["home", "work", "study"]))


def _diary(spark, d) -> DataFrame:
    good = clean.accuracy_filter(clean.enough_points(adapters.points(spark, d)), C.accuracy_cutoff_m)
    cleaned = segment.gap_segments(clean.spike_filter(good, C.spike_kph), C.break_interval_s)
    return stitch.phone_diary(cleaned, adapters.entrances(spark, d), _rules(), _known(spark, d))


def phone_diary(spark, d):
    p = _diary(spark, d)
    return p.select("user_id", "trip_num", "trip_code", "merge_codes", "seq", "point_id", "t", "lat", "lon", "h_accuracy", "period_before", F.round("trip_distance", 1).alias("trip_distance"))


def trip_summaries(spark, d):
    return stitch.diary_summaries(_diary(spark, d), C.timezone).withColumns({c: F.round(c, 1) for c in ("direct_distance", "cumulative_distance")})


def lone_points(spark, d):
    return stitch.lone_points(_trips(spark, d), _known(spark, d))


def spike_filter(spark, d):
    return clean.spike_filter(_good(spark, d, WIDE), C.spike_kph).select("user_id", "point_id")


def logger_preprocess(spark, d):
    k = clean.logger_preprocess(adapters.points(spark, d, WIDE))
    return k.select("user_id", "point_id", "duration_s", F.round("distance_m", 3).alias("distance_m"))


def rolling_avg(spark, d):
    r = clean.rolling_average(adapters.points(spark, d), "value")
    return r.select("user_id", "point_id", F.round("rolling_avg", 6).alias("rolling_avg"))


def trailing_avg(spark, d):
    r = clean.trailing_average(adapters.points(spark, d), "value")
    return r.select("user_id", "point_id", F.round("trailing_avg", 6).alias("trailing_avg"))


def _day_trips(spark, d) -> DataFrame:
    s = _segments(spark, d, clock=1, gap=DAY_GAP)
    at = F.struct("t", "point_id", "lat", "lon")
    second = F.get(F.array_sort(F.collect_list(at)), 1)  # a segment's own points
    t = s.groupBy("user_id", "segment_group").agg(F.min(at).alias("first"), F.max(at).alias("last"), second.alias("second"))
    return t.withColumns({"trip_num": F.col("segment_group") + 1, "trip_code": F.when(F.col("segment_group") % 5 == 3, 101).otherwise(1)})


def complete_days(spark, d):
    c = days.complete_days(_day_trips(spark, d))
    return c.select("user_id", "date", "has_trips", "is_complete", F.col("n_trips"))


def inactivity(spark, d):
    c = days.inactivity(days.complete_days(_day_trips(spark, d)))
    return c.select("user_id", "date", "consecutive_inactive_days", "first_inactive_day", "inactive_day_streak", "inactivity_streak")


def explained_days(spark, d):
    c = days.explained_days(days.complete_days(_day_trips(spark, d)))
    return c.select("user_id", "date", "is_complete", "explained", days.day_state().alias("state"))


def explained_days_geodesic(spark, d):
    c = days.explained_days(days.complete_days(_day_trips(spark, d)), geodesic=True)
    return c.select("user_id", "date", "explained")


def _places(spark, d):
    return activity.unpivot_locations(adapters.surveys(spark, d), ["home", "work", "study"])


def unpivot_locations(spark, d):
    return _places(spark, d)


def survey_locations(spark, d):
    return activity.survey_locations(adapters.surveys(spark, d), ["home", "work", "study"])


def located_segments(spark, d):
    p = cluster.with_latlon(cluster.centroids(_segments(spark, d), "segment_group"))
    return p.select("user_id", "segment_group", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


def label_points_last(spark, d):
    return activity.label_points(adapters.points(spark, d), _places(spark, d), 300.0).select("user_id", "point_id", "label")


def label_points_first(spark, d):
    return activity.label_points(adapters.points(spark, d), _places(spark, d), 300.0, last=False).select("user_id", "point_id", "label")


def location_overlaps(spark, d):
    return activity.location_overlaps(_places(spark, d), 150.0).withColumn("distance_m", F.round("distance_m", 2))


def _spans(spark, d, dynamic=False):
    p = _segments(spark, d, clock=1, gap=DAY_GAP).withColumn("trip_key", F.col("segment_group"))
    p = activity.label_points(p, _places(spark, d), 400.0)
    return activity.intervals(p, dynamic), p


def commutes_dwells(spark, d):
    return _spans(spark, d)[0].select("user_id", "trip_key", "kind", "label", "start", "end")


def activity_daily(spark, d):
    spans, p = _spans(spark, d)
    df = activity.daily(spans, p, C.timezone)
    return df.withColumn("trips_distance_m", F.round("trips_distance_m", 1))


def activity_daily_pivot(spark, d):
    return activity.daily_pivot(_spans(spark, d, True)[0], ["home", "work", "study"], C.timezone)


def activity_condensed(spark, d):
    a = activity.condensed(_spans(spark, d)[0], days.complete_days(_day_trips(spark, d)))
    return a.withColumn("avg_trips_per_day", F.round("avg_trips_per_day", 6))


def condensed_trips(spark, d):
    t = _day_trips(spark, d)
    return activity.condensed_trips(t, days.complete_days(t)).select("user_id", "trip_num", "trip_type", "date", "complete_day")


def midnight_split(spark, d):
    p = adapters.points(spark, d, clock=1).withColumn("s", F.timestamp_seconds("t").cast("timestamp_ntz")).withColumn("e", F.col("s") + F.expr("interval 9 hours"))
    return split_at_midnight(p, "s", "e").select("point_id", "date", "seconds")


def day_split(spark, d):
    p = adapters.points(spark, d, clock=1).withColumn("s", F.timestamp_seconds("t").cast("timestamp_ntz")).withColumn("e", F.col("s") + F.expr("interval 40 hours"))
    return split_days(p, "s", "e").select("point_id", "date", "seconds")


def local_dates(spark, d):
    p = adapters.points(spark, d, clock=1)
    return p.groupBy("user_id", F.to_date(local(F.timestamp_seconds("t").cast("timestamp_ntz"), C.timezone)).alias("date")).agg(F.count("*").alias("n_points"))


def kmeans_runs(spark, d):
    p = cluster.short_stops(cluster.runs(cluster.two_means(adapters.points(spark, d), "value")), C.stop_min_s)
    return p.select("user_id", "point_id", "kmeans", "run")


def heading_stops(spark, d):
    k = adapters.points(spark, d).withColumn("delta_heading", F.col("value"))
    return cluster.heading_stops(k).select("user_id", "point_id", "stop")


def stop_centroids(spark, d):
    return cluster.centroids(_segments(spark, d), "segment_group").withColumns({c: F.round(c, 1) for c in ("easting", "northing")})


def _rounded(places: DataFrame) -> DataFrame:
    """To decimetres, as means of millimetres can differ in the last of them."""
    return places.withColumns({c: F.round(c, 1) for c in ("easting", "northing")})


def condensed_places(spark, d):
    return _rounded(cluster.condense(cluster.centroids(_segments(spark, d), "segment_group"), "segment_group"))


def activity_locations(spark, d):
    p = adapters.points(spark, d)
    stops = cluster.short_stops(cluster.runs(cluster.two_means(p, "value")), 0).where("kmeans = 'stop'")
    heads = cluster.heading_stops(p.withColumn("delta_heading", F.col("value")))
    return _rounded(cluster.activity_locations(cluster.centroids(stops, "run"), cluster.centroids(heads, "stop"), "run", "stop"))


def dbscan(spark, d):
    return cluster.dbscan(adapters.points(spark, d), 120.0, 5).select("user_id", "point_id", "cluster")


def core_distances(spark, d):
    p = adapters.points(spark, d)
    cores = density.core_distances(density.positions(p), 20).select("user_id", "easting", "northing", "core")
    return p.join(cores, ["user_id", "easting", "northing"]).select("user_id", "point_id", F.round("core", 2).alias("core"))


def density_locations(spark, d):
    places = density.semantic_locations(_good(spark, d), 60)
    return places.select("user_id", "label", F.round("easting", 1).alias("easting"), F.round("northing", 1).alias("northing"), "n_points")


def _stops_in_time(spark, d) -> DataFrame:
    p = adapters.points(spark, d)
    return density.relabel_in_time(p.withColumn("cluster", F.when(F.col("point_id") % 5 < 2, -1).otherwise(F.floor(F.col("point_id") * 13 % 97 / 60))))


def stops_in_time(spark, d):
    return _stops_in_time(spark, d).select("user_id", "point_id", "stop")


def weighted_centres(spark, d):
    centres = density.weighted_centres(density.stop_points(_stops_in_time(spark, d), 600))
    return centres.select("user_id", "stop", F.round("easting", 4).alias("easting"), F.round("northing", 4).alias("northing"), "n_points")


def attribute_stops(spark, d):
    k = adapters.points(spark, d).withColumns({"speed_ms": F.col("point_id") * 17 % 40 / 100, "delta_heading": (F.col("point_id") * 29 % 180).cast("double")})
    k = k.withColumn("duration_s", F.coalesce(F.col("t") - F.lag("t").over(clean.by_time()), F.lit(0)))
    return logger.attribute_stops(k).select("user_id", "point_id", "label")


def older_distances(spark, d):
    p = _segments(spark, d)
    note = F.when(F.col("point_id") % 3 == 0, "missing trip - less than 250m").when(F.col("point_id") % 5 < 2, "single point")
    p = p.withColumns({"trip_num": F.floor(F.col("segment_group") / 2), "note": note, "break_period": F.when(F.col("point_id") % 4 != 0, F.col("period_before")).otherwise(0)})
    r = stitch.older_distances(p)
    return r.select("user_id", "point_id", "distance", F.round("trip_distance", 1).alias("trip_distance"), F.round("avg_speed", 6).alias("avg_speed"))


def older_diary(spark, d):
    r = older.diary_rows(_segments(spark, d), adapters.entrances(spark, d), least_kph=2.0)
    s = older.summaries(r)
    return s.withColumns({c: F.round(c, 1) for c in ("direct_distance", "cumulative_distance")})


def polylines(spark, d):
    """Each segment's line encoded, and its points read back from the code."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("t", "point_id", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    coded = _segments(spark, d, WIDE).groupBy("user_id", "segment_group").agg(polyline.encode(line).alias("code"))
    p = coded.select("user_id", "segment_group", F.posexplode(polyline.decode(F.col("code"))).alias("seq", "p"))
    return p.select("user_id", "segment_group", "seq", "p.lat", "p.lon")


def sql_functions(spark, d):
    sql.register(spark)
    name = f"sql_points_{abs(hash(d))}"
    adapters.points(spark, d, WIDE).createOrReplaceTempView(name)
    return spark.sql(f"""SELECT point_id, round(utm_easting(lat, lon), 3) AS easting, round(utm_northing(lat, lon), 3) AS northing, utm_zone(lat, lon) AS zone, utm_letter(lat) AS letter,
        round(survey_distance(45.5, -73.6, lat, lon), 3) AS far, round(initial_bearing(45.5, -73.6, lat, lon), 4) AS bearing, round(utm_lat(easting, northing, 18) - lat, 6) AS dlat FROM {name}""")


def _logger_input(spark, d):
    return segment.logger_segments(clean.logger_preprocess(adapters.points(spark, d)).drop("duration_s", "distance_m", "bearing", "delta_heading"), C.break_interval_s)


def stop_split(spark, d):
    return logger.stop_split(_logger_input(spark, d), clean.with_utm(_places(spark, d)), 120).select("user_id", "segment_group", "piece", "point_id")


def logger_trips(spark, d):
    trips = logger.diary(logger.long_pieces(logger.stop_split(_logger_input(spark, d), clean.with_utm(_places(spark, d)), 120)))
    return trips.withColumn("trip_distance", F.round("trip_distance", 1))


def dedupe_stations(spark, d):
    return adapters.entrances(spark, d).dropDuplicates(["lat", "lon"]).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def count_users(spark, d):
    return adapters.surveys(spark, d).agg(F.count("*").alias("n_users"))


def trip_diff(spark, d):
    key = ["user_id", "segment_group"]
    a = _trips(spark, d).select(*key, F.col("first.t").alias("start_a"), F.col("last.t").alias("end_a"))
    b = segment.summaries(_segments(spark, d, gap=600)).select(*key, F.col("first.t").alias("start_b"), F.col("last.t").alias("end_b"))
    j = a.join(b, key, "left")
    return j.select(*key, F.when(F.col("start_b").isNull(), -1).when((F.col("start_a") == F.col("start_b")) & (F.col("end_a") == F.col("end_b")), 1).otherwise(0).alias("match"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    accuracy_filter, user_semijoin, time_range_inclusive, time_range_exclusive, utm_project, utm_round_trip, kinematics, haversine_standard, gap_segments,
    logger_segments, segment_summary, short_extent, missing_segments, nearest_entrance_first, subway_links, metro_links_older, velocity_links,
    velocity_links_older, linked_trips, trip_points, missing_trips, trip_codes, merged_diary, phone_diary, trip_summaries, lone_points, spike_filter, logger_preprocess, rolling_avg,
    trailing_avg, complete_days, inactivity, explained_days, explained_days_geodesic, unpivot_locations, survey_locations, located_segments, label_points_last, label_points_first, location_overlaps, commutes_dwells,
    activity_daily, activity_daily_pivot, activity_condensed, condensed_trips, midnight_split, day_split, local_dates, kmeans_runs, heading_stops,
    stop_centroids, condensed_places, activity_locations, dbscan, core_distances, stops_in_time, weighted_centres, density_locations, attribute_stops, older_distances, older_diary, polylines, sql_functions, stop_split, logger_trips, dedupe_stations, count_users, trip_diff,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
