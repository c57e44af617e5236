"""Activity: labelled points, commutes and dwells, and their sums by day and by participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.time import local


def unpivot_locations(surveys: DataFrame, labels: list[str]) -> DataFrame:
    """user_id, place_order, label, lat, lon from columns location_<label>_lat and _lon; zero and null coordinates go."""
    spots = [F.struct(F.lit(i).alias("place_order"), F.lit(x).alias("label"), F.col(f"location_{x}_lat").alias("lat"), F.col(f"location_{x}_lon").alias("lon")) for i, x in enumerate(labels)]
    df = surveys.select("user_id", F.explode(F.array(*spots)).alias("x")).select("user_id", "x.*")
    return df.where((F.coalesce(F.col("lat"), F.lit(0.0)) != 0) & (F.coalesce(F.col("lon"), F.lit(0.0)) != 0))


def survey_locations(surveys: DataFrame, labels: list[str]) -> DataFrame:
    """user_id, label, lat, lon: the first label (home) for every user, even without coordinates, the others where they have some."""
    own = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"location_{x}_lat").alias("lat"), F.col(f"location_{x}_lon").alias("lon"), F.lit(i == 0).alias("always")) for i, x in enumerate(labels)])
    df = surveys.select("user_id", F.explode(own).alias("x")).select("user_id", "x.*")
    return df.where(F.col("always") | ((F.coalesce(F.col("lat"), F.lit(0.0)) != 0) & (F.coalesce(F.col("lon"), F.lit(0.0)) != 0))).drop("always")


def label_points(points: DataFrame, locations: DataFrame, proximity_m: float, last: bool = True, out: str = "label") -> DataFrame:
    """Add `out`: the last (or first) of the user's own locations within `proximity_m`; a join on the user, then the exact test."""
    near = points.select("user_id", "point_id", "lat", "lon").join(locations.select("user_id", "place_order", "label", F.col("lat").alias("pl"), F.col("lon").alias("po")), "user_id")
    near = near.where(F.expr(geo.haversine("pl", "po", "lat", "lon")) <= proximity_m)
    pick = F.max(F.struct("place_order", "label")) if last else F.min(F.struct("place_order", "label"))
    return points.join(near.groupBy("user_id", "point_id").agg(pick["label"].alias(out)), ["user_id", "point_id"], "left")


def location_overlaps(locations: DataFrame, proximity_m: float) -> DataFrame:
    """Pairs of one user's locations that lie within twice the proximity."""
    a = locations.select("user_id", F.col("place_order").alias("i"), F.col("label").alias("label_a"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = locations.select("user_id", F.col("place_order").alias("j"), F.col("label").alias("label_b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    pairs = a.join(b, "user_id").where("i < j").withColumn("distance_m", F.expr(geo.haversine("la", "oa", "lb", "ob")))
    return pairs.where(F.col("distance_m") <= 2 * proximity_m).select("user_id", "label_a", "label_b", "distance_m")


def commute_label(a: Column, b: Column, dynamic: bool = False) -> Column:
    """work or study for trips between home and there; `dynamic`: the two labels, sorted, or uncategorized."""
    if dynamic:
        return F.when(a.isNull() | b.isNull(), F.lit("uncategorized")).otherwise(F.array_join(F.array_sort(F.array(a, b)), "-"))
    both = lambda x: ((a == "home") & (b == x)) | ((a == x) & (b == "home"))
    return F.when(both("work"), "work").when(both("study"), "study")


def intervals(points: DataFrame, dynamic: bool = False) -> DataFrame:
    """user_id, trip_key, kind (commute, dwell), label, start, end (s) from labelled trip points.

    A dwell lies between two trips and has a label if the first label among the
    last five points of one is the first label among the first five of the other."""
    w = Window.partitionBy("user_id", "trip_key")
    df = points.withColumns({"_a": F.row_number().over(w.orderBy("t", "point_id")), "_z": F.row_number().over(w.orderBy(F.desc("t"), F.desc("point_id")))})
    at = F.struct("t", "point_id", "label")
    labelled = F.col("label").isNotNull()
    trips = df.groupBy("user_id", "trip_key").agg(
        F.min("t").alias("start"), F.max("t").alias("end"),
        F.min(at)["label"].alias("origin"), F.max(at)["label"].alias("destination"),
        F.min(F.when(labelled & (F.col("_a") <= 5), at))["label"].alias("head"), F.min(F.when(labelled & (F.col("_z") <= 5), at))["label"].alias("tail"),
    )
    by = Window.partitionBy("user_id").orderBy("trip_key")
    none = F.lit("uncategorized") if dynamic else F.lit(None).cast("string")
    commutes = trips.select("user_id", "trip_key", F.lit("commute").alias("kind"), commute_label(F.col("origin"), F.col("destination"), dynamic).alias("label"), "start", "end")
    between = trips.withColumns({"_tail": F.lag("tail").over(by), "_end": F.lag("end").over(by)}).where(F.col("_end").isNotNull())
    dwells = between.select("user_id", "trip_key", F.lit("dwell").alias("kind"), F.when(F.col("_tail") == F.col("head"), F.col("head")).otherwise(none).alias("label"), F.col("_end").alias("start"), F.col("start").alias("end"))
    return commutes.unionByName(dwells)


def _pieces(spans: DataFrame, timezone: str) -> DataFrame:
    """The pieces of intervals by local date (compat rule of one or two pieces)."""
    from ..functions.time import split_at_midnight

    at = lambda c: local(F.timestamp_seconds(c).cast("timestamp_ntz"), timezone)
    return split_at_midnight(spans.withColumns({"_s": at("start"), "_e": at("end")}), "_s", "_e").drop("_s", "_e")


def daily(spans: DataFrame, points: DataFrame, timezone: str) -> DataFrame:
    """A row for each user and local date with activity: trips, points, distance and seconds by fixed label (0 where none)."""
    pieces = _pieces(spans, timezone)
    total = lambda kind, label: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("label") == label), F.col("seconds"))), F.lit(0.0))
    times = pieces.groupBy("user_id", "date").agg(
        F.count_if(F.col("kind") == "commute").alias("num_trips"),
        F.coalesce(F.sum(F.when(F.col("kind") == "commute", F.col("seconds"))), F.lit(0.0)).alias("trips_duration_s"),
        *[total("commute", x).alias(f"commute_{x}_s") for x in ("work", "study")], *[total("dwell", x).alias(f"dwell_{x}_s") for x in ("home", "work", "study")],
    )
    day = F.to_date(local(F.timestamp_seconds("t").cast("timestamp_ntz"), timezone))
    moves = points.groupBy("user_id", day.alias("date")).agg(F.count("*").alias("num_points"), F.round(F.sum("distance_before"), 3).alias("trips_distance_m"))
    df = times.join(moves, ["user_id", "date"], "full")
    return df.fillna(0)


def daily_pivot(spans: DataFrame, labels: list[str], timezone: str) -> DataFrame:
    """Seconds of commute and of dwell by label as columns commute_<a>_<b> and dwell_<a>, null where none.

    All that `labels` (of places) can give are listed, so that Spark needs no look at the data first."""
    pieces = _pieces(spans, timezone).withColumn("_of", F.concat_ws("_", "kind", F.translate("label", "-", "_")))
    names = sorted(labels)
    of = [f"commute_{a}_{b}" for i, a in enumerate(names) for b in names[i:]] + [f"dwell_{a}" for a in names] + ["commute_uncategorized", "dwell_uncategorized"]
    return pieces.groupBy("user_id", "date").pivot("_of", of).agg(F.sum("seconds"))


def condensed(spans: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each user: days by state, sums by label (null where none), averages over active days."""
    of = lambda kind, label: F.sum(F.when((F.col("kind") == kind) & (F.col("label") == label), F.col("end") - F.col("start")))
    whole = spans.groupBy("user_id").agg(
        F.min("start").alias("first_seen"), F.max("end").alias("last_seen"), F.count_if(F.col("kind") == "commute").alias("num_trips"),
        F.sum(F.when(F.col("kind") == "commute", F.col("end") - F.col("start"))).alias("total_commute_s"),
        *[of("commute", x).alias(f"commute_time_{x}_s") for x in ("work", "study")], *[of("dwell", x).alias(f"stay_time_{x}_s") for x in ("home", "work", "study")],
    )
    states = days.groupBy("user_id").agg(
        F.count_if("is_complete").alias("complete_days"), F.count_if(F.col("has_trips") & ~F.col("is_complete")).alias("incomplete_days"),
        F.count_if(~F.col("has_trips") & ~F.col("is_complete")).alias("inactive_days"),
    )
    df = whole.join(states, "user_id", "left")
    return df.withColumn("avg_trips_per_day", F.try_divide("num_trips", F.col("complete_days") + F.col("incomplete_days")))


def condensed_trips(trips: DataFrame, days: DataFrame) -> DataFrame:
    """Trips with trip_type and whether their date is complete (dates without a day: not)."""
    df = trips.withColumn("date", F.to_date(F.timestamp_seconds("first.t")))
    df = df.join(days.select("user_id", "date", F.col("is_complete").alias("_ok")), ["user_id", "date"], "left")
    return df.withColumns({"trip_type": F.when(F.col("trip_code") < 100, "complete").otherwise("missing"), "complete_day": F.coalesce("_ok", F.lit(False))}).drop("_ok")
