"""Calendar days of a survey: complete, incomplete and inactive days, and explained inactivity.

Trips come as user_id, trip_num, trip_code, first, second, last (structs with t,
lat, lon; second is null for trips of one point)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import geo


def by_date() -> WindowSpec:
    """The order of a user's dates."""
    return Window.partitionBy("user_id").orderBy("date")


#: Trips before this date come from clocks that were wrong: 1999-06-01, in seconds.
CLOCK_ERROR = 928195200


def trip_days(trips: DataFrame) -> DataFrame:
    """A row for each user and date with trips: ends of the day, whether a gap is among its trips.

    Dates are UTC dates, as the tools at hand label them. Trips before the
    first date with a sound clock go."""
    day = F.to_date(F.timestamp_seconds("first.t"))
    first = F.min(F.when(F.col("first.t") > CLOCK_ERROR, day)).over(Window.partitionBy("user_id"))
    dated = trips.withColumns({"date": day, "_from": first}).where(F.col("date") >= F.col("_from"))
    seen = F.struct("trip_num", "first"), F.struct("trip_num", "last"), F.struct("trip_num", "second")
    return dated.groupBy("user_id", "date").agg(
        F.min(seen[0])["first"].alias("start_point"), F.max(seen[1])["last"].alias("end_point"),
        F.min(F.when(F.col("second").isNotNull(), seen[2]))["second"].alias("second_point"),
        F.bool_or(F.col("trip_code").between(100, 199)).alias("has_missing"), F.count("*").alias("n_trips"),
    )


def complete_days(trips: DataFrame) -> DataFrame:
    """All dates from a user's first to last: has_trips, is_complete (trips, none of them missing) and the day's ends."""
    days = trip_days(trips)
    last = trips.groupBy("user_id").agg(F.max(F.to_date(F.timestamp_seconds("last.t"))).alias("hi"))
    span = days.groupBy("user_id").agg(F.min("date").alias("lo")).join(last, "user_id")
    dates = span.select("user_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    df = dates.join(days, ["user_id", "date"], "left")
    return df.withColumns({"has_trips": F.col("n_trips").isNotNull(), "is_complete": F.coalesce(~F.col("has_missing"), F.lit(False))})


def inactivity(days: DataFrame) -> DataFrame:
    """Add consecutive_inactive_days, first_inactive_day, inactive_day_streak (of this and later days) and inactivity_streak (of the user)."""
    df = days.withColumn("_run", F.sum(F.col("has_trips").cast("long")).over(by_date()))
    in_run = Window.partitionBy("user_id", "_run", "has_trips").orderBy("date")
    idle = ~F.col("has_trips")
    df = df.withColumns({
        "consecutive_inactive_days": F.when(idle, F.row_number().over(in_run)).cast("long"),
        "first_inactive_day": F.when(idle, F.min("date").over(in_run)),
    })
    later = by_date().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({
        "inactive_day_streak": F.when(idle, F.max("consecutive_inactive_days").over(later)),
        "inactivity_streak": F.max("consecutive_inactive_days").over(Window.partitionBy("user_id")),
    }).drop("_run")


def explained_days(days: DataFrame, most_m: float = 750.0, most_days: int = 2, geodesic: bool = False) -> DataFrame:
    """Add explained, and set is_complete there: short inactivity between complete days whose ends lie close together."""
    d = inactivity(days)
    before = d.select("user_id", F.col("date").alias("_prev"), F.col("is_complete").alias("_prev_ok"), F.col("end_point").alias("_end"))
    after = d.select("user_id", F.col("date").alias("_next"), F.col("is_complete").alias("_next_ok"), F.col("second_point").alias("_start"))
    d = d.withColumns({
        "_prev": F.when(F.col("inactive_day_streak") <= most_days, F.date_sub("first_inactive_day", 1)),
        "_next": F.when(F.col("inactive_day_streak") <= most_days, F.expr("date_add(first_inactive_day, cast(inactive_day_streak as int))")),
    })
    d = d.join(before, ["user_id", "_prev"], "left").join(after, ["user_id", "_next"], "left")
    if geodesic:
        apart = geo.geodesic(F.col("_end.lat"), F.col("_end.lon"), F.col("_start.lat"), F.col("_start.lon"))
    else:
        apart = F.expr(geo.haversine("_end.lat", "_end.lon", "_start.lat", "_start.lon"))
    explained = F.coalesce(F.col("_prev_ok") & F.col("_next_ok") & (apart < most_m), F.lit(False))
    d = d.withColumn("explained", explained).withColumn("is_complete", F.col("is_complete") | F.col("explained"))
    return d.drop("_prev", "_next", "_prev_ok", "_next_ok", "_end", "_start")


def day_state() -> F.Column:
    return F.when(F.col("is_complete"), "complete").when(F.col("has_trips"), "incomplete").otherwise("inactive")
