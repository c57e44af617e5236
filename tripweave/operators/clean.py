"""Cleaning and enrichment of points: accuracy, spikes, logger kinematics, rolling averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import geo
from .automaton import keep_by_replay


def by_time() -> WindowSpec:
    """The one order of a user's points; every window operator shares it, so that Spark plans one exchange and sort."""
    return Window.partitionBy("user_id").orderBy("t", "point_id")


def with_utm(points: DataFrame) -> DataFrame:
    """Add easting and northing in metres, rounded to mm."""
    return points.withColumns({"easting": F.round(F.expr(geo.easting("lat", "lon")), 3), "northing": F.round(F.expr(geo.northing("lat", "lon")), 3)})


def utm_range(points: DataFrame) -> DataFrame:
    """Points that the projection covers."""
    return points.where(F.col("lat").between(-80, 84) & F.col("lon").between(-180, 180))


def enough_points(points: DataFrame, least: int = 2) -> DataFrame:
    """Points of users that have `least` or more; a trip needs two."""
    counted = points.withColumn("_many", F.count("*").over(Window.partitionBy("user_id")))
    return counted.where(F.col("_many") >= least).drop("_many")


def accuracy_filter(points: DataFrame, cutoff_m: float) -> DataFrame:
    """Points as accurate as the cutoff or better; points without an accuracy go."""
    return points.where(F.col("h_accuracy") <= cutoff_m)


def in_time_range(points: DataFrame, start: int | None = None, end: int | None = None, exclusive: bool = False) -> DataFrame:
    """Points from start to end, both ends inside unless `exclusive`."""
    if start is not None:
        points = points.where(F.col("t") > start if exclusive else F.col("t") >= start)
    if end is not None:
        points = points.where(F.col("t") < end if exclusive else F.col("t") <= end)
    return points


def spike_filter(points: DataFrame, check_kph: float) -> DataFrame:
    """Drop jumps: a point that is reached at `check_kph` or more from the last kept point while the next point is nearer.

    Each decision looks at the last point kept. A point is kept whatever that is
    if it has no next point, if the next lies at the same place, or if no place
    of the user is far enough to be left so fast since the point before; between
    such points, stretches of a user are replayed, each on its own."""
    limit = check_kph / 3.6
    everything = Window.partitionBy("user_id")
    df = points.withColumns({
        "_t": F.lag("t").over(by_time()), "_e": F.lead("easting").over(by_time()), "_n": F.lead("northing").over(by_time()),
        **{f"_{f.__name__}_{c}": f(c).over(everything) for c in ("easting", "northing") for f in (F.min, F.max)},
    })
    far = lambda c: F.greatest(F.col(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(c))
    reach = F.sqrt(far("easting") * far("easting") + far("northing") * far("northing"))
    still = (F.col("_e") == F.col("easting")) & (F.col("_n") == F.col("northing"))
    safe = F.col("_e").isNull() | still | (reach * (1 + 1e-9) < limit * (F.col("t") - F.col("_t")))

    def rule(last, row):
        import math

        e, n, t, next_e, next_n = row
        if last is None or next_e is None:
            return True, (e, n, t)
        d, dt = math.hypot(e - last[0], n - last[1]), t - last[2]
        if d and dt and d / dt >= limit and math.hypot(next_e - last[0], next_n - last[1]) < d:
            return False, last
        return True, (e, n, t)

    return keep_by_replay(df, ["user_id"], ["t", "point_id"], safe, ["easting", "northing", "t", "_e", "_n"], rule, points.columns)


def kinematics(points: DataFrame) -> DataFrame:
    """Add prev_t, duration_s, distance_m, bearing and delta_heading against the point before (first: zeros)."""
    prev = {f"_{c}": F.lag(c).over(by_time()) for c in ("t", "lat", "lon")}
    df = points.withColumns(prev)
    df = df.withColumns({
        "duration_s": F.coalesce(F.col("t") - F.col("_t"), F.lit(0)),
        "distance_m": F.coalesce(F.expr(geo.haversine("_lat", "_lon", "lat", "lon")), F.lit(0.0)),
        "bearing": F.coalesce(F.expr(geo.bearing("_lat", "_lon", "lat", "lon")), F.lit(0.0)),
    })
    df = df.withColumn("_b", F.lag("bearing").over(by_time()))
    df = df.withColumn("delta_heading", F.coalesce(F.expr(geo.delta_heading("_b", "bearing")), F.lit(0.0)))
    return df.drop("_t", "_lat", "_lon", "_b")


def logger_preprocess(points: DataFrame, min_step_m: float = 0.1) -> DataFrame:
    """Logger points that move: against the last kept point, no time, no distance or a step below the limit drops a point.

    The first point of a user stays. A dropped point that came later than the one
    before it lies within a step of the last kept one, so that a point more than
    two steps farther on, and later, is kept whatever that is: stretches between
    such points are replayed. The kinematics against the last kept point are then
    windows over what is left."""
    df = points.withColumns({f"_{c}": F.lag(c).over(by_time()) for c in ("t", "lat", "lon")}).withColumn("_tt", F.lag("t", 2).over(by_time()))
    step = F.expr(geo.haversine("_lat", "_lon", "lat", "lon"))
    later = (F.col("t") > F.col("_t")) & (F.col("_tt").isNull() | (F.col("_t") > F.col("_tt")))

    def rule(last, row):
        import math

        lat, lon, t = row
        if last is not None:
            p1, p2 = math.radians(last[0]), math.radians(lat)
            a = (math.sin((p2 - p1) / 2) ** 2 + math.sin(math.radians(lon - last[1]) / 2) ** 2) * math.cos(p1) * math.cos(p2)
            if t == last[2] or geo.EARTH_M * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) < min_step_m:
                return False, last
        return True, (lat, lon, t)

    return kinematics(keep_by_replay(df, ["user_id"], ["t", "point_id"], later & (step > 3 * min_step_m), ["lat", "lon", "t"], rule, points.columns))


def rolling_average(points: DataFrame, value: str, out: str = "rolling_avg") -> DataFrame:
    """Sum of the 20 values from ten before to nine after, over 21; null within ten points of either end."""
    number, count = F.row_number().over(by_time()), F.count("*").over(Window.partitionBy("user_id"))
    total = F.sum(value).over(by_time().rowsBetween(-10, 9))
    return points.withColumn(out, F.when((number - 2 >= 10) & (count - number >= 10), total / 21))


def trailing_average(points: DataFrame, value: str, size: int = 5, out: str = "trailing_avg") -> DataFrame:
    """Mean of the last `size` values; null until there are that many."""
    w = by_time().rowsBetween(1 - size, 0)
    return points.withColumn(out, F.when(F.count("*").over(w) == size, F.avg(value).over(w)))
