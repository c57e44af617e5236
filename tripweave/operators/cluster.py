"""Stops and activity locations: exact 1-D two-means, runs, heading spread, density clusters, components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .clean import by_time
from .density import components
from .lineage import cut

#: Users of more distinct positions than this have their density clusters found over cells.
SPOTS = 1024


def two_means(points: DataFrame, value: str, cap: float = 50.0) -> DataFrame:
    """Add kmeans: 'trip' above the split of a user's values that minimises the squared error, else 'stop'.

    Values are null to 0 and capped. Sorted values and prefix sums give the error
    of every split at once, so the optimum is exact and needs no seed."""
    v = F.least(F.coalesce(F.col(value), F.lit(0.0)), F.lit(cap))
    df = points.withColumn("_v", v)
    counts = df.groupBy("user_id", "_v").agg(F.count("*").alias("c"))  # equal values fall on one side
    up = Window.partitionBy("user_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("user_id")
    sums = {"k": F.sum("c"), "s": F.sum(F.col("c") * F.col("_v")), "q": F.sum(F.col("c") * F.col("_v") * F.col("_v"))}
    counts = counts.withColumns({f"{n}1": e.over(up) for n, e in sums.items()} | {f"{n}n": e.over(whole) for n, e in sums.items()})
    error = F.round(F.expr("q1 - s1 * s1 / k1 + try_divide((qn - q1) - (sn - s1) * (sn - s1) / nullif(kn - k1, 0), 1)"), 6)
    splits = counts.where("k1 < kn").withColumn("sse", error)
    best = splits.groupBy("user_id").agg(F.min_by("_v", F.struct("sse", "_v")).alias("split"))
    df = df.join(best, "user_id", "left")
    return df.withColumn("kmeans", F.when(F.col("_v") > F.col("split"), "trip").otherwise("stop")).drop("_v", "split")


def runs(points: DataFrame, label: str = "kmeans") -> DataFrame:
    """Add run: the number of the run of equal labels in a user's time order, from 1."""
    new = F.coalesce((F.lag(label).over(by_time()) != F.col(label)).cast("long"), F.lit(1))
    return points.withColumn("_new", new).withColumn("run", F.sum("_new").over(by_time())).drop("_new")


def short_stops(points: DataFrame, min_s: int = 120) -> DataFrame:
    """Stops whose run is shorter than `min_s` become trips; runs stay as they are."""
    w = Window.partitionBy("user_id", "run")
    brief = (F.max("t").over(w) - F.min("t").over(w)) < min_s
    return points.withColumn("kmeans", F.when((F.col("kmeans") == "stop") & brief, "trip").otherwise(F.col("kmeans")))


def heading_stops(points: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """Points of stops by heading spread, with stop number: a user's threshold is stddev times the cutoff plus half the range.

    Null and zero values are passed over; a group at the end that no point below the threshold closes is lost."""
    w = Window.partitionBy("user_id")
    seen = points.where(F.col("delta_heading").isNotNull() & (F.col("delta_heading") != 0))
    limit = F.stddev_pop("delta_heading").over(w) * cutoff + F.bround((F.max("delta_heading").over(w) - F.min("delta_heading").over(w)) / 2)
    df = seen.withColumn("_in", F.col("delta_heading") >= limit)
    df = df.withColumn("_run", F.sum((~F.col("_in")).cast("long")).over(by_time()))
    df = df.withColumn("_last", F.max("_run").over(w)).where(F.col("_in") & (F.col("_run") < F.col("_last"))).drop("_last")
    return df.withColumn("stop", F.dense_rank().over(Window.partitionBy("user_id").orderBy("_run"))).drop("_in", "_run")


def centroids(points: DataFrame, key: str) -> DataFrame:
    """Mean UTM position of each group, when it first and last was seen, and its points."""
    return points.groupBy("user_id", key).agg(
        F.round(F.avg("easting"), 3).alias("easting"), F.round(F.avg("northing"), 3).alias("northing"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_points")
    )


def condense(spots: DataFrame, key: str, radius_m: float = 150.0) -> DataFrame:
    """user_id, place, easting, northing: centres of the components of spots within `radius_m` of each other, numbered by their least key.

    These are density clusters in which every spot is core; a distance of exactly
    the radius counts."""
    named = spots.select("user_id", F.col(key).cast("long").alias("point_id"), "easting", "northing")
    found = dbscan(named, math.nextafter(radius_m, math.inf), 1)
    centre = lambda c: (F.round(F.sum(F.round(F.col(c) * 1000).cast("long")) / F.count("*")) / 1000).alias(c)  # noqa: E731  of whole millimetres: the order of a sum changes nothing
    return found.groupBy("user_id", F.col("cluster").cast("long").alias("place")).agg(centre("easting"), centre("northing"))


def activity_locations(kmeans_stops: DataFrame, heading: DataFrame, key_a: str, key_b: str, radius_m: float = 150.0, match_m: float = 50.0) -> DataFrame:
    """user_id, label location_n, easting, northing: for each two-means centre in order the first heading centre within `match_m`; the more precise one gives the position.

    A heading centre that several two-means centres match stands once for each. Centres meet by cells of the distance."""
    a, b = condense(kmeans_stops, key_a, radius_m), condense(heading, key_b, radius_m)
    cell = lambda c: F.floor(F.col(c) / match_m).cast("long")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = a.select("user_id", F.col("place").alias("at"), F.col("easting").alias("ae"), F.col("northing").alias("an"), steps.alias("_o"))
    a = a.withColumns({"ci": cell("ae") + F.col("_o.i"), "cj": cell("an") + F.col("_o.j")}).drop("_o")
    near = a.join(b.withColumns({"ci": cell("easting"), "cj": cell("northing")}), ["user_id", "ci", "cj"]).where(F.expr(geo.planar("ae", "an", "easting", "northing")) <= match_m)
    first = near.groupBy("user_id", "at").agg(F.min(F.struct("place", "easting", "northing")).alias("x"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("at"))
    return first.select("user_id", F.concat(F.lit("location_"), n).alias("label"), "x.easting", "x.northing")


def with_latlon(places: DataFrame, zone: str = "18") -> DataFrame:
    """Add lat and lon of easting and northing in a UTM zone of the north."""
    lat, lon = geo.to_latlon("easting", "northing", zone)
    return places.withColumns({"lat": F.expr(lat), "lon": F.expr(lon)})


def dbscan(points: DataFrame, eps_m: float = 20.0, min_points: int = 10, most: int = SPOTS) -> DataFrame:
    """Add cluster (-1 noise): density clusters of each user's points, numbered by their least core point; a border point goes to its lowest cluster.

    Points at one position share their cluster. A user of up to `most` positions
    is a small group, compared in one matrix; the others go through cells."""
    spots = points.groupBy("user_id", "easting", "northing").agg(F.count("*").alias("m"), F.min("point_id").alias("least"))
    spots = cut(spots.withColumn("_many", F.count("*").over(Window.partitionBy("user_id"))), "cluster-spots")
    placed = points.join(_few_spots(spots.where(F.col("_many") <= most), eps_m, min_points), ["user_id", "easting", "northing"], "left").select(*points.columns, "cluster")
    large = spots.where(F.col("_many") > most).select("user_id").distinct()
    if not large.isEmpty():
        cells = _dbscan_cells(points.join(large, "user_id", "left_semi"), eps_m, min_points).withColumnRenamed("cluster", "_cluster")
        placed = placed.join(cells, ["user_id", "point_id"], "left").select(*points.columns, F.coalesce("cluster", "_cluster").alias("cluster"))
    return placed.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def _few_spots(spots: DataFrame, eps_m: float, min_points: int) -> DataFrame:
    """user_id, easting, northing, cluster of the positions (m: points at each, least: the first of them) in clusters, for users whose positions fit a matrix."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("least")
        e, n, m = (table.column(c).to_numpy() for c in ("easting", "northing", "m"))
        near = np.sqrt((e[:, None] - e) ** 2 + (n[:, None] - n) ** 2) < eps_m
        core = near @ m >= min_points
        cluster, number = np.zeros(len(m), np.int64), 0
        for at in np.flatnonzero(core):
            if cluster[at]:
                continue
            number += 1
            front = np.array([at])
            while len(front):
                cluster[front] = number
                front = np.flatnonzero(near[front].any(axis=0) & core & (cluster == 0))
        for at in np.flatnonzero(~core):
            cluster[at] = cluster[near[at] & core].min(initial=number + 1)
        named = table.select(["user_id", "easting", "northing"]).append_column("cluster", pa.array(cluster))
        return named.filter(pa.array((cluster > 0) & (cluster <= number)))

    user = spots.schema["user_id"].dataType.simpleString()
    return spots.where("easting is not null and northing is not null").groupBy("user_id").applyInArrow(run, f"user_id {user}, easting double, northing double, cluster long")


def _dbscan_cells(points: DataFrame, eps_m: float, min_points: int) -> DataFrame:
    """user_id, point_id, cluster of the clustered points, for users of any size.

    Points of one cell (a square of eps / sqrt 2) are neighbours of each other, so
    that all points of a cell with `min_points` are core without a look at their
    neighbours, and clusters join cells, not points. Only the fewer points of
    other cells are compared with those around them. Two cells are joined by
    their boxes where these decide, else by points near the other cell's box.
    Components of cells are found in rounds; no user is gathered anywhere."""
    side = eps_m / 2**0.5 * (1 - 1e-9)
    key = ["user_id", "ci", "cj"]
    p = points.select("user_id", "point_id", "easting", "northing", F.floor(F.col("easting") / side).cast("long").alias("ci"), F.floor(F.col("northing") / side).cast("long").alias("cj"))
    held = cut(p.withColumn("k", F.count("*").over(Window.partitionBy(*key))), "cells-held")
    # The corners of five by five cells are too far off.
    near = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]

    def around(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        """Each row once for each of the cells around its own: ci, cj are those."""
        df = df.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
        return df.withColumns({"ci": F.col("ci") + F.col("_o.i"), "cj": F.col("cj") + F.col("_o.j")}).drop("_o")

    def close(df: DataFrame, other: DataFrame, *keep: str) -> DataFrame:
        """Pairs of rows of `df` (spread around) and `other` (columns q...) nearer than eps."""
        far = F.expr(geo.planar("easting", "northing", "qe", "qn"))
        return df.join(other, key).where(far < eps_m).select("user_id", "point_id", *keep)

    every = held.select(*key, F.col("point_id").alias("q"), F.col("easting").alias("qe"), F.col("northing").alias("qn"))
    few = held.where(F.col("k") < min_points).drop("k")
    counted = close(around(few, near), every).groupBy("user_id", "point_id").agg(F.count("*").alias("k")).where(F.col("k") >= min_points).select("user_id", "point_id")
    core = held.where(F.col("k") >= min_points).drop("k")
    if min_points > 1:
        counted = cut(counted, "cells-counted")
        core = core.unionByName(few.join(counted, ["user_id", "point_id"], "left_semi"))

    box = core.groupBy(*key).agg(
        F.min("point_id").alias("least"), F.min("easting").alias("e0"), F.max("easting").alias("e1"), F.min("northing").alias("n0"), F.max("northing").alias("n1")
    )
    names = {c: f"b_{c}" for c in ("least", "e0", "e1", "n0", "n1")}
    ahead = [(i, j) for i, j in near if (i, j) > (0, 0)]
    pairs = around(box.withColumns({"ai": F.col("ci"), "aj": F.col("cj")}), ahead).join(box.withColumnsRenamed(names), key)
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"b_{lo}") - F.col(hi), F.col(lo) - F.col(f"b_{hi}"))
    span = lambda lo, hi: F.greatest(F.col(f"b_{hi}") - F.col(lo), F.col(hi) - F.col(f"b_{lo}"))
    pairs = pairs.withColumns({"nearest": F.hypot(gap("e0", "e1"), gap("n0", "n1")), "farthest": F.hypot(span("e0", "e1"), span("n0", "n1"))}).where(F.col("nearest") < eps_m + 1e-6)
    sure = F.col("farthest") < eps_m - 1e-6
    open_ = pairs.where(~sure).select("user_id", "ai", "aj", "ci", "cj", "least", "b_least", "b_e0", "b_e1", "b_n0", "b_n1")
    off = lambda c, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col(c), F.col(c) - F.col(hi))
    facing = open_.join(core.withColumnsRenamed({"ci": "ai", "cj": "aj"}), ["user_id", "ai", "aj"]).where(F.hypot(off("easting", "b_e0", "b_e1"), off("northing", "b_n0", "b_n1")) < eps_m + 1e-6)
    there = core.select(*key, F.col("easting").alias("qe"), F.col("northing").alias("qn"))
    touching = facing.join(there, key).where(F.expr(geo.planar("easting", "northing", "qe", "qn")) < eps_m).select("user_id", "least", "b_least").distinct()
    links = pairs.where(sure).select("user_id", "least", "b_least").unionByName(touching).unionByName(box.select("user_id", "least", F.col("least").alias("b_least")))

    # A user's cells, each named by its least core point; clusters are numbered in the order of theirs.
    roots = components(links, "user_id", "least", "b_least").withColumnRenamed("node", "least")
    number = F.dense_rank().over(Window.partitionBy("user_id").orderBy("root")).cast("long")
    of_cell = cut(box.select(*key, "least").join(roots, ["user_id", "least"]).withColumn("cluster", number).drop("least", "root"), "cells-clusters")
    inner = core.join(of_cell, key).select("user_id", "point_id", "cluster")
    if min_points <= 1:
        return inner
    rest = few.join(counted, ["user_id", "point_id"], "left_anti")
    border = close(around(rest, near), there.join(of_cell, key), "cluster").groupBy("user_id", "point_id").agg(F.min("cluster").alias("cluster"))
    return inner.unionByName(border)
