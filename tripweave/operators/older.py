"""The older diary: metro and speed links, lone points to the nearer neighbour, gaps as rows, notes and their hierarchy, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import segment, stitch
from .automaton import two_state
from .stitch import by_key

SHORT, METRO, MISSING, COLD = "missing trip - less than 250m", "missing trip - metro", "missing trip", "cold start"
COMPLETE, COMPLETE_METRO, SINGLE = "complete trip", "complete trip - metro", "single point"
#: Trip codes of the notes.
NOTE_CODES = {COMPLETE: 1, COMPLETE_METRO: 2, MISSING: 101, METRO: 102, SHORT: 103, SINGLE: 201}


def linked(points: DataFrame, stations: DataFrame, radius_m: float = 200.0, least_kph: float = 15.0, near_m: float = 300.0) -> DataFrame:
    """Segments with key (the trip's number; a trip linked by speed keeps its first one's, so that numbers have gaps), ends' stations, and marks of the points that links touch."""
    df = stitch.with_gap(stitch.end_places(segment.summaries(points), stations, radius_m))
    df = df.withColumn("_metro", stitch.subway_condition(differ=True))
    df = stitch.chain_links(df, "_metro", "_ride", first_only=True)
    df = df.withColumn("_number", F.sum((~F.col("_ride")).cast("long")).over(by_key()))
    df = df.withColumn("_fast", ~F.col("_ride") & stitch.velocity_condition(least_kph, above=True))
    key = F.last(F.when(~F.col("_ride") & ~F.col("_fast"), F.col("_number")), ignorenulls=True).over(by_key())
    df = df.withColumns({"key": key, "_metro_next": F.coalesce(F.lead("_metro").over(by_key()), F.lit(False)), "_fast_next": F.coalesce(F.lead("_fast").over(by_key()), F.lit(False))})
    marks = F.struct(F.col("_metro").alias("metro_first"), F.col("_metro_next").alias("metro_last"), F.col("_fast").alias("fast_first"), F.col("_fast_next").alias("fast_last"))
    df = df.withColumn("marks", marks).select("user_id", "segment_group", "first", "last", "n_points", "key", "marks")
    return stitch.end_places(df, stations, near_m)


def lone_fates(trips: DataFrame) -> DataFrame:
    """Trips with fate (previous or next for lone points between two trips whose numbers adjoin, else null), at (the time that the point takes), host (the trip that it joins) and rank (the trip's number without the lone ones before it).

    A point goes to the nearer of the two ends; one that a point has joined is no
    lone point any more, which is a state of two values."""
    w = by_key()
    far = lambda a, b: F.expr(geo.planar(f"{a}.easting", f"{a}.northing", f"{b}.easting", f"{b}.northing"))
    df = trips.withColumns({"_p": F.lag("last").over(w), "_q": F.lead("first").over(w), "_pk": F.lag("segment_group").over(w), "_qk": F.lead("segment_group").over(w)})
    lone = (F.col("n_points") == 1) & F.coalesce((F.col("_pk") == F.col("segment_group") - 1) & (F.col("_qk") == F.col("segment_group") + 1), F.lit(False))
    ahead = far("_p", "first") > far("first", "_q")
    df = two_state(df.withColumns({"_lone": lone, "_ahead": ahead}), w, F.col("_lone") & F.col("_ahead"), F.lit(False), "_gives")
    df = df.withColumn("_tested", F.col("_lone") & ~F.coalesce(F.lag("_gives").over(w), F.lit(False)))
    df = df.withColumn("fate", F.when(F.col("_tested"), F.when(F.col("_gives"), "next").otherwise("previous")))
    kept = F.last(F.when(~F.col("_tested"), F.col("segment_group")), ignorenulls=True).over(w)
    df = df.withColumns({
        "host": F.when(F.col("fate") == "next", F.col("_qk")).otherwise(kept),
        "at": F.when(F.col("fate") == "next", F.col("_q.t")).when(F.col("fate") == "previous", F.col("_p.t")),
        "rank": F.col("segment_group") - F.sum(F.col("_tested").cast("long")).over(w),
    })
    return df.drop("_p", "_q", "_pk", "_qk", "_lone", "_ahead", "_gives", "_tested")


def gap_notes(trips: DataFrame, min_m: float = 250.0, cold_start_m: float = 750.0) -> DataFrame:
    """Trips with prev_last, prev_place, gap_m, gap_s (whole days dropped, as the rule at hand does) and note of the gap before each."""
    df = stitch.with_gap(trips).withColumn("gap_s", F.pmod(F.col("gap_s"), F.lit(86400)))
    note = (
        F.when(F.col("gap_m").isNull(), None).when(F.col("gap_m") < min_m, SHORT).when(F.col("prev_place") != F.col("first_place"), METRO)
        .when(F.col("gap_m") <= cold_start_m, COLD).otherwise(MISSING)
    )
    return df.withColumn("gap_note", note)


def diary_rows(points: DataFrame, stations: DataFrame, radius_m: float = 200.0, least_kph: float = 15.0, near_m: float = 300.0, min_m: float = 250.0, cold_start_m: float = 750.0) -> DataFrame:
    """The rows of the older diary: user_id, trip, place (order within the trip), point_id, t, lat, lon, easting, northing, break_period, note, codes."""
    segments = linked(points, stations, radius_m, least_kph, near_m)
    trips = segments.groupBy("user_id", "key").agg(
        F.min(F.struct("segment_group", "first", "first_place")).alias("_f"), F.max(F.struct("segment_group", "last", "last_place")).alias("_l"), F.sum("n_points").alias("n_points"),
        F.collect_list(F.struct("segment_group", "marks")).alias("segments"),
    ).select("user_id", F.col("key").alias("segment_group"), "_f.first", "_f.first_place", "_l.last", "_l.last_place", "n_points", "segments")
    at = lambda end: F.col(end).withField("t", F.coalesce("at", F.col(f"{end}.t")))
    own = F.col("segment_group") == F.col("host")
    df = lone_fates(trips).groupBy("user_id", "host").agg(
        F.min(F.struct("segment_group", at("first").alias("first"), "first_place")).alias("_f"), F.max(F.struct("segment_group", at("last").alias("last"), "last_place")).alias("_l"),
        F.sum("n_points").alias("n_points"), F.max(F.when(own, F.col("rank"))).alias("rank"), F.collect_list(F.struct("segments", "at", "fate")).alias("parts"),
        F.max(F.when(own, F.struct(F.col("first.point_id").alias("own_first"), F.col("last.point_id").alias("own_last")))).alias("own"),
    )
    df = df.select("user_id", F.col("host").alias("segment_group"), "_f.first", "_f.first_place", "_l.last", "_l.last_place", "n_points", "rank", "parts", "own")
    df = gap_notes(df, min_m, cold_start_m)
    missing = F.coalesce(F.col("gap_note").isin(METRO, MISSING), F.lit(False))
    df = df.withColumn("trip", F.col("rank") + F.sum(missing.cast("long")).over(by_key()))
    cold, short = F.coalesce(F.col("gap_note") == COLD, F.lit(False)), F.coalesce(F.col("gap_note") == SHORT, F.lit(False))
    start_place = F.when(cold, F.col("prev_place")).otherwise(F.col("first_place"))
    note = F.when((F.col("n_points") == 1) & ~cold, SINGLE).when(F.coalesce(start_place != F.col("last_place"), F.lit(False)), COMPLETE_METRO).otherwise(COMPLETE)
    df = df.withColumn("note", note)

    none = lambda kind: F.lit(None).cast(kind)
    marks = "struct<metro_first: boolean, metro_last: boolean, fast_first: boolean, fast_last: boolean>"
    row = lambda trip, place, source, t, waits, note, codes, group, mark, fate: F.struct(
        trip.alias("trip"), F.lit(place).alias("place"), *[(none("double") if source is None else F.col(f"{source}.{c}")).alias(c) for c in ("lat", "lon", "easting", "northing")],
        t.cast("long").alias("t"), waits.cast("long").alias("break_period"), note.alias("note"), codes.alias("codes"), group.alias("segment_group"), mark.alias("marks"), fate.alias("fate"),
    )
    made = lambda trip, place, source, t, note, codes: row(trip, place, source, t, F.col("gap_s"), note, codes, none("long"), none(marks), none("string"))
    empty = F.array().cast("array<string>")
    extra = F.array_compact(F.array(
        F.when(missing, made(F.col("trip") - 1, 0, "prev_last", F.col("prev_last.t"), F.col("gap_note"), F.array("gap_note"))),
        F.when(missing, made(F.col("trip") - 1, 2, "first", F.col("first.t"), F.col("gap_note"), empty)),
        F.when(short, made(F.col("trip"), 0, "prev_last", F.col("first.t"), F.col("gap_note"), F.array("gap_note"))),
        F.when(cold, made(F.col("trip"), 0, "prev_last", F.col("first.t"), F.col("note"), F.array("gap_note"))),
    ))
    real = F.flatten(F.transform("parts", lambda p: F.transform(p["segments"], lambda g: row(F.col("trip"), 1, None, p["at"], none("long"), F.col("note"), empty, g["segment_group"], g["marks"], p["fate"]))))
    fates = F.transform("parts", lambda p: p["fate"])
    rows = df.select("user_id", F.col("trip").alias("_of"), "own", fates.alias("_fates"), F.explode(F.concat(extra, real)).alias("x")).select("user_id", "_of", "own", "_fates", "x.*")

    ends = Window.partitionBy("user_id", "segment_group").orderBy("t", "point_id")
    p = points.withColumns({"_first": F.lag("t").over(ends).isNull(), "_last": F.lead("t").over(ends).isNull()})
    p = p.select("user_id", "segment_group", "point_id", "_first", "_last", *[F.col(c).alias(f"_{c}") for c in ("t", "lat", "lon", "easting", "northing", "period_before")])
    every = rows.join(p, ["user_id", "segment_group"], "left")
    for c, source in (("t", "_t"), ("lat", "_lat"), ("lon", "_lon"), ("easting", "_easting"), ("northing", "_northing"), ("break_period", "_period_before")):
        every = every.withColumn(c, F.coalesce(c, source))
    code = lambda name, on: F.when(F.coalesce(on, F.lit(False)), name)
    first, last, m = F.col("_first"), F.col("_last"), (lambda f: F.col(f"marks.{f}"))
    point_codes = F.array_distinct(F.array_compact(F.array(
        code("metro", (first & m("metro_first")) | (last & m("metro_last"))), code("velocity", (first & m("fast_first")) | (last & m("fast_last"))),
        code("single point - before", (F.col("fate") == "next") | (F.array_contains("_fates", "next") & F.col("fate").isNull() & (F.col("point_id") == F.col("own.own_first")))),
        code("single point - after", (F.col("fate") == "previous") | (F.array_contains("_fates", "previous") & F.col("fate").isNull() & (F.col("point_id") == F.col("own.own_last")))),
    )))
    every = every.withColumn("codes", F.when(F.col("place") == 1, point_codes).otherwise(F.col("codes")))
    # The second row of a gap has the codes of the first point of the trip that it leads to.
    lead = Window.partitionBy("user_id", "_of").orderBy(F.col("place") != 1, "_t", "point_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = every.withColumn("codes", F.when((F.col("place") == 2), F.first("codes").over(lead)).otherwise(F.col("codes")))
    order = Window.partitionBy("user_id", "trip").orderBy("place", "_t", "point_id")
    return every.withColumn("place", F.row_number().over(order)).select("user_id", "trip", "place", "point_id", "t", "lat", "lon", "easting", "northing", "break_period", "note", "codes")


def note_code(notes: Column) -> Column:
    """The code of a trip's notes: a short gap gives way to what the trip itself is."""
    has = lambda n: F.array_contains(notes, n)
    order = (COMPLETE_METRO, COMPLETE, SINGLE, MISSING, METRO, SHORT)
    return F.coalesce(*[F.when(has(n), NOTE_CODES[n]) for n in order])


def summaries(rows: DataFrame) -> DataFrame:
    """user_id, trip_id, trip_code, start_t, end_t, olat, olon, dlat, dlon, merge_codes, direct_distance, cumulative_distance of the older diary's rows."""
    df = stitch.older_distances(rows, "trip", order=("place",))
    at = F.struct("place", "t", "lat", "lon", "easting", "northing", "trip_distance")
    df = df.groupBy("user_id", "trip").agg(F.min(at).alias("o"), F.max(at).alias("d"), F.collect_set("note").alias("notes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    far, own = F.col("d.trip_distance"), note_code(F.col("notes"))
    code = F.when((far > 250) & (own == 103), 1).when(far == 0, 201).when(far < 250, 202).otherwise(own)
    return df.select(
        "user_id", F.col("trip").alias("trip_id"), code.alias("trip_code"), F.col("o.t").alias("start_t"), F.col("d.t").alias("end_t"), F.col("o.lat").alias("olat"), F.col("o.lon").alias("olon"),
        F.col("d.lat").alias("dlat"), F.col("d.lon").alias("dlon"), F.array_join("codes", ", ").alias("merge_codes"),
        F.round(F.expr(geo.planar("o.easting", "o.northing", "d.easting", "d.northing")), 3).alias("direct_distance"), far.alias("cumulative_distance"),
    )
