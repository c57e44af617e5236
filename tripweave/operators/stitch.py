"""Stitching segments into trips, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import geo
from . import segment
from .automaton import replay, two_state


def by_key() -> WindowSpec:
    """The order of a user's trips."""
    return Window.partitionBy("user_id").orderBy("segment_group")


#: Cells have a side of the radius / FINE, so that most places around a cell are near all of it or none.
FINE = 8


def _cell(at: str, radius_m: float) -> dict[str, Column]:
    """_ci, _cj of a position."""
    return {to: F.floor(F.col(f"{at}{c}") / (radius_m / FINE)).cast("long") for to, c in (("_ci", "easting"), ("_cj", "northing"))}


def _nearby(places: DataFrame, radius_m: float, last: bool = False) -> DataFrame:
    """A row for each cell with places near it: _ci, _cj, _sure (the first, or last, of the places within the radius of all of the cell) and _open (the places before that which are within it of a part of the cell at most).

    Positions stand once, with their first place. A place that comes after a sure
    one is never the answer, so that a row holds few places however many lie
    around, and a point is compared with few."""
    pick = F.max if last else F.min
    square = lambda i, j, d: max(abs(i) + d, 0) ** 2 + max(abs(j) + d, 0) ** 2
    every = [(i, j) for i in range(-FINE - 1, FINE + 2) for j in range(-FINE - 1, FINE + 2) if square(i, j, -1) <= FINE**2]
    inner = [o for o in every if square(*o, 1) < FINE**2]

    def spread(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        df = df.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
        return df.withColumns({"_ci": F.col("_ci") + F.col("_o.i"), "_cj": F.col("_cj") + F.col("_o.j")}).drop("_o")

    spots = places.where(~F.isnan("easting") & ~F.isnan("northing")).groupBy("easting", "northing").agg(pick("place_id").alias("place_id")).withColumns(_cell("", radius_m))
    sure = spread(spots.groupBy("_ci", "_cj").agg(pick("place_id").alias("place_id")), inner).groupBy("_ci", "_cj").agg(pick("place_id").alias("_sure"))
    before = F.col("place_id") > F.col("_sure") if last else F.col("place_id") < F.col("_sure")
    rest = spread(spots, [o for o in every if o not in inner]).join(sure, ["_ci", "_cj"], "left").where(F.col("_sure").isNull() | before)
    rest = rest.groupBy("_ci", "_cj").agg(F.collect_list(F.struct("place_id", "easting", "northing")).alias("_open"))
    return sure.join(rest, ["_ci", "_cj"], "full")


def _placed(df: DataFrame, nearby: DataFrame, at: str, radius_m: float, last: bool, out: str) -> DataFrame:
    """Add `out` for the positions `at`, from _nearby(): rows are neither multiplied nor grouped."""
    df = df.withColumns(_cell(at, radius_m)).join(nearby, ["_ci", "_cj"], "left")
    near = F.filter("_open", lambda p: F.sqrt(F.pow(p["easting"] - F.col(f"{at}easting"), 2) + F.pow(p["northing"] - F.col(f"{at}northing"), 2)) <= radius_m)
    ids = F.transform(near, lambda p: p["place_id"])
    return df.withColumn(out, F.greatest("_sure", F.array_max(ids)) if last else F.least("_sure", F.array_min(ids))).drop("_ci", "_cj", "_sure", "_open")


def within(points: DataFrame, places: DataFrame, radius_m: float, last: bool = False, out: str = "place") -> DataFrame:
    """Add `out`: the first (or last) place in the order of place_id within `radius_m` of each point; null if none."""
    return _placed(points, _nearby(places, radius_m, last), "", radius_m, last, out)


def end_places(trips: DataFrame, places: DataFrame, radius_m: float, **ends: str) -> DataFrame:
    """Add a column for each of `ends` (name=point; first_place and last_place of the ends, if none is given): the first place there."""
    ends = ends or {"first_place": "first", "last_place": "last"}
    nearby = _nearby(places, radius_m)
    df = trips.drop(*ends)
    for out, at in ends.items():
        df = _placed(df, nearby, f"{at}.", radius_m, False, out)
    return df


def with_gap(trips: DataFrame) -> DataFrame:
    """Add prev_last, gap_s and gap_m against the trip before, and prev_place if the trips have last_place."""
    df = trips.withColumn("prev_last", F.lag("last").over(by_key()))
    if "last_place" in trips.columns:
        df = df.withColumn("prev_place", F.lag("last_place").over(by_key()))
    return df.withColumns(_gap())


def _gap(before: str = "prev_last") -> dict[str, Column]:
    return {
        "gap_s": F.col("first.t") - F.col(f"{before}.t"),
        "gap_m": F.round(F.expr(geo.planar(f"{before}.easting", f"{before}.northing", "first.easting", "first.northing")), 3),
    }


def pair_links(trips: DataFrame, condition: str, out: str = "link") -> DataFrame:
    """Add `out`: links to the trip before under the rule that a linked trip can't be linked to again.

    An automaton: after a link the next trip can't be linked, else its condition decides."""
    return two_state(trips, by_key(), F.col(condition), F.lit(False), out)


def chain_links(trips: DataFrame, condition: str, out: str = "link", first_only: bool = False) -> DataFrame:
    """Add `out`: every true condition links; with `first_only` just the first of a chain."""
    link = F.col(condition)
    if first_only:
        link = link & ~F.coalesce(F.lag(condition).over(by_key()), F.lit(False))
    return trips.withColumn(out, link)


def subway_condition(most_s: int = 4800, least_ms: float = 0.1, differ: bool = False) -> Column:
    """Both ends of the gap lie at an entrance, in time and not at rest."""
    ok = F.col("prev_place").isNotNull() & F.col("first_place").isNotNull() & (F.col("gap_s") < most_s) & (F.try_divide(F.col("gap_m"), F.col("gap_s")) > least_ms)
    return F.coalesce(ok & (F.col("prev_place") != F.col("first_place")) if differ else ok, F.lit(False))


def velocity_condition(least_kph: float = 15.0, above: bool = False) -> Column:
    """The gap was crossed at `least_kph` or more (`above`: faster than that)."""
    speed = F.try_divide(F.col("gap_m"), F.col("gap_s")) * 3.6
    return F.coalesce(speed > least_kph if above else speed >= least_kph, F.lit(False))


def subway_links(trips: DataFrame, entrances: DataFrame, radius_m: float = 200.0, most_s: int = 4800, least_ms: float = 0.1, differ: bool = False) -> DataFrame:
    """Trips with link: pairs joined by a subway ride (`differ`: older rule, other stations and first of a chain)."""
    df = with_gap(end_places(trips, entrances, radius_m)).withColumn("condition", subway_condition(most_s, least_ms, differ))
    return chain_links(df, "condition", first_only=True) if differ else pair_links(df, "condition")


def velocity_links(trips: DataFrame, least_kph: float = 15.0, chains: bool = False) -> DataFrame:
    """Trips with link: gaps crossed at `least_kph` or more, in pairs (`chains`: faster than that, any number)."""
    df = with_gap(trips).withColumn("condition", velocity_condition(least_kph, chains))
    return chain_links(df, "condition") if chains else pair_links(df, "condition")


def link_keys(trips: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Segments with trip_key (the trip that each belongs to) and label (of the rule that linked it to the one before; else null).

    `rules` are (label, condition on a gap), applied one after the other to what
    the ones before have linked, in pairs. The gap before a trip is that before its first
    segment, whatever has been linked, so that all rules are windows over the
    same sorted segments. Needs gap_s and gap_m, and the places if a rule asks
    for them (with_gap, end_places)."""
    df = trips.withColumns({"_joined": F.lit(False), "label": F.lit(None).cast("string")})
    for label, condition in rules:
        df = df.withColumn("_condition", condition)
        df = two_state(df, by_key(), ~F.col("_joined") & F.col("_condition"), F.col("_joined"), "_on")  # joined segments hand the state on
        df = df.withColumn("_link", F.col("_on") & ~F.col("_joined"))
        df = df.withColumns({"label": F.when(F.col("_link"), F.lit(label)).otherwise(F.col("label")), "_joined": F.col("_joined") | F.col("_link")})
    key = F.sum((~F.col("_joined")).cast("long")).over(by_key()) - 1
    return df.withColumn("trip_key", key).drop("_joined", "_condition", "_on", "_link")


def linked_trips(keyed: DataFrame) -> DataFrame:
    """A row for each trip of link_keys(): segment_group (its key), first, last and their places, n_points, labels, total (metres with the gap before the first point) and segments (keys)."""
    ends = [c for c in ("first_place", "last_place") if c in keyed.columns]
    df = keyed.groupBy("user_id", "trip_key").agg(
        F.min(F.struct("segment_group", "first", *ends[:1])).alias("_f"), F.max(F.struct("segment_group", "last", *ends[1:])).alias("_l"), F.sum("n_points").alias("n_points"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.sum(F.col("cumulative_distance") + F.col("first.distance_before")).alias("total"), F.collect_list("segment_group").alias("segments"),
    )
    return df.select("user_id", F.col("trip_key").alias("segment_group"), "_f.first", "_l.last", *(["_f.first_place", "_l.last_place"] if ends else []), "n_points", "labels", "total", "segments")


def with_gap_kinds(trips: DataFrame, min_m: float = 250.0, cold_start_m: float = 750.0) -> DataFrame:
    """Trips with prev_last, prev_place, gap_s, gap_m and kind of the gap before each; null in a user's first trip.

    A trip that starts where the last one ended is no new base for the next
    comparison: whether it was skipped is a state of two values, as the base lies
    where the trip before ended or, if that was skipped, where it started."""
    df = trips.withColumns({"_end": F.lag("last").over(by_key()), "_start": F.lag("first").over(by_key())})
    same = lambda at: F.coalesce((F.col(f"{at}.easting") == F.col("first.easting")) & (F.col(f"{at}.northing") == F.col("first.northing")), F.lit(False))
    df = two_state(df, by_key(), same("_end"), same("_start"), "_skipped")
    df = df.withColumn("_base", F.last(F.when(~F.col("_skipped"), F.struct("last", "last_place")), ignorenulls=True).over(by_key()))
    df = df.withColumn("_base", F.lag("_base").over(by_key())).withColumns({"prev_last": F.col("_base.last"), "prev_place": F.col("_base.last_place"), "_later": F.lead("segment_group").over(by_key())})
    df = df.withColumns(_gap())
    kind = (
        F.when(F.col("gap_m").isNull() | (F.col("gap_m") == 0), None)
        .when(F.col("gap_m") < min_m, "too_short")
        .when((F.col("n_points") == 1) & F.col("_later").isNotNull(), "known_location")
        .when(F.col("prev_place") != F.col("first_place"), "subway")
        .when(F.col("gap_m") <= cold_start_m, "cold_start")
        .otherwise("general")
    )
    return df.withColumn("kind", kind).drop("_end", "_start", "_base", "_skipped", "_later")


def missing_trips(trips: DataFrame, entrances: DataFrame, min_m: float = 250.0, radius_m: float = 200.0, cold_start_m: float = 750.0) -> DataFrame:
    """A row for each trip after a user's first with the kind of the gap before it, or null kind if it touches.

    kind: too_short, known_location (a lone point between trips), subway (two
    entrances), cold_start or general."""
    df = with_gap_kinds(end_places(trips, entrances, radius_m), min_m, cold_start_m)
    df = df.withColumns({"next_first": F.lead("first").over(by_key()), "next_group": F.lead("segment_group").over(by_key())})
    return df.where(F.col("prev_last").isNotNull())


def trip_codes(trips: DataFrame) -> DataFrame:
    """Add trip_code from labels (array), too_short (the gap before was), n_points and cumulative_distance.

    Trips with other labels only (joined by velocity) keep -1, as the algorithm at hand leaves them."""
    subway = F.array_contains("labels", "subway")
    code = (
        F.when(F.col("cumulative_distance") < 250, 202)
        .when(F.col("too_short") & subway, 2)
        .when(F.col("too_short") & (F.col("n_points") == 1), 201)
        .when(F.col("too_short"), 1)
        .when(subway, 2)
        .when((F.size("labels") == 0) & (F.col("n_points") > 1), 1)
        .otherwise(-1)
    )
    return trips.withColumn("trip_code", code)


GAP_CODES = {"general": 101, "subway": 102, "too_short": 103, "known_location": 104}


def gap_code(kind: str = "kind") -> Column:
    return F.coalesce(*[F.when(F.col(kind) == k, c) for k, c in GAP_CODES.items()])


def gap_codes(gaps: DataFrame) -> DataFrame:
    """Gaps with trip_code by kind and leads_out; cold starts are no gaps.

    A lone point at a known place has two gaps: the second leads out of it, has
    no length or time, and stands before the trip that follows, in front of that
    trip's own gap."""
    coded = gaps.where(F.col("kind").isNotNull() & (F.col("kind") != "cold_start")).withColumns({"trip_code": gap_code(), "leads_out": F.lit(False)})
    second = coded.where(F.col("kind") == "known_location").withColumns({
        "prev_last": F.col("first"), "first": F.col("next_first"), "segment_group": F.col("next_group"), "gap_m": F.lit(0.0), "gap_s": F.lit(0).cast("long"), "leads_out": F.lit(True),
    })
    return coded.unionByName(second)


def diary(trips: DataFrame, gaps: DataFrame) -> DataFrame:
    """Trips and gaps in one order, numbered from 1: user_id, trip_num, trip_code, first, last.

    A gap stands before the trip that it precedes; a gap that is too short is part of that trip."""
    a = trips.select("user_id", "segment_group", F.lit(2).alias("after"), "trip_code", "first", "last")
    b = gap_codes(gaps).where("trip_code <> 103").select(
        "user_id", "segment_group", F.when(F.col("leads_out"), 0).otherwise(1).alias("after"), "trip_code", F.col("prev_last").alias("first"), F.col("first").alias("last")
    )
    w = Window.partitionBy("user_id").orderBy("segment_group", "after")
    return a.unionByName(b).withColumn("trip_num", F.row_number().over(w)).drop("segment_group", "after")


def lone_fates(trips: DataFrame, locations: DataFrame | None = None, break_s: int = 1200, distance_m: float = 150.0) -> DataFrame:
    """Trips with fate (previous, next, keep or drop for lone points, else null), at (the time that an attached point takes) and host (the trip whose points it joins; null if dropped).

    A lone point joins the trip before or after it, if that is near in time or
    place (the sooner of two), stays alone at a known place, and else is dropped.
    The trip that a point joins is no lone point any more, and an attached
    point's time, which the next test sees, becomes that of the end it was tested
    against. So the tests are windows, all but one: how long ago the trip before
    ended, which is replayed in order. The point then joins the last trip that is
    left (`drop` if there is none)."""
    near = lambda a, b: F.coalesce(F.expr(geo.planar(f"{a}.easting", f"{a}.northing", f"{b}.easting", f"{b}.northing")) <= distance_m, F.lit(False))
    df = trips.withColumns({"_prev": F.lag("last").over(by_key()), "_next": F.lead("first").over(by_key())})
    df = df.withColumns({"_t": F.col("last.t"), "_next_t": F.col("_next.t"), "_near_prev": near("_prev", "first"), "_near_next": near("first", "_next"), "_known": F.lit(False)})
    if locations is not None:
        known = locations.groupBy("user_id").agg(F.collect_list(F.struct("easting", "northing")).alias("_places"))
        within = F.exists("_places", lambda q: F.sqrt(F.pow(q["easting"] - F.col("first.easting"), 2) + F.pow(q["northing"] - F.col("first.northing"), 2)) <= distance_m)
        df = df.join(known, "user_id", "left").withColumn("_known", F.coalesce(within, F.lit(False))).drop("_places")

    def rule(state, row):
        """State: time at which the trip before ended, and whether it joined this one."""
        points, t, next_t, near_prev, near_next, known = row
        before, joined = state or (None, False)
        if points != 1 or joined:
            return (None, None), (t, False)
        waits = None if next_t is None else next_t - t
        near_next = near_next or waits is not None and waits <= break_s
        near_prev = before is not None and (near_prev or t - before <= break_s)
        if near_prev and (not near_next or t - before <= waits):
            return ("previous", before), (before, False)
        if near_next:
            return ("next", next_t), (next_t, True)
        return ("keep" if known else "drop", t), (t, False)

    df = replay(df, "user_id", "segment_group", ["n_points", "_t", "_next_t", "_near_prev", "_near_next", "_known"], rule, "fate string, at long")
    alive = F.when(F.col("fate").isNull() | (F.col("fate") == "keep"), F.col("segment_group"))
    df = df.withColumns({"_alive": F.last(alive, ignorenulls=True).over(by_key()), "_later": F.lead("segment_group").over(by_key())})
    host = F.when(F.col("fate") == "next", F.col("_later")).when(F.col("fate") == "drop", None).otherwise(F.col("_alive"))
    df = df.withColumn("host", host).withColumn("fate", F.when((F.col("fate") == "previous") & F.col("host").isNull(), "drop").otherwise(F.col("fate")))
    return df.drop("_prev", "_next", "_t", "_next_t", "_near_prev", "_near_next", "_known", "_alive", "_later")


def lone_points(trips: DataFrame, locations: DataFrame, break_s: int = 1200, distance_m: float = 150.0) -> DataFrame:
    """Trips of one point, each with fate: previous, next, keep or drop."""
    return lone_fates(trips, locations, break_s, distance_m).where(F.col("fate").isNotNull()).select("user_id", "segment_group", "fate")


def hosted_trips(trips: DataFrame) -> DataFrame:
    """The trips that lone_fates() leaves, in the columns of linked_trips(); segments has (keys, at): the time that an attached point takes."""
    at = lambda end: F.col(end).withField("t", F.coalesce("at", F.col(f"{end}.t")))
    places = "first_place" in trips.columns
    df = trips.where(F.col("host").isNotNull()).groupBy("user_id", "host").agg(
        F.min(F.struct("segment_group", at("first").alias("first"), *(["first_place"] if places else []))).alias("_f"),
        F.max(F.struct("segment_group", at("last").alias("last"), *(["last_place"] if places else []))).alias("_l"),
        F.sum("n_points").alias("n_points"), F.max(F.when(F.col("segment_group") == F.col("host"), F.col("labels"))).alias("labels"), F.sum("total").alias("total"),
        F.collect_list(F.struct("segments", "at")).alias("segments"),
    )
    return df.select("user_id", F.col("host").alias("segment_group"), "_f.first", "_l.last", *(["_f.first_place", "_l.last_place"] if places else []), "n_points", "labels", "total", "segments")


def trip_points(points: DataFrame) -> DataFrame:
    """Points of trips with trip_num, seq and the running trip_distance, the first point's leading gap included."""
    w = Window.partitionBy("user_id", "trip_key").orderBy("t", "point_id")
    num = F.dense_rank().over(Window.partitionBy("user_id").orderBy("trip_key"))
    return points.withColumns({"trip_num": num, "seq": F.row_number().over(w), "trip_distance": F.round(F.sum("distance_before").over(w), 3)})


def phone_diary(
    points: DataFrame, entrances: DataFrame, rules: list[tuple[str, Column]], locations: DataFrame | None = None, min_m: float = 250.0, radius_m: float = 200.0, cold_start_m: float = 750.0,
    lone_break_s: int = 1200, lone_distance_m: float = 150.0,
) -> DataFrame:
    """The whole of it, from cleaned and segmented points to the points of a numbered diary: user_id, trip_num, trip_code, merge_codes, seq, point_id, t, lat, lon, h_accuracy, distance_before, period_before, trip_distance.

    Segments are linked by the rules, lone points join a neighbour, stay at one of
    `locations` or go, and gaps between trips become trips of two points. A trip
    after a cold start or a gap that is too short begins with a copy of the point
    before it, at the trip's own starting time (point_id null, with that point's
    distance_before), and then the way from there counts towards its length. Codes follow trip_codes() and gap_codes();
    merge_codes has the labels of a trip's links and of a gap that it took in.

    All rules but one are windows over the users' segments; points are joined
    once, at the end, with the rows that each segment's trip has become."""
    if "h_accuracy" not in points.columns:
        points = points.withColumn("h_accuracy", F.lit(None).cast("double"))
    segments = with_gap(end_places(segment.summaries(points), entrances, radius_m))
    trips = lone_fates(linked_trips(link_keys(segments, rules)), locations, lone_break_s, lone_distance_m)
    trips = with_gap_kinds(hosted_trips(trips), min_m, cold_start_m)
    copied = F.coalesce(F.col("kind").isin("cold_start", "too_short"), F.lit(False))
    trips = trips.withColumns({"too_short": F.coalesce(F.col("kind") == "too_short", F.lit(False)), "copied": copied})
    trips = trips.withColumns({
        "cumulative_distance": F.round(F.when(F.col("copied"), F.col("total")).otherwise(F.col("total") - F.col("first.distance_before")), 3),
        "n_points": F.col("n_points") + F.col("copied").cast("int"), "out_of": F.when(F.lag("kind").over(by_key()) == "known_location", F.lag("first").over(by_key())),
    })
    trips = trip_codes(trips).withColumn("merge_codes", F.array_join(F.when(F.col("too_short"), F.array_append("labels", F.lit("too short"))).otherwise(F.col("labels")), ", "))

    number = lambda kind, x: F.lit(x).cast(kind)
    row = lambda after, place, code, group, at, t, far, waits, accuracy: F.struct(
        F.lit(after).alias("after"), F.lit(place).alias("place"), code.cast("int").alias("trip_code"), (number("long", None) if group is None else group).alias("segment_group"), t.cast("long").alias("t"),
        (number("double", None) if at is None else F.col(f"{at}.lat")).alias("lat"), (number("double", None) if at is None else F.col(f"{at}.lon")).alias("lon"),
        accuracy.cast("double").alias("h_accuracy"), far.cast("double").alias("distance_before"), waits.cast("long").alias("period_before"),
    )
    jump = lambda after, code, a, b, far, waits: F.array(
        row(after, 1, code, None, a, F.col(f"{a}.t"), F.lit(0), F.lit(0), F.lit(-1)), row(after, 2, code, None, b, F.col(f"{b}.t"), far, waits, F.lit(-1))
    )
    none = F.array().cast(trips.select(jump(0, F.lit(0), "first", "last", F.lit(0), F.lit(0)).alias("x")).schema["x"].dataType)
    own = F.flatten(F.transform("segments", lambda s: F.transform(s["segments"], lambda g: row(2, 1, F.col("trip_code"), g, None, s["at"], F.lit(None), F.lit(None), F.lit(None)))))
    waits = F.when(F.col("kind") == "cold_start", F.col("first.period_before")).otherwise(F.col("prev_last.period_before"))
    copy = F.array(row(2, 0, F.col("trip_code"), None, "prev_last", F.col("first.t"), F.col("prev_last.distance_before"), waits, F.col("prev_last.h_accuracy")))
    before = F.when(F.col("kind").isin("general", "subway", "known_location"), jump(1, gap_code(), "prev_last", "first", F.col("gap_m"), F.col("gap_s"))).otherwise(none)
    out_of = F.when(F.col("out_of").isNotNull(), jump(0, F.lit(104), "out_of", "first", F.lit(0), F.lit(0))).otherwise(none)
    rows = trips.select("user_id", F.col("segment_group").alias("trip_key"), "merge_codes", F.explode(F.concat(out_of, before, F.when(F.col("copied"), copy).otherwise(none), own)).alias("x"))
    rows = rows.select("user_id", "trip_key", F.when(F.col("x.after") == 2, F.col("merge_codes")).alias("merge_codes"), "x.*")

    real = points.select("user_id", "segment_group", "point_id", *[F.col(c).alias(f"_{c}") for c in ("t", "lat", "lon", "h_accuracy", "distance_before", "period_before")])
    every = rows.join(real, ["user_id", "segment_group"], "left")
    num = F.dense_rank().over(Window.partitionBy("user_id").orderBy("trip_key", "after"))
    w = Window.partitionBy("user_id", "trip_key", "after").orderBy("place", "_t", "point_id")
    filled = every.withColumns({c: F.coalesce(c, f"_{c}") for c in ("t", "lat", "lon", "h_accuracy", "distance_before", "period_before")})
    out = filled.withColumns({"trip_num": num, "seq": F.row_number().over(w), "trip_distance": F.round(F.sum("distance_before").over(w), 3)})
    return out.select("user_id", "trip_num", "trip_code", "merge_codes", "seq", "point_id", "t", "lat", "lon", "h_accuracy", "distance_before", "period_before", "trip_distance")


def diary_summaries(diary: DataFrame, timezone: str) -> DataFrame:
    """A row for each trip of a phone diary: ends in UTC and local time, code, merge codes, origin and destination, distances."""
    from ..functions.time import local

    at = F.struct("seq", "t", "lat", "lon", "trip_distance")
    df = diary.groupBy("user_id", "trip_num").agg(F.first("trip_code").alias("trip_code"), F.first("merge_codes").alias("merge_codes"), F.min(at).alias("o"), F.max(at).alias("d"))
    utc = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    planar = F.expr(geo.planar(geo.easting("o.lat", "o.lon"), geo.northing("o.lat", "o.lon"), geo.easting("d.lat", "d.lon"), geo.northing("d.lat", "d.lon")))
    return df.select(
        "user_id", F.col("trip_num").alias("trip_id"), utc("o.t").alias("start_UTC"), local(utc("o.t"), timezone).alias("start"), utc("d.t").alias("end_UTC"), local(utc("d.t"), timezone).alias("end"),
        "trip_code", "merge_codes", F.col("o.lat").alias("olat"), F.col("o.lon").alias("olon"), F.col("d.lat").alias("dlat"), F.col("d.lon").alias("dlon"),
        F.round(planar, 3).alias("direct_distance"), F.col("d.trip_distance").alias("cumulative_distance"),
    )


def older_distances(points: DataFrame, key: str = "trip_num", note: str = "note", short: str = "missing trip - less than 250m", single: str = "single point", order: tuple[str, ...] = ("t", "point_id")) -> DataFrame:
    """Points with distance, trip_distance and avg_speed (m/s) by the older rule, from the anchor: the last point of the trip before it that doesn't carry the note of a short gap.

    A trip begins at its own first point whatever its note. Without a pause
    before it (break_period not above zero), a point has the speed of the one
    before. A trip of two points, a short gap and a single point, has none of the
    three. The anchor is a last-value window, and so is the speed carried on."""
    order = Window.partitionBy("user_id", key).orderBy(*order)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("user_id", key)
    df = points.withColumns({
        "_i": F.row_number().over(order), "_n": F.count("*").over(whole), "_short": F.max((F.col(note) == short).cast("int")).over(whole), "_single": F.max((F.col(note) == single).cast("int")).over(whole),
    })
    none = (F.col("_n") == 2) & (F.coalesce("_short", F.lit(0)) == 1) & (F.coalesce("_single", F.lit(0)) == 1)
    stands = (F.col("_i") == 1) | ~F.col(note).eqNullSafe(short)
    df = df.withColumn("_anchor", F.last(F.when(stands, F.struct("easting", "northing")), ignorenulls=True).over(before))
    far = F.expr(geo.planar("_anchor.easting", "_anchor.northing", "easting", "northing"))
    df = df.withColumn("distance", F.when((F.col("_i") == 1) | none, 0.0).otherwise(F.round(far, 3)))
    speed = F.when((F.col("_i") == 1) | none, 0.0).when(F.col("break_period") > 0, F.col("distance") / F.col("break_period"))
    df = df.withColumns({"trip_distance": F.round(F.sum("distance").over(order), 3), "avg_speed": F.last(speed, ignorenulls=True).over(order)})
    return df.drop("_i", "_n", "_short", "_single", "_anchor")
