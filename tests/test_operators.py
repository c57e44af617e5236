"""Micro-trajectories with expected rows written by hand, and sequential versions of the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.functions.time import split_at_midnight, split_days
from tripweave.operators import activity, clean, cluster, days, segment, stitch

POINT = "user_id long, point_id long, t long, lat double, lon double, h_accuracy double"


def points(spark, rows):
    return clean.with_utm(spark.createDataFrame([(1, i, t, lat, lon, acc) for i, (t, lat, lon, acc) in enumerate(rows)], POINT))


def ends(spark, rows):
    """Trips from (first t, e, n, last t, e, n, points)."""
    end = "struct<t: long, point_id: long, lat: double, lon: double, easting: double, northing: double>"
    data = [(1, i, (a, i, 0.0, 0.0, float(b), float(c)), (d, i, 0.0, 0.0, float(e), float(f)), n) for i, (a, b, c, d, e, f, n) in enumerate(rows)]
    return spark.createDataFrame(data, f"user_id long, segment_group long, first {end}, last {end}, n_points long")


def test_utm_vectors(spark):
    df = spark.createDataFrame([(51.2, 7.5), (45.5, -73.6)], "lat double, lon double")
    got = df.select(F.expr(geo.easting("lat", "lon")), F.expr(geo.northing("lat", "lon")), F.expr(geo.zone("lat", "lon")), F.expr(geo.zone_letter("lat"))).collect()
    assert got[0][0] == pytest.approx(395201.310381, abs=1e-5) and got[0][1] == pytest.approx(5673135.241182, abs=1e-5)
    assert tuple(got[0][2:]) == (32, "U") and tuple(got[1][2:]) == (18, "T")
    assert got[1][0] == pytest.approx(609377.347425, abs=1e-5) and got[1][1] == pytest.approx(5039449.713228, abs=1e-5)


def test_vincenty_known_line():
    # One degree of latitude from the equator on WGS-84, and one of longitude on it.
    import numpy as np

    got = geo.vincenty_inverse(np.array([0.0, 0.0, 10.0]), np.zeros(3), np.array([1.0, 0.0, 10.0]), np.array([0.0, 1.0, 0.0]))
    assert got[0] == pytest.approx(110574.389, abs=1e-3) and got[1] == pytest.approx(111319.491, abs=1e-3) and got[2] == 0


def test_accuracy_is_inclusive_and_needs_a_value(spark):
    got = clean.accuracy_filter(points(spark, [(0, 45.5, -73.6, 50.0), (1, 45.5, -73.6, 50.1), (2, 45.5, -73.6, None)]), 50.0)
    assert [r.point_id for r in got.collect()] == [0]


def test_gap_of_exactly_the_limit_stays(spark):
    got = segment.gap_segments(points(spark, [(0, 45.5, -73.6, 1.0), (300, 45.5, -73.6, 1.0), (601, 45.5, -73.6, 1.0)]), 300)
    assert [r.segment_group for r in got.orderBy("t").collect()] == [0, 0, 1]


def test_spikes_look_at_the_last_kept_point(spark):
    spike = clean.spike_filter(points(spark, [(0, 45.5, -73.6, 1.0), (10, 45.6, -73.6, 1.0), (20, 45.5001, -73.6, 1.0), (30, 45.5002, -73.6, 1.0)]), 100.0)
    assert [r.point_id for r in spike.orderBy("t").collect()] == [0, 2, 3]
    # The second point leads on, so it stays; seen from the third, the fourth is the spike.
    moved = [(0, 45.5, -73.6, 1.0), (10, 45.6, -73.6, 1.0), (20, 45.601, -73.6, 1.0), (30, 45.5001, -73.6, 1.0), (40, 45.5002, -73.6, 1.0)]
    assert [r.point_id for r in clean.spike_filter(points(spark, moved), 100.0).orderBy("t").collect()] == [0, 1, 2, 4]


def test_logger_preprocess_drops_still_points(spark):
    got = clean.logger_preprocess(points(spark, [(0, 45.5, -73.6, 1.0), (1, 45.5, -73.6, 1.0), (2, 45.5000003, -73.6, 1.0), (3, 45.501, -73.6, 1.0), (3, 45.502, -73.6, 1.0)]))
    assert [r.point_id for r in got.orderBy("t").collect()] == [0, 3]


def test_pairs_only_closed_form(spark):
    rng = random.Random(1)
    rows = [(u, i, rng.random() < 0.6) for u in range(40) for i in range(25)]
    got = {(r.user_id, r.segment_group): r.link for r in stitch.pair_links(spark.createDataFrame(rows, "user_id long, segment_group long, c boolean"), "c").collect()}
    for u in range(40):
        before = False
        for _, i, c in rows[u * 25 : u * 25 + 25]:
            before = c and not before
            assert got[u, i] == before


def test_gap_kinds_at_the_limits(spark):
    trips = ends(spark, [(0, 0, 0, 10, 0, 0, 5), (20, 0, 0, 30, 0, 0, 5), (40, 249, 0, 50, 0, 0, 5), (60, 250, 0, 70, 0, 0, 5), (80, 750, 0, 90, 0, 0, 5), (100, 751, 0, 110, 0, 0, 5)])
    places = spark.createDataFrame([], "place_id long, easting double, northing double")
    got = [r.kind for r in stitch.missing_trips(trips, places).orderBy("segment_group").collect()]
    assert got == [None, "too_short", "cold_start", "cold_start", "general"]


def test_subway_limits_and_stations(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0)], "place_id long, easting double, northing double")
    trips = ends(spark, [(0, 900, 0, 10, 0, 0, 5), (4809, 5000, 0, 4900, 0, 0, 5), (9700, 5000, 0, 9800, 0, 0, 5)])
    got = [r.link for r in stitch.subway_links(trips, places).orderBy("segment_group").collect()]
    assert got == [False, True, False]  # 4799 s; then 4800 s


def test_lone_points_five_fates(spark):
    none = spark.createDataFrame([(1, 9000.0, 0.0)], "user_id long, easting double, northing double")
    hour = 3600
    trips = ends(spark, [
        (0, 0, 0, 10, 0, 0, 5), (1000, 2000, 0, 1000, 2000, 0, 1),  # near the one before in time
        (9 * hour, 4000, 0, 9 * hour, 4000, 0, 1), (9 * hour + 1100, 6000, 0, 9 * hour + 1200, 6000, 0, 5),  # near the next
        (20 * hour, 9000, 0, 20 * hour, 9000, 0, 1),  # at a known place
        (30 * hour, 20000, 0, 30 * hour, 20000, 0, 1),  # nowhere
        (40 * hour, 0, 0, 41 * hour, 0, 0, 5),
    ])
    got = {r.segment_group: r.fate for r in stitch.lone_points(trips, none).collect()}
    assert got == {1: "previous", 2: "next", 4: "keep", 5: "drop"}


def test_two_states_against_a_loop(spark):
    from pyspark.sql import Window

    from tripweave.operators.automaton import two_state

    rng = random.Random(4)
    rows = [(u, i, rng.choice((True, False, None)), rng.choice((True, False))) for u in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, "u long, i long, a boolean, b boolean")
    for begins in (False, True):
        got = {(r.u, r.i): r.s for r in two_state(df, Window.partitionBy("u").orderBy("i"), F.col("a"), F.col("b"), "s", begins).collect()}
        for u in range(30):
            state = begins
            for _, i, a, b in rows[u * 20 : u * 20 + 20]:
                state = b if state else bool(a)
                assert got[u, i] == state


def test_restarts_against_the_sequential_rules(spark):
    """Many stretches and few: the replay between restarts gives what one pass over a user's points gives."""
    rng = random.Random(8)
    rows = []
    for u in range(12):
        t, x, y = 0, 0.0, 0.0
        for i in range(150):
            t += rng.choice((0, 1, 5, 20, 300, 5000)) if u % 2 else rng.choice((0, 1, 2))
            jump = rng.random() < 0.3
            x, y = (rng.gauss(0, 3000), rng.gauss(0, 3000)) if jump else (x + rng.choice((0.0, 5e-7, 20.0)), y)
            rows.append((u, i, t, 45.5 + y / 111000, -73.6 + x / 78000, x, y))
    df = spark.createDataFrame(rows, "user_id long, point_id long, t long, lat double, lon double, easting double, northing double")
    spikes = {(r.user_id, r.point_id) for r in clean.spike_filter(df, 100.0).collect()}
    steps = {(r.user_id, r.point_id) for r in clean.logger_preprocess(df).collect()}
    limit, want_spikes, want_steps = 100 / 3.6, set(), set()
    for u in range(12):
        own = [r for r in rows if r[0] == u]
        last = None
        for r, after in zip(own, [*own[1:], None]):
            if last is not None and after is not None:
                d, dt = math.dist(r[5:], last[5:]), r[2] - last[2]
                if d and dt and d / dt >= limit and math.dist(after[5:], last[5:]) < d:
                    continue
            last = r
            want_spikes.add((u, r[1]))
        last = None
        for r in own:
            if last is not None:
                p, q = math.radians(last[3]), math.radians(r[3])
                a = (math.sin((q - p) / 2) ** 2 + math.sin(math.radians(r[4] - last[4]) / 2) ** 2) * math.cos(p) * math.cos(q)
                if r[2] == last[2] or geo.EARTH_M * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) < 0.1:
                    continue
            last = r
            want_steps.add((u, r[1]))
    assert spikes == want_spikes and 0 < len(spikes) < len(rows)
    assert steps == want_steps and 0 < len(steps) < len(rows)


def test_lone_points_against_the_sequential_rule(spark):
    """Runs of lone points: an attached point's time is seen by the next test, a trip that a point joined is no lone one."""
    rng = random.Random(12)
    rows, want = [], {}
    for u in range(30):
        t, own = 0, []
        for i in range(40):
            t += rng.choice((400, 700, 1100, 1300, 9000))
            x = rng.choice((0.0, 100.0, 260.0, 5000.0, 90000.0))
            own.append([t, x, t + (200 if rng.random() < 0.25 else 0)])
            rows.append((u, i, (t, i, 0.0, 0.0, x, 0.0), (own[-1][2], i, 0.0, 0.0, x, 0.0), 1 if own[-1][2] == t else 3))
        trips = [{"key": i, "t": [a[0], a[2]], "x": a[1], "n": 1 if a[0] == a[2] else 3} for i, a in enumerate(own)]
        left = 0
        for i, trip in enumerate(trips):
            if trip["n"] != 1:
                left += 1
                continue
            before, after = trips[i - 1] if i else None, trips[i + 1] if i + 1 < len(trips) else None
            near_before = before is not None and (trip["t"][0] - before["t"][1] <= 1200 or abs(trip["x"] - before["x"]) <= 150)
            near_after = after is not None and (after["t"][0] - trip["t"][0] <= 1200 or abs(trip["x"] - after["x"]) <= 150)
            if near_before and (not near_after or trip["t"][0] - before["t"][1] <= after["t"][0] - trip["t"][0]):
                trip["t"] = [before["t"][1]] * 2
                want[u, i] = "previous" if left else "drop"
            elif near_after:
                after["n"] += 1
                want[u, i] = "next"
            elif abs(trip["x"] - 5000.0) <= 150:
                want[u, i] = "keep"
                left += 1
            else:
                want[u, i] = "drop"
    end = "struct<t: long, point_id: long, lat: double, lon: double, easting: double, northing: double>"
    trips = spark.createDataFrame(rows, f"user_id long, segment_group long, first {end}, last {end}, n_points long")
    known = spark.createDataFrame([(u, 5000.0, 0.0) for u in range(30)], "user_id long, easting double, northing double")
    got = {(r.user_id, r.segment_group): r.fate for r in stitch.lone_points(trips, known).collect()}
    assert got == want and set(want.values()) == {"previous", "next", "keep", "drop"}


def test_gap_that_is_skipped_is_no_base(spark):
    """The second trip starts where the first ended; the third is compared with the first, not with the second."""
    trips = ends(spark, [(0, 0, 0, 10, 50, 0, 5), (20, 50, 0, 30, 5000, 0, 5), (40, 50, 0, 50, 9000, 0, 5), (60, 9400, 0, 70, 9400, 0, 5)])
    got = [(r.kind, r.gap_m) for r in stitch.missing_trips(trips, spark.createDataFrame([], "place_id long, easting double, northing double")).orderBy("segment_group").collect()]
    assert got == [(None, 0.0), (None, 0.0), ("general", 9350.0)]


def test_known_place_has_two_gaps(spark):
    """A lone point at a known place is led into and out of; the gap after it that is too short still becomes part of the next trip."""
    trips = ends(spark, [(0, 0, 0, 10, 0, 0, 5), (9000, 3000, 0, 9000, 3000, 0, 1), (20000, 3200, 0, 21000, 6000, 0, 5)])
    gaps = stitch.missing_trips(trips, spark.createDataFrame([], "place_id long, easting double, northing double"))
    got = sorted((r.segment_group, r.leads_out, r.trip_code, r.gap_m) for r in stitch.gap_codes(gaps).collect())
    assert got == [(1, False, 104, 3000.0), (2, False, 103, 200.0), (2, True, 104, 0.0)]


def test_older_diary_by_hand(spark):
    """Each gap kind once, a lone point to the nearer trip, the short gap as a row of the trip, whole days dropped from a pause."""
    from tripweave.operators import older

    day, rows = 86400, []

    def walk(t, *xs):
        rows.extend((1, len(rows) + k, t + 60 * k, 45.0 + x / 1e5, -73.0, float(x), 0.0, 5.0) for k, x in enumerate(xs))

    walk(0, 0, 200, 400)  # trip 1
    walk(1000, 500, 800, 1100)  # after a short gap of 100 m
    walk(2 * day, 1700, 2100)  # cold start: 600 m, a pause of two days less some time
    walk(3 * day, 9000)  # a lone point, nearer to the trip after it
    walk(3 * day + 2000, 9100, 9700)
    walk(5 * day, 30000, 30400)  # from station to station
    df = spark.createDataFrame(rows, "user_id long, point_id long, t long, lat double, lon double, easting double, northing double, h_accuracy double")
    stations = spark.createDataFrame([(1, 9800.0, 0.0), (2, 30100.0, 0.0)], "place_id long, easting double, northing double")
    got = older.summaries(older.diary_rows(segment.gap_segments(df, 300), stations)).orderBy("trip_id").collect()
    assert [(r.trip_id, r.trip_code, r.cumulative_distance, r.merge_codes) for r in got] == [
        (1, 1, 400.0, ""), (2, 1, 700.0, "missing trip - less than 250m"), (3, 1, 1000.0, "cold start"), (4, 101, 6900.0, "missing trip, single point - before"),
        (5, 1, 700.0, "single point - before"), (6, 102, 20300.0, "missing trip - metro"), (7, 1, 400.0, ""),
    ]
    lone = older.diary_rows(segment.gap_segments(df, 300), stations).where("trip = 5").orderBy("place").collect()
    assert [(r.easting, r.t) for r in lone] == [(9000.0, 3 * day + 2000), (9100.0, 3 * day + 2000), (9700.0, 3 * day + 2060)]
    cold = older.diary_rows(segment.gap_segments(df, 300), stations).where("trip = 3 and place = 1").first()
    assert cold.point_id is None and cold.break_period == (2 * day - 1120) % day and cold.t == 2 * day


def test_places_of_a_crowd_are_compared_with_few(spark):
    """3,000 places at 400 positions around 300 points: first and last as by brute force, and no cell keeps more than a few places to compare."""
    import random

    rng = random.Random(8)
    spots = [(round(rng.uniform(0, 900), 3), round(rng.uniform(0, 900), 3)) for _ in range(400)] + [(200.0, 0.0), (-200.0, 0.0)]
    places = [(i, *rng.choice(spots)) for i in range(3000)]
    rows = [(1, i, round(rng.uniform(-400, 1300), 3), round(rng.uniform(-400, 1300), 3)) for i in range(300)] + [(1, 300, 0.0, 0.0), (1, 301, None, 5.0)]
    near = spark.createDataFrame([*places, (3000, None, 1.0), (3001, float("nan"), 1.0)], "place_id long, easting double, northing double")
    pts = spark.createDataFrame(rows, "user_id long, point_id long, easting double, northing double")
    for last, pick in ((False, min), (True, max)):
        got = {r.point_id: r.place for r in stitch.within(pts, near, 200.0, last=last).collect()}
        for _, i, e, n in rows:
            ids = [] if e is None else [p for p, x, y in places if ((x - e) ** 2 + (y - n) ** 2) ** 0.5 <= 200.0]
            assert got[i] == (pick(ids) if ids else None)
        assert max(len(r["_open"] or []) for r in stitch._nearby(near, 200.0, last).collect()) < 60


def test_within_first_and_last(spark):
    pts = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1000.0, 0.0)], "user_id long, point_id long, easting double, northing double")
    places = spark.createDataFrame([(3, 10.0, 0.0), (5, 150.0, 0.0), (7, 201.0, 0.0)], "place_id long, easting double, northing double")
    first = {r.point_id: r.place for r in stitch.within(pts, places, 200.0).collect()}
    last = {r.point_id: r.place for r in stitch.within(pts, places, 200.0, last=True).collect()}
    assert first == {1: 3, 2: None} and last == {1: 5, 2: None}


def test_trip_codes(spark):
    rows = [(249.0, [], False, 5), (250.0, [], False, 5), (300.0, ["subway"], False, 5), (300.0, ["walking"], False, 5), (300.0, [], True, 1), (300.0, [], True, 5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cumulative_distance double, labels array<string>, too_short boolean, n_points long")
    assert [r.trip_code for r in stitch.trip_codes(df).orderBy("i").collect()] == [202, 1, 2, -1, 201, 1]


def test_inactivity_is_a_suffix_maximum(spark):
    import datetime as dt

    active = [1, 0, 1, 0, 0, 0, 1]
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, d + dt.timedelta(i), bool(a)) for i, a in enumerate(active)], "user_id long, date date, has_trips boolean")
    got = days.inactivity(df).orderBy("date").collect()
    assert [r.consecutive_inactive_days for r in got] == [None, 1, None, 1, 2, 3, None]
    assert [r.inactive_day_streak for r in got] == [None, 3, None, 3, 3, 3, None] and {r.inactivity_streak for r in got} == {3}


def test_midnight_and_day_splits(spark):
    df = spark.sql("select 1 id, timestamp_ntz'2024-01-01 22:00:00' s, timestamp_ntz'2024-01-02 01:00:00' e union all select 2, timestamp_ntz'2024-01-05 00:00:00', timestamp_ntz'2024-02-05 01:00:00'")
    got = sorted((r.id, str(r.date), r.seconds) for r in split_at_midnight(df, "s", "e").collect())
    assert got == [(1, "2024-01-01", 7200.0), (1, "2024-01-02", 3600.0), (2, "2024-01-05", 31 * 86400 + 3600.0)]
    whole = {r.id: r.x for r in split_days(df, "s", "e").groupBy("id").agg(F.sum("seconds").alias("x")).collect()}
    assert whole == {1: 3 * 3600.0, 2: 31 * 86400 + 3600.0}


def test_labels_first_and_last(spark):
    pts = spark.createDataFrame([(1, 1, 45.5, -73.6), (2, 2, 45.5, -73.6)], "user_id long, point_id long, lat double, lon double")
    locs = spark.createDataFrame([(1, 0, "home", 45.5, -73.6), (1, 1, "work", 45.5001, -73.6)], "user_id long, place_order int, label string, lat double, lon double")
    assert {r.point_id: r.label for r in activity.label_points(pts, locs, 50.0).collect()} == {1: "work", 2: None}
    assert {r.point_id: r.label for r in activity.label_points(pts, locs, 50.0, last=False).collect()} == {1: "home", 2: None}


def test_two_means_is_optimal(spark):
    rng = random.Random(3)
    rows = [(u, i, i, round(rng.random() * 60, 2)) for u in range(6) for i in range(12)]
    df = cluster.two_means(spark.createDataFrame(rows, "user_id long, point_id long, t long, v double"), "v")
    got = {(r.user_id, r.point_id): r.kmeans for r in df.collect()}
    for u in range(6):
        xs = sorted({min(50.0, r[3]) for r in rows if r[0] == u})
        vs = [min(50.0, r[3]) for r in rows if r[0] == u]

        def sse(c, vs=vs):
            parts = [[v for v in vs if v <= c], [v for v in vs if v > c]]
            return sum(sum((v - sum(p) / len(p)) ** 2 for v in p) for p in parts)

        best = min(xs[:-1], key=sse)
        assert all(got[u, r[1]] == ("trip" if min(50.0, r[3]) > best else "stop") for r in rows if r[0] == u)


def test_rolling_average_borders(spark):
    df = spark.createDataFrame([(1, i, i, 1.0) for i in range(22)], "user_id long, point_id long, t long, v double")
    got = [r.rolling_avg for r in clean.rolling_average(df, "v").orderBy("t").collect()]
    assert [i for i, v in enumerate(got) if v is not None] == [11] and got[11] == pytest.approx(20 / 21)


def test_condense_is_transitive(spark):
    df = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate((0.0, 140.0, 280.0, 1000.0))], "user_id long, k long, easting double, northing double")
    got = [(r.place, r.easting) for r in cluster.condense(df, "k").orderBy("place").collect()]
    assert got == [(1, 140.0), (2, 1000.0)]


def test_locations_take_the_first_match(spark):
    """Two two-means centres match one heading centre: it stands twice; the first in order of two matches is taken; no user is gathered in a group."""
    spots = lambda *xy: spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate(xy)], "user_id long, k long, easting double, northing double")
    got = cluster.activity_locations(spots(1000, 300, 330, 5000), spots(1040, 315, 960), "k", "k", radius_m=10.0)
    assert [(r.label, r.easting) for r in got.orderBy("label").collect()] == [("location_1", 1040.0), ("location_2", 315.0), ("location_3", 315.0)]
    plan = cluster.condense(spots(1, 2), "k")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_dbscan_against_sequential(spark):
    rng = random.Random(5)
    pts = [(u, i, i, rng.gauss(0, 60) + 300 * rng.randint(0, 2), rng.gauss(0, 60)) for u in range(3) for i in range(120)]
    got = {(r.user_id, r.point_id): r.cluster for r in cluster.dbscan(spark.createDataFrame(pts, "user_id long, point_id long, t long, easting double, northing double"), 30.0, 6).collect()}
    for u in range(3):
        own = [(p[1], p[3], p[4]) for p in pts if p[0] == u]
        near = {a[0]: [b[0] for b in own if math.dist(a[1:], b[1:]) < 30.0] for a in own}
        core = {k for k, v in near.items() if len(v) >= 6}
        label, n = {}, 0
        for k in sorted(core):
            if k not in label:
                n += 1
                stack = [k]
                while stack:
                    x = stack.pop()
                    if x in core and x not in label:
                        label[x] = n
                        stack += near[x]
        for k, _, _ in own:
            want = label.get(k) or min((label[q] for q in near[k] if q in core), default=-1)
            assert got[u, k] == want


def test_order_and_partitions_do_not_matter(spark):
    from tripweave.plans.queries import segment_summary

    once = {tuple(r) for r in segment_summary(spark, "/root/testdata/sf0.001").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = {tuple(r) for r in segment_summary(spark, "/root/testdata/sf0.001").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert once == again
