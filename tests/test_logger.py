"""Stay splitting against a walk over each segment, point by point."""

import math
import random

from tripweave.operators import logger


def walk(points, places, period):
    """points: (segment, id, t, e, n) in order; yields {id: (segment, piece)}."""
    out, segments = {}, sorted({p[0] for p in points})

    def lead(trace, spot):
        anchor, least = None, 1e17
        for i, p in enumerate(trace):
            if anchor is None:
                if math.dist(p[3:], spot) <= 200:
                    anchor = p
                continue
            d = math.dist(anchor[3:], p[3:])
            if d >= least:
                return trace[:i]
            least = d
        return trace

    for s in segments:
        pieces, held = [[]], []
        label = lambda p: next((k for k, spot in enumerate(places) if math.dist(p[3:], spot) <= 60), None)

        def common(held=held, label=label):
            names = [label(p) for p in held]
            return places[max(dict.fromkeys(names), key=names.count)]

        def approach():
            if pieces[-1]:
                last = pieces[-1][-1]
                pieces[-1] += [p for p in lead(held[: round(len(held) / 2)], common(held)) if p[2] - last[2] <= period]

        for c in (p for p in points if p[0] == s):
            if label(c) is not None:
                held.append(c)
                continue
            if held and held[-1][2] - held[0][2] >= period:
                approach()
                back = lead(held[round(len(held) / 2) :][::-1], common(held))
                pieces.append([p for p in back if c[2] - p[2] <= period] + [c])
            else:
                pieces[-1] += [*held, c]
            held = []
        if held and s != segments[-1]:
            pieces[-1] += held
        elif held:
            approach()
        for k, piece in enumerate(pieces):
            out |= {p[1]: (s, k) for p in piece}
    return out


def test_stays_split_segments(spark):
    rng = random.Random(4)
    places = [(0.0, 0.0), (1000.0, 0.0), (1050.0, 0.0)]
    rows, want = [], {}
    for u in range(25):
        e, n, t, own = rng.uniform(-200, 1200), 0.0, 0, []
        for i in range(80):
            t += rng.choice([20, 60, 90])
            if rng.random() < 0.5:
                x, y = rng.choice(places)
                e, n = e + (x - e) * 0.5, n + (y - n) * 0.5
            else:
                e, n = e + rng.uniform(-90, 90), n + rng.uniform(-40, 40)
            own.append((i // 40, i, t, e, n))
        rows += [(u, s, i, t, e, n, 0.0) for s, i, t, e, n in own]
        want |= {(u, i): v for i, v in walk(own, places, 300).items()}
    df = spark.createDataFrame(rows, "user_id long, segment_group long, point_id long, t long, easting double, northing double, distance_before double")
    spots = spark.createDataFrame([(u, k, f"l{k}", *p) for u in range(25) for k, p in enumerate(places)], "user_id long, place_order int, label string, easting double, northing double")
    got = {(r.user_id, r.point_id): (r.segment_group, r.piece) for r in logger.stop_split(df, spots, 300).collect()}
    assert got == want and any(p for _, p in want.values())


def test_diary_numbers_gaps_and_trips(spark):
    rows = [(1, 1, i, i * 10, 0.0, 0.0, i * 200.0, 0.0, 200.0) for i in range(4)] + [(1, 2, 9 + i, 900 + i * 10, 0.0, 0.0, 3000 + i * 200.0, 0.0, 200.0) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id long, key long, point_id long, t long, lat double, lon double, easting double, northing double, distance_before double")
    got = [(r.trip_num, r.trip_code, r.seq, r.trip_distance) for r in logger.diary(df).orderBy("trip_num", "seq").collect()]
    assert got[:4] == [(1, 1, k + 1, 200.0 * k) for k in range(4)] and got[4:6] == [(2, 101, 1, 0.0), (2, 101, 2, 2400.0)] and len(got) == 10


def test_located_points_are_computed_once(spark):
    """The first location in place_order within reach, by one join; users without locations keep their points."""
    from tripweave.operators import logger

    pts = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 500.0, 0.0), (2, 3, 0.0, 0.0)], "user_id long, point_id long, easting double, northing double")
    spots = spark.createDataFrame([(1, 1, "work", 10.0, 0.0), (1, 0, "home", 60.0, 0.0), (1, 2, "study", 439.0, 0.0)], "user_id long, place_order int, label string, easting double, northing double")
    df = logger._located(pts, spots)
    assert {r.point_id: r.stop and r.stop.label for r in df.collect()} == {1: "home", 2: None, 3: None}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
