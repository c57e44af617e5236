"""Density clusters over time against plain versions."""

import math
import random
from collections import defaultdict

import pytest

from tripweave.operators import density

POINT = "user_id long, point_id long, t long, easting double, northing double"


def plain_clusters(xy, least, k):
    """(cluster, probability) of points by the definitions: spanning forests cut at their greatest weight, from the whole down."""
    n = len(xy)
    k = min(k, n - 1)
    dist = [[math.dist(a, b) for b in xy] for a in xy]
    core = [sorted(row)[k] for row in dist]
    reach = [[max(dist[i][j], core[i], core[j]) for j in range(n)] for i in range(n)]

    def parts(points):
        """(weight at which the points hold together, what is left without links of that weight)."""
        points, tree = list(points), []
        best = {p: (reach[points[0]][p], points[0]) for p in points[1:]}
        while best:
            p = min(best, key=lambda q: best[q][0])
            w, a = best.pop(p)
            tree.append((w, a, p))
            for q in best:
                best[q] = min(best[q], (reach[p][q], p))
        top = max(w for w, _, _ in tree)
        near = defaultdict(list)
        for w, a, b in tree:
            if w < top:
                near[a].append(b)
                near[b].append(a)
        left, out = set(points), []
        while left:
            stack, seen = [left.pop()], []
            while stack:
                x = stack.pop()
                seen.append(x)
                for y in near[x]:
                    if y in left:
                        left.remove(y)
                        stack.append(y)
            out.append(seen)
        return top, out

    clusters = [{"points": {}, "birth": 0.0, "kids": [], "mass": 0.0, "most": 0.0}]

    def grow(points, c):
        while True:
            w, pieces = parts(points)
            level = 1 / w if w else math.inf
            me = clusters[c]
            me["most"] = max(me["most"], level)
            big = [p for p in pieces if len(p) >= least]
            for p in pieces:
                if len(p) < least:
                    for x in p:
                        me["points"][x] = level
                        me["mass"] += level - me["birth"]
            if len(big) == 1:
                points = big[0]
                continue
            for p in big:
                me["mass"] += (level - me["birth"]) * len(p)
                clusters.append({"points": {}, "birth": level, "kids": [], "mass": 0.0, "most": 0.0})
                me["kids"].append(len(clusters) - 1)
                grow(p, len(clusters) - 1)
            return

    grow(range(n), 0)

    def choose(c):
        """(mass, clusters) of the best choice within c."""
        mass, inner = 0.0, []
        for kid in clusters[c]["kids"]:
            m, chosen = choose(kid)
            mass, inner = mass + m, inner + chosen
        return (mass, inner) if mass > clusters[c]["mass"] else (clusters[c]["mass"], [c])

    def under(c):
        yield from clusters[c]["points"].items()
        for kid in clusters[c]["kids"]:
            yield from under(kid)

    out = [(-1, 0.0)] * n
    for c in choose(0)[1]:
        most = clusters[c]["most"]
        for x, level in under(c):
            if c == 0 and level < most:
                continue
            out[x] = (c, 1.0 if not most or math.isinf(level) else min(level, most) / most)
    return out


@pytest.mark.parametrize("block", [1024, 40])
def test_hierarchical_clusters_against_plain(spark, block):
    """300 points a user, some at one position; with small blocks the trees of the tiles are joined in Boruvka rounds."""
    rng = random.Random(21)
    rows = []
    for u in range(3):
        for i in range(300):
            if u == 2:  # one cloud, many at one place
                x, y = (7.0, 7.0) if rng.random() < 0.15 else (rng.gauss(0, 30), rng.gauss(0, 30))
            else:
                x, y = rng.choice(((0, 0, 8), (150, 20, 15), (170, 90, 6), (60, 60, 200)))[:2] if rng.random() < 0.1 else (0, 0), 0
                cx, cy, r = rng.choice(((0, 0, 8), (150, 20, 15), (170, 90, 6), (60, 60, 200)))
                x, y = rng.gauss(cx, r), rng.gauss(cy, r)
            rows.append((u, i, i, round(x, 1 if u else 3), round(y, 1 if u else 3)))
    rows += [(9, i, i, float(i), 0.0) for i in range(10)]  # too few
    df = density.hierarchical(spark.createDataFrame(rows, POINT), block=block)
    got = {(r.user_id, r.point_id): (r.cluster, r.probability) for r in df.collect()}
    assert len(got) == len(rows) and all(got[9, i][0] == -1 for i in range(10))
    several = 0
    for u in range(3):
        own = [r for r in rows if r[0] == u]
        want = plain_clusters([r[3:] for r in own], 15, 20)
        names = {}
        for r, (c, p) in zip(own, want):
            cluster, probability = got[u, r[1]]
            assert (cluster < 0) == (c < 0) and probability == pytest.approx(p, abs=1e-9), (u, r)
            if c >= 0:
                assert names.setdefault(c, cluster) == cluster
        assert len(set(names.values())) == len(names)
        several += len(names) > 1
    assert several


def test_core_distances_of_few_points(spark):
    spots = density.positions(spark.createDataFrame([(1, i, i, float(x), 0.0) for i, x in enumerate((0, 1, 3, 3))], POINT))
    assert {r.easting: r.core for r in density.core_distances(spots, 2).collect()} == {0.0: 3.0, 1.0: 2.0, 3.0: 2.0}
    assert {r.easting: r.core for r in density.core_distances(spots, 20).collect()} == {0.0: 3.0, 1.0: 2.0, 3.0: 3.0}


def test_relabel_in_time_against_the_counter(spark):
    rng = random.Random(6)
    rows = [(u, i, i, rng.choice((-1, -1, 0, 0, 1) if u % 2 else (-1, 0, 0))) for u in range(60) for i in range(60)]
    got = {(r.user_id, r.point_id): r.stop for r in density.relabel_in_time(spark.createDataFrame(rows, "user_id long, point_id long, t long, cluster int")).collect()}
    fired = 0
    for u in range(60):
        own = [r[3] for r in rows if r[0] == u]
        last = next((x for x in own if x != -1), None)
        new = streak = 0
        for i, x in enumerate(own):
            if x == -1:
                streak += 1
                assert got[u, i] == -1
                continue
            if x != last:
                last, new = x, new + 1
            elif streak == 4:
                streak, new, fired = 0, new + 1, fired + 1
            assert got[u, i] == new
    assert fired > 30


def test_stops_lose_the_last_and_short_ones(spark):
    rows = [(1, i, t, s) for i, (t, s) in enumerate(((0, 0), (50, 0), (60, -1), (100, 1), (300, 1), (400, 2), (900, 2)))]
    df = spark.createDataFrame(rows, "user_id long, point_id long, t long, stop int")
    assert {r.stop for r in density.stop_points(df, 60).collect()} == {1}
    assert {r.stop for r in density.stop_points(df, 60, compat=False).collect()} == {1, 2}


def test_weighted_centres(spark):
    """Nearest neighbours over several rings; a cluster at one place weighs all alike."""
    rng = random.Random(2)
    rows = [(1, s, round(rng.gauss(0, 10**s), 2), round(rng.gauss(0, 10**s), 2)) for s in range(4) for _ in range(25)]
    rows += [rows[3]] * 2 + [(1, 7, 5.0, 6.0)] * 3
    got = {r.stop: r for r in density.weighted_centres(spark.createDataFrame(rows, "user_id long, stop long, easting double, northing double")).collect()}
    for s, r in got.items():
        own = [x[2:] for x in rows if x[1] == s]
        w = [1 / min((d for b in own if (d := math.dist(a, b)) > 0), default=1e16) for a in own]
        assert r.n_points == len(own) and r.easting == pytest.approx(sum(a[0] * x for a, x in zip(own, w)) / sum(w))


def test_components_of_chains_and_stars(spark):
    links = [(u, i, i + 1) for u in range(3) for i in range(40) if i % 10 != 9] + [(3, 5, i) for i in range(6, 60)]
    got = {(r.user_id, r.node): r.root for r in density.components(spark.createDataFrame(links, "user_id long, a long, b long")).collect()}
    assert all(root == (node // 10 * 10 if u < 3 else 5) for (u, node), root in got.items()) and len(got) == 3 * 40 + 55


def test_attribute_stops_by_hand(spark):
    """Limits of 60 s, 120 s and ratio 1; the first point has no label, the last is a stop."""
    from tripweave.operators.logger import attribute_stops

    def labels(*rows):
        df = spark.createDataFrame([(1, i, i, v, d, h) for i, (v, d, h) in enumerate((float(a), b, float(c)) for a, b, c in rows)], "user_id long, point_id long, t long, speed_ms double, duration_s long, delta_heading double")
        return [r.label for r in attribute_stops(df).orderBy("t").collect()]

    assert labels((9, 1, 0), (0.1, 1, 0), (5.0, 59, 0), (0.15, 1, 0), (5.0, 60, 0), (0.1, 1, 0)) == [None, "stop", "stop", "stop", "trip", "stop"]
    assert labels((9, 1, 0), (5.0, 1, 0), (0.1, 119, 0), (5.0, 1, 0), (5.0, 1, 0)) == [None, "trip", "trip", "trip", "stop"]
    assert labels((9, 1, 0), (5.0, 1, 0), (0.1, 120, 0), (5.0, 1, 0), (5.0, 1, 0)) == [None, "trip", "stop", "trip", "stop"]
    assert labels((9, 1, 0), (2.0, 1, 0), (4.0, 1, 0), (0.1, 1, 0), (1.0, 1, 0)) == [None, "trip", "trip", "trip", "stop"]
    assert labels((9, 1, 0), (2.0, 1, 0), (4.01, 1, 0), (1.0, 1, 91), (1.0, 1, 0)) == [None, "trip", "stop", "trip", "stop"]
    assert labels((9, 1, 0)) == ["stop"]


def test_dbscan_of_small_users_needs_no_rounds(spark, monkeypatch):
    """Users of few positions have the clusters that cells give, and no rounds of components; borders and repeated positions included."""
    from tripweave.operators import cluster

    rng = random.Random(5)
    rows = [(u, i, i, float(rng.randrange(0, 300, 5)), float(rng.randrange(0, 300, 5))) for u in range(4) for i in range(30 + 40 * u)] + [(9, 1, 1, 0.0, 0.0), (9, 2, 2, None, 1.0)]
    df = spark.createDataFrame(rows, POINT)
    found = lambda **more: sorted((r.user_id, r.point_id, r.cluster) for eps, k in ((30.0, 4), (25.0, 1)) for r in cluster.dbscan(df, eps, k, **more).collect())
    want = found(most=0)
    assert any(c < 0 for *_, c in want) and any(c > 1 for *_, c in want)
    monkeypatch.setattr(cluster, "components", None)
    assert found() == want


def test_nearest_other_of_few_spots_needs_no_rings(spark):
    rng = random.Random(7)
    spots = spark.createDataFrame([(1, s, round(rng.gauss(0, 50), 2), round(rng.gauss(0, 50), 2), 1) for s in range(5) for _ in range(20 * s + 1)], "user_id long, stop long, easting double, northing double, m long")
    found = lambda **more: density.nearest_other(spots, ["user_id", "stop"], **more)
    rows = lambda df: sorted((r.stop, r.easting, r.northing, r.m, -1 if r.nearest is None else round(r.nearest, 9)) for r in df.collect())
    assert rows(found()) == rows(found(few=1)) == rows(found(few=1000))
    assert "Join" not in found(few=1000)._jdf.queryExecution().optimizedPlan().toString()


def test_core_distances_in_one_matrix_and_in_tiles(spark):
    """Users of one block need no lists of neighbours; repeated positions count."""
    rng = random.Random(9)
    points = spark.createDataFrame([(u, i, i, float(rng.randrange(60)), float(rng.randrange(9))) for u in range(2) for i in range(15 + 200 * u)], POINT)
    cores = [sorted((r.user_id, r.easting, r.northing, r.core) for r in density.core_distances(density.positions(points, b), 20).collect()) for b in (1024, 30)]
    assert cores[0] == cores[1]


def test_clusters_of_small_users_in_one_row_each(spark, monkeypatch):
    """Users of one block go through distances, tree and hierarchy at once, beside larger ones, with no tables between; repeated positions, users of few points and of one."""
    rng = random.Random(3)
    spot = lambda: (float(rng.randrange(40)), float(rng.randrange(40)))
    rows = [(u, i, i, *spot()) for u, many in enumerate((1, 2, 10, 11, 60, 200)) for i in range(many)] + [(8, i, i, 5.0, 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, POINT)
    found = lambda block: sorted((r.user_id, r.point_id, r.cluster, r.probability) for r in density.hierarchical(df, 5, 3, block=block).collect())
    want = found(50)
    assert len(want) == len(rows) and len({(u, c) for u, _, c, _ in want if c >= 0}) > 3
    names, cut = [], density.cut
    monkeypatch.setattr(density, "cut", lambda df, name: names.append(name) or cut(df, name))
    assert found(1024) == want
    assert names == ["density-positions"]
