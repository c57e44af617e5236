"""SQL that DuckDB runs on the same tables, for the queries that SQL can express."""

from __future__ import annotations

from ..functions import geo

WIDE, TIGHT = 10000.0, 100000.0
DAY_GAP = 6 * 3600
ZONE = "America/Montreal"


def _spot(key: str, a: int, b: int, scale: float) -> str:
    at = lambda k: f"({key} * {k} % 1000) / {geo.lit(scale)}"
    return f"{geo.lit(45.45)} + {at(a)} AS lat, {geo.lit(-73.65)} + {at(b)} AS lon"


_UTM = f"round({geo.easting('lat', 'lon')}, 3) AS easting, round({geo.northing('lat', 'lon')}, 3) AS northing"


def _pts(scale: float = TIGHT, clock: int = 100) -> str:
    return f"""p0 AS (SELECT user_id, event_id AS point_id, epoch_us(ts) // {clock * 1000000} AS t, value / 5.0 AS h_accuracy, value, {_spot("event_id", 37, 91, scale)} FROM events),
pts AS (SELECT *, {_UTM} FROM p0)"""


def _good(scale: float = TIGHT, clock: int = 100) -> str:
    return _pts(scale, clock) + ", good AS (SELECT * FROM pts WHERE h_accuracy <= 50)"


_W = "OVER (PARTITION BY user_id ORDER BY t, point_id)"


def _seg(scale: float = TIGHT, clock: int = 100, gap: int = 300) -> str:
    return (
        _good(scale, clock)
        + f""", l AS (SELECT *, lag(t) {_W} AS lt, lag(easting) {_W} AS le, lag(northing) {_W} AS ln FROM good),
k AS (SELECT *, coalesce(t - lt, 0) AS period_before, coalesce(round({geo.planar("le", "ln", "easting", "northing")}, 3), 0) AS distance_before FROM l),
seg AS (SELECT *, sum(CASE WHEN period_before > {gap} THEN 1 ELSE 0 END) {_W} AS segment_group FROM k)"""
    )


def _trips(scale: float = TIGHT, clock: int = 100, gap: int = 300) -> str:
    first = lambda c, f="min": f"arg_{f}({c}, ROW(t, point_id))"
    cols = ", ".join(f"{first(c, f)} AS {n}_{c}" for n, f in (("f", "min"), ("z", "max")) for c in ("t", "point_id", "lat", "lon", "easting", "northing", "distance_before"))
    return (
        _seg(scale, clock, gap)
        + f""", tr0 AS (SELECT user_id, segment_group, count(*) AS n_points, {cols}, sum(distance_before) AS ds, {first("distance_before")} AS lead FROM seg GROUP BY 1, 2),
tr AS (SELECT *, round({geo.planar("f_easting", "f_northing", "z_easting", "z_northing")}, 3) AS direct_distance, round(ds - lead, 3) AS cumulative_distance FROM tr0)"""
    )


_T = "OVER (PARTITION BY user_id ORDER BY segment_group)"


def _gaps(scale: float = TIGHT) -> str:
    return (
        _trips(scale)
        + f""", g0 AS (SELECT *, lag(z_t) {_T} AS pt, lag(z_easting) {_T} AS pe, lag(z_northing) {_T} AS pn FROM tr),
gp AS (SELECT *, f_t - pt AS gap_s, round({geo.planar("pe", "pn", "f_easting", "f_northing")}, 3) AS gap_m FROM g0)"""
    )


def _entrances(scale: float = TIGHT) -> str:
    return f"e0 AS (SELECT s_suppkey AS place_id, {_spot('s_suppkey', 53, 17, scale)} FROM supplier), ent AS (SELECT place_id, {_UTM} FROM e0)"


def _at(x: str, y: str, radius: float = 200.0) -> str:
    return f"(SELECT min(place_id) FROM ent WHERE {geo.planar(x, y, 'ent.easting', 'ent.northing')} <= {radius})"


def _subway(differ: bool) -> str:
    other = " AND pz <> fp" if differ else ""
    return (
        _gaps()
        + ", "
        + _entrances()
        + f""", pl AS (SELECT *, {_at("f_easting", "f_northing")} AS fp, {_at("z_easting", "z_northing")} AS zp FROM gp),
p2 AS (SELECT *, lag(zp) {_T} AS pz FROM pl),
cn AS (SELECT user_id, segment_group, coalesce(pz IS NOT NULL AND fp IS NOT NULL AND gap_s < 4800 AND gap_m / nullif(gap_s, 0) > 0.1{other}, false) AS condition FROM p2)"""
    )


def _paired(cn: str) -> str:
    """link_i = condition_i and not link_(i-1), walked trip by trip."""
    return f"""WITH RECURSIVE {cn}, o AS (SELECT *, row_number() {_T} AS i FROM cn),
walk AS (SELECT user_id, i, segment_group, condition, condition AS link FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.segment_group, o.condition, o.condition AND NOT walk.link FROM walk JOIN o ON o.user_id = walk.user_id AND o.i = walk.i + 1)
SELECT user_id, segment_group, condition, link FROM walk"""


def _walked(cn: str, out: str) -> str:
    """`out`: link of each row of `cn`, trip by trip, for use under WITH RECURSIVE."""
    return f"""o_{out} AS (SELECT *, row_number() {_T} AS i FROM {cn}),
{out} AS (SELECT user_id, i, segment_group, condition AS link FROM o_{out} WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.segment_group, o.condition AND NOT w.link FROM {out} w JOIN o_{out} o ON o.user_id = w.user_id AND o.i = w.i + 1)"""


#: Segments linked by subway, then by speed: keys (user_id, segment_group, trip_key, labels), their points and summaries tr2.
_LINKED = (
    _subway(False)
    + ", "
    + _walked("cn", "w1")
    + f""", k1 AS (SELECT user_id, segment_group, link, sum((NOT link)::INT) {_T} - 1 AS key1 FROM w1),
m1 AS (SELECT user_id, key1 AS segment_group, bool_or(link) AS sub, arg_min(f_t, segment_group) AS f_t, arg_min(f_easting, segment_group) AS f_easting, arg_min(f_northing, segment_group) AS f_northing,
  arg_max(z_t, segment_group) AS z_t, arg_max(z_easting, segment_group) AS z_easting, arg_max(z_northing, segment_group) AS z_northing FROM k1 JOIN tr USING (user_id, segment_group) GROUP BY 1, 2),
h1 AS (SELECT *, lag(z_t) {_T} AS pt, lag(z_easting) {_T} AS pe, lag(z_northing) {_T} AS pn FROM m1),
cn2 AS (SELECT user_id, segment_group, coalesce(round({geo.planar("pe", "pn", "f_easting", "f_northing")}, 3) / nullif(f_t - pt, 0) * 3.6 >= 2.0, false) AS condition FROM h1),
"""
    + _walked("cn2", "w2")
    + f""", k2 AS (SELECT user_id, segment_group AS key1, link, sum((NOT link)::INT) {_T} - 1 AS trip_key FROM w2),
lb AS (SELECT k2.user_id, trip_key, bool_or(sub) AS sub, bool_or(link) AS walk FROM k2 JOIN m1 ON m1.user_id = k2.user_id AND m1.segment_group = key1 GROUP BY 1, 2),
keys AS (SELECT k1.user_id, k1.segment_group, trip_key, sub, walk FROM k1 JOIN k2 USING (user_id, key1) JOIN lb USING (user_id, trip_key)),
lseg AS (SELECT seg.*, trip_key FROM seg JOIN keys USING (user_id, segment_group)),
tq0 AS (SELECT user_id, trip_key AS segment_group, count(*) AS n_points, sum(distance_before) AS ds, arg_min(distance_before, ROW(t, point_id)) AS lead, """
    + ", ".join(f"arg_{f}({c}, ROW(t, point_id)) AS {n}_{c}" for n, f in (("f", "min"), ("z", "max")) for c in ("t", "lat", "lon", "easting", "northing", "distance_before", "period_before", "h_accuracy"))
    + """ FROM lseg GROUP BY 1, 2),
tr2 AS (SELECT *, round(ds - lead, 3) AS cumulative_distance FROM tq0)"""
)


def _speed(test: str) -> str:
    return _gaps() + f", cn AS (SELECT user_id, segment_group, coalesce(gap_m / nullif(gap_s, 0) * 3.6 {test}, false) AS condition FROM gp)"


def _missing(trips: str, name: str) -> str:
    """The gaps `miss` between the trips `name` that `trips` defines, the base walked trip by trip; for use under WITH RECURSIVE."""
    return (
        trips
        + f""", wi AS (SELECT *, row_number() {_T} AS i FROM {name}),
wb AS (SELECT user_id, i, segment_group AS base FROM wi WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, CASE WHEN b.z_easting = n.f_easting AND b.z_northing = n.f_northing THEN w.base ELSE n.segment_group END
  FROM wb w JOIN wi n ON n.user_id = w.user_id AND n.i = w.i + 1 JOIN {name} b ON b.user_id = w.user_id AND b.segment_group = w.base),
b1 AS (SELECT wi.*, lag(base) OVER (PARTITION BY user_id ORDER BY i) AS bs, max(segment_group) OVER (PARTITION BY user_id) AS latest,
  lead(segment_group) OVER (PARTITION BY user_id ORDER BY i) AS next_group FROM wi JOIN wb USING (user_id, i)),
b2 AS (SELECT a.*, b.z_t AS pt, b.z_easting AS pe, b.z_northing AS pn, b.z_lat AS p_lat, b.z_lon AS p_lon,
  b.z_distance_before AS p_distance, a.f_t - b.z_t AS gap_s, round({geo.planar("b.z_easting", "b.z_northing", "a.f_easting", "a.f_northing")}, 3) AS gap_m FROM b1 a JOIN {name} b ON a.user_id = b.user_id AND a.bs = b.segment_group),
b3 AS (SELECT *, {_at("pe", "pn")} AS pp, {_at("f_easting", "f_northing")} AS fp FROM b2),
miss AS (SELECT *, CASE WHEN gap_m = 0 THEN NULL WHEN gap_m < 250 THEN 'too_short' WHEN n_points = 1 AND segment_group < latest THEN 'known_location'
  WHEN pp <> fp THEN 'subway' WHEN gap_m <= 750 THEN 'cold_start' ELSE 'general' END AS kind FROM b3)"""
    )


_GAP_CODE = "CASE kind WHEN 'general' THEN 101 WHEN 'subway' THEN 102 ELSE 104 END"

_MISSING = (
    _missing(_trips() + ", " + _entrances(), "tr")
    + """, coded AS (SELECT tr.*, CASE WHEN tr.cumulative_distance < 250 THEN 202 WHEN kind = 'too_short' AND tr.n_points = 1 THEN 201 WHEN kind = 'too_short' THEN 1
  WHEN tr.n_points > 1 THEN 1 ELSE -1 END AS trip_code FROM tr LEFT JOIN miss USING (user_id, segment_group))"""
)

_SURVEY = f"""s0 AS (SELECT c_custkey AS user_id, unnest([0, 1, 2]) AS place_order, unnest(['home', 'work', 'study']) AS label, unnest([37, 59, 71]) AS a, unnest([91, 13, 29]) AS b FROM customer),
places AS (SELECT user_id, place_order, label, {geo.lit(45.45)} + (user_id * a % 1000) / {geo.lit(TIGHT)} AS lat, {geo.lit(-73.65)} + (user_id * b % 1000) / {geo.lit(TIGHT)} AS lon
  FROM s0 WHERE NOT (label = 'study' AND user_id % 4 = 0))"""


def _label(pick: str, points: str, radius: float) -> str:
    return f"""lab AS (SELECT p.user_id, p.point_id, {pick}(q.label, q.place_order) AS label FROM {points} p JOIN places q ON p.user_id = q.user_id
  AND {geo.haversine("q.lat", "q.lon", "p.lat", "p.lon")} <= {radius} GROUP BY 1, 2)"""


_DAYS = (
    _trips(clock=1, gap=DAY_GAP)
    + f""", sec AS (SELECT user_id, segment_group, point_id, lat, lon, row_number() OVER (PARTITION BY user_id, segment_group ORDER BY t, point_id) AS i FROM seg),
dt AS (SELECT tr.user_id, tr.segment_group + 1 AS trip_num, CASE WHEN tr.segment_group % 5 = 3 THEN 101 ELSE 1 END AS trip_code, f_t, z_t, z_lat, z_lon, sec.lat AS s_lat, sec.lon AS s_lon,
  make_timestamp(CAST(f_t AS BIGINT) * 1000000)::DATE AS date, make_timestamp(CAST(z_t AS BIGINT) * 1000000)::DATE AS hi FROM tr LEFT JOIN sec ON sec.user_id = tr.user_id AND sec.segment_group = tr.segment_group AND i = 2),
dd AS (SELECT user_id, date, bool_or(trip_code BETWEEN 100 AND 199) AS miss, count(*) AS n_trips, arg_max(z_lat, trip_num) AS e_lat, arg_max(z_lon, trip_num) AS e_lon,
  arg_min(s_lat, trip_num) FILTER (s_lat IS NOT NULL) AS s_lat, arg_min(s_lon, trip_num) FILTER (s_lon IS NOT NULL) AS s_lon FROM dt GROUP BY 1, 2),
sp AS (SELECT user_id, min(date) AS lo, max(hi) AS hi FROM dt GROUP BY 1),
cal AS (SELECT user_id, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
days AS (SELECT cal.user_id, cal.date, n_trips IS NOT NULL AS has_trips, coalesce(NOT miss, false) AS is_complete, n_trips, e_lat, e_lon, s_lat, s_lon FROM cal LEFT JOIN dd USING (user_id, date)),
r0 AS (SELECT *, sum(has_trips::INT) OVER (PARTITION BY user_id ORDER BY date) AS run FROM days),
r1 AS (SELECT *, CASE WHEN NOT has_trips THEN row_number() OVER q END AS consecutive_inactive_days, CASE WHEN NOT has_trips THEN min(date) OVER q END AS first_inactive_day FROM r0
  WINDOW q AS (PARTITION BY user_id, run, has_trips ORDER BY date)),
ina AS (SELECT *, CASE WHEN NOT has_trips THEN max(consecutive_inactive_days) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS inactive_day_streak,
  max(consecutive_inactive_days) OVER (PARTITION BY user_id) AS inactivity_streak FROM r1),
ex AS (SELECT i.*, coalesce(a.is_complete AND b.is_complete AND {geo.haversine("a.e_lat", "a.e_lon", "b.s_lat", "b.s_lon")} < 750, false) AS explained FROM ina i
  LEFT JOIN days a ON a.user_id = i.user_id AND a.date = i.first_inactive_day - 1 AND i.inactive_day_streak <= 2
  LEFT JOIN days b ON b.user_id = i.user_id AND b.date = i.first_inactive_day + CAST(i.inactive_day_streak AS INT) AND i.inactive_day_streak <= 2)"""
)


def _local(sec: str) -> str:
    return f"timezone('{ZONE}', timezone('UTC', make_timestamp(CAST({sec} AS BIGINT) * 1000000)))"


_SPANS = (
    _seg(clock=1, gap=DAY_GAP)
    + ", "
    + _SURVEY
    + ", "
    + _label("arg_max", "seg", 400.0)
    + """, lp AS (SELECT seg.*, lab.label, row_number() OVER (PARTITION BY seg.user_id, segment_group ORDER BY t, seg.point_id) AS a,
  row_number() OVER (PARTITION BY seg.user_id, segment_group ORDER BY t DESC, seg.point_id DESC) AS z FROM seg LEFT JOIN lab ON lab.user_id = seg.user_id AND lab.point_id = seg.point_id),
tp AS (SELECT user_id, segment_group AS trip_key, min(t) AS s, max(t) AS e, any_value(label) FILTER (a = 1) AS o, any_value(label) FILTER (z = 1) AS d,
  arg_min(label, ROW(t, point_id)) FILTER (label IS NOT NULL AND a <= 5) AS head, arg_min(label, ROW(t, point_id)) FILTER (label IS NOT NULL AND z <= 5) AS tail FROM lp GROUP BY 1, 2),
tq AS (SELECT *, lag(tail) OVER w AS pt, lag(e) OVER w AS pe FROM tp WINDOW w AS (PARTITION BY user_id ORDER BY trip_key)),
spans AS (SELECT user_id, trip_key, 'commute' AS kind, CASE WHEN (o = 'home' AND d = 'work') OR (o = 'work' AND d = 'home') THEN 'work'
    WHEN (o = 'home' AND d = 'study') OR (o = 'study' AND d = 'home') THEN 'study' END AS label, s AS start, e AS "end" FROM tq
  UNION ALL SELECT user_id, trip_key, 'dwell', CASE WHEN pt = head THEN head END, pe, s FROM tq WHERE pe IS NOT NULL),
dyn AS (SELECT user_id, trip_key, CASE WHEN o IS NULL OR d IS NULL THEN 'uncategorized' ELSE least(o, d) || '-' || greatest(o, d) END AS label, s AS start, e AS "end" FROM tq)"""
)


def _pieces(source: str) -> str:
    return f"""lo AS (SELECT *, {_local("start")} AS ls, {_local('"end"')} AS le FROM {source}),
pc AS (SELECT *, ls::DATE AS date, epoch(le) - epoch(ls) AS seconds FROM lo WHERE day(ls) = day(le)
  UNION ALL SELECT *, ls::DATE, epoch(date_trunc('day', le)) - epoch(ls) FROM lo WHERE day(ls) <> day(le)
  UNION ALL SELECT *, le::DATE, epoch(le) - epoch(date_trunc('day', le)) FROM lo WHERE day(ls) <> day(le))"""


def _sums(of: str, total: str, none: str) -> str:
    cols = [f"{none.format(f'sum(CASE WHEN kind = ' + repr(k) + ' AND label = ' + repr(x) + f' THEN {total} END)')} AS {of.format(k='commute' if k == 'commute' else 'dwell', x=x)}" for k, xs in (("commute", ("work", "study")), ("dwell", ("home", "work", "study"))) for x in xs]
    return ", ".join(cols)


def _kin(points: str) -> str:
    return f"""k0 AS (SELECT *, lag(t) {_W} AS lt, lag(lat) {_W} AS la, lag(lon) {_W} AS lo FROM {points}),
k1 AS (SELECT *, coalesce(t - lt, 0) AS duration_s, coalesce({geo.haversine("la", "lo", "lat", "lon")}, 0) AS distance_m, coalesce({geo.bearing("la", "lo", "lat", "lon")}, 0) AS bearing FROM k0),
k2 AS (SELECT *, lag(bearing) {_W} AS pb FROM k1)"""


def _walk(points: str, keep: str) -> str:
    """Walks each user's points with the last kept one as state; `keep` tests point n against state w."""
    return f"""o AS (SELECT *, row_number() {_W} AS i, lead(easting) {_W} AS xe, lead(northing) {_W} AS xn FROM {points}),
walk AS (SELECT user_id, i, point_id, true AS kept, t AS wt, easting AS we, northing AS wn, lat AS wla, lon AS wlo, NULL::BIGINT AS pt, NULL::DOUBLE AS pla, NULL::DOUBLE AS plo FROM o WHERE i = 1
  UNION ALL SELECT user_id, i, point_id, ok, CASE WHEN ok THEN t ELSE wt END, CASE WHEN ok THEN easting ELSE we END, CASE WHEN ok THEN northing ELSE wn END,
    CASE WHEN ok THEN lat ELSE wla END, CASE WHEN ok THEN lon ELSE wlo END, wt, wla, wlo
  FROM (SELECT n.*, w.wt, w.we, w.wn, w.wla, w.wlo, {keep} AS ok FROM walk w JOIN o n ON n.user_id = w.user_id AND n.i = w.i + 1))"""


_SPIKE = f"NOT (n.xe IS NOT NULL AND {geo.planar('w.we', 'w.wn', 'n.easting', 'n.northing')} <> 0 AND n.t <> w.wt AND {geo.planar('w.we', 'w.wn', 'n.easting', 'n.northing')} / nullif(n.t - w.wt, 0) >= {100 / 3.6!r} AND {geo.planar('w.we', 'w.wn', 'n.xe', 'n.xn')} < {geo.planar('w.we', 'w.wn', 'n.easting', 'n.northing')})"
_STEP = f"n.t <> w.wt AND {geo.haversine('w.wla', 'w.wlo', 'n.lat', 'n.lon')} >= 0.1"

def _fates(trips: str) -> str:
    """`fates` of the lone points among `trips` (i, fate, set_t), tested one after the other; for use under WITH RECURSIVE with `places` defined."""
    fate = """CASE WHEN n_points <> 1 OR j THEN NULL WHEN bt IS NOT NULL AND (np OR f_t - bt <= 1200) AND (NOT nx OR f_t - bt <= nt - f_t) THEN 'previous'
    WHEN nx THEN 'next' WHEN known THEN 'keep' ELSE 'drop' END"""
    out = "SELECT user_id, segment_group, i, fate, CASE WHEN fate = 'previous' THEN bt WHEN fate = 'next' THEN nt WHEN fate IS NOT NULL THEN f_t END AS set_t, CASE WHEN fate = 'previous' THEN bt WHEN fate = 'next' THEN nt WHEN fate IS NULL THEN z_t ELSE f_t END AS bt, coalesce(fate = 'next', false) AS j"
    return f"""pu AS (SELECT user_id AS u, round({geo.easting("lat", "lon")}, 3) AS qe, round({geo.northing("lat", "lon")}, 3) AS qn FROM places),
t0 AS (SELECT *, row_number() {_T} AS i, lead(f_t) {_T} AS nt, lag(z_easting) {_T} AS ae, lag(z_northing) {_T} AS an, lead(f_easting) {_T} AS ne, lead(f_northing) {_T} AS nn FROM {trips}),
t1 AS (SELECT user_id, segment_group, i, n_points, f_t, z_t, nt, coalesce({geo.planar("ae", "an", "f_easting", "f_northing")} <= 150, false) AS np,
  coalesce({geo.planar("f_easting", "f_northing", "ne", "nn")} <= 150, false) OR coalesce(nt - f_t <= 1200, false) AS nx,
  EXISTS (SELECT 1 FROM pu WHERE u = user_id AND {geo.planar("qe", "qn", "f_easting", "f_northing")} <= 150) AS known FROM t0),
tf AS ({out} FROM (SELECT *, {fate} AS fate FROM (SELECT *, NULL::BIGINT AS bt, false AS j FROM t1 WHERE i = 1))
  UNION ALL {out} FROM (SELECT *, {fate} AS fate FROM (SELECT t1.*, tf.bt, tf.j FROM tf JOIN t1 ON t1.user_id = tf.user_id AND t1.i = tf.i + 1))),
al AS (SELECT *, last_value(CASE WHEN fate IS NULL OR fate = 'keep' THEN segment_group END IGNORE NULLS) {_T} AS la, lead(segment_group) {_T} AS later FROM tf),
fates AS (SELECT user_id, segment_group, CASE WHEN fate = 'previous' AND la IS NULL THEN 'drop' ELSE fate END AS fate, set_t, CASE WHEN fate = 'next' THEN later WHEN fate = 'drop' THEN NULL ELSE la END AS host FROM al)"""


_HOSTED = ", ".join(
    f"arg_{f}({f'coalesce(set_t, {n}_t)' if c == 't' else f'{n}_{c}'}, segment_group) AS {n}_{c}"
    for n, f in (("f", "min"), ("z", "max")) for c in ("t", "lat", "lon", "easting", "northing", "distance_before", "period_before", "h_accuracy")
)

#: The phone diary: spikes dropped, segments linked, lone points attached, gaps inferred, all coded and numbered.
_DIARY = (
    _missing(
        _LINKED.replace(", good AS (SELECT * FROM pts WHERE h_accuracy <= 50)", f", g00 AS (SELECT * FROM pts WHERE h_accuracy <= 50 AND user_id IN (SELECT user_id FROM pts GROUP BY 1 HAVING count(*) >= 2)), {_walk('g00', _SPIKE)}, good AS (SELECT g00.* FROM g00 JOIN walk USING (user_id, point_id) WHERE kept)")
        + f""", {_SURVEY}, {_fates("tr2")},
tr3 AS (SELECT user_id, host AS segment_group, sum(n_points) AS n_points, sum(ds) AS ds, {_HOSTED} FROM tr2 JOIN fates USING (user_id, segment_group) WHERE host IS NOT NULL GROUP BY 1, 2)""",
        "tr3",
    )
    + f""", lk AS (SELECT DISTINCT user_id, trip_key AS segment_group, sub, walk FROM keys),
co AS (SELECT tr3.*, kind, sub, walk, m.pt, p_lat, p_lon, p_distance, b.z_period_before AS p_period, b.z_h_accuracy AS p_accuracy, coalesce(kind IN ('cold_start', 'too_short'), false) AS copied
  FROM tr3 JOIN lk USING (user_id, segment_group) LEFT JOIN miss m USING (user_id, segment_group) LEFT JOIN tr3 b ON b.user_id = m.user_id AND b.segment_group = m.bs),
cd AS (SELECT *, concat_ws(', ', CASE WHEN sub THEN 'subway' END, CASE WHEN walk THEN 'walking' END, CASE WHEN kind = 'too_short' THEN 'too short' END) AS merge_codes,
  CASE WHEN round(CASE WHEN copied THEN ds ELSE ds - f_distance_before END, 3) < 250 THEN 202 WHEN kind = 'too_short' AND sub THEN 2 WHEN kind = 'too_short' THEN 1
  WHEN sub THEN 2 WHEN NOT walk AND n_points + copied::INT > 1 THEN 1 ELSE -1 END AS trip_code FROM co),
own AS (SELECT l.user_id, host AS trip_key, l.point_id, coalesce(set_t, l.t) AS t, l.t AS o, lat, lon, h_accuracy, distance_before, period_before FROM lseg l
  JOIN fates ON fates.user_id = l.user_id AND fates.segment_group = l.trip_key WHERE host IS NOT NULL),
ev AS (SELECT l.user_id, l.trip_key, 2 AS after, trip_code, merge_codes, 1 AS place, o, point_id, t, lat, lon, h_accuracy, distance_before, period_before FROM own l JOIN cd ON cd.user_id = l.user_id AND cd.segment_group = l.trip_key
  UNION ALL SELECT user_id, segment_group, 2, trip_code, merge_codes, 0, NULL, NULL, f_t, p_lat, p_lon, p_accuracy, p_distance, CASE WHEN kind = 'cold_start' THEN f_period_before ELSE p_period END FROM cd WHERE copied
  UNION ALL SELECT user_id, segment_group, 1, {_GAP_CODE}, NULL, 1, NULL, NULL, pt, p_lat, p_lon, -1.0, 0.0, 0 FROM miss WHERE kind IN ('general', 'subway', 'known_location')
  UNION ALL SELECT user_id, segment_group, 1, {_GAP_CODE}, NULL, 2, NULL, NULL, f_t, f_lat, f_lon, -1.0, gap_m, gap_s FROM miss WHERE kind IN ('general', 'subway', 'known_location')
  UNION ALL SELECT user_id, next_group, 0, 104, NULL, 1, NULL, NULL, f_t, f_lat, f_lon, -1.0, 0.0, 0 FROM miss WHERE kind = 'known_location'
  UNION ALL SELECT m.user_id, next_group, 0, 104, NULL, 2, NULL, NULL, n.f_t, n.f_lat, n.f_lon, -1.0, 0.0, 0 FROM miss m JOIN tr3 n ON n.user_id = m.user_id AND n.segment_group = m.next_group WHERE kind = 'known_location'),
dia AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY trip_key, after) AS trip_num, trip_code, merge_codes, row_number() OVER q AS seq, point_id, t, lat, lon, h_accuracy, period_before,
  round(sum(distance_before) OVER q, 3) AS trip_distance FROM ev WINDOW q AS (PARTITION BY user_id, trip_key, after ORDER BY place, o, point_id))"""
)


def _ellipsoid(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Ellipsoidal distance over short ways: the radii of curvature at the middle latitude (within a millimetre at 750 m)."""
    mid, e2 = f"radians(({lat1} + {lat2}) / 2)", "0.0066943799901413165"
    w = f"(1 - {e2} * pow(sin({mid}), 2))"
    return f"sqrt(pow(6378137.0 * (1 - {e2}) / pow({w}, 1.5) * radians({lat2} - {lat1}), 2) + pow(6378137.0 / sqrt({w}) * cos({mid}) * radians({lon2} - {lon1}), 2))"


def _condensed(spots: str, key: str, out: str, radius: float = 150.0) -> str:
    """`out` (user_id, place, easting, northing): centres of the components of spots, each spot walking to all that it reaches; for use under WITH RECURSIVE."""
    return f"""n_{out} AS (SELECT a.user_id, a.{key} AS p, b.{key} AS q FROM {spots} a JOIN {spots} b ON a.user_id = b.user_id AND {geo.planar("a.easting", "a.northing", "b.easting", "b.northing")} <= {radius}),
r_{out} AS (SELECT user_id, {key} AS root, {key} AS p FROM {spots} UNION SELECT r.user_id, r.root, n.q FROM r_{out} r JOIN n_{out} n ON n.user_id = r.user_id AND n.p = r.p),
c_{out} AS (SELECT user_id, p, min(root) AS c FROM r_{out} GROUP BY 1, 2),
{out} AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY c) AS place, easting, northing FROM (
  SELECT s.user_id, c, round(sum(round(easting * 1000)::BIGINT) / count(*)) / 1000 AS easting, round(sum(round(northing * 1000)::BIGINT) / count(*)) / 1000 AS northing FROM {spots} s JOIN c_{out} x ON x.user_id = s.user_id AND x.p = s.{key} GROUP BY 1, 2))"""


def _centres(points: str, key: str, out: str) -> str:
    return f"{out} AS (SELECT user_id, {key}, round(avg(easting), 3) AS easting, round(avg(northing), 3) AS northing FROM {points} GROUP BY 1, 2)"


_KMEANS = f"""v AS (SELECT user_id, point_id, t, least(coalesce(value, 0), 50) AS v FROM pts), c AS (SELECT DISTINCT user_id, v AS c FROM v),
m AS (SELECT v.user_id, c, count(*) AS n, sum(v) AS s, sum(v * v) AS q, count(*) FILTER (v <= c) AS n1, sum(v) FILTER (v <= c) AS s1, sum(v * v) FILTER (v <= c) AS q1 FROM v JOIN c USING (user_id) GROUP BY 1, 2),
e AS (SELECT user_id, c, round(q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1), 6) AS sse FROM m WHERE n1 < n),
b AS (SELECT user_id, arg_min(c, ROW(sse, c)) AS split FROM e GROUP BY 1),
k AS (SELECT v.*, CASE WHEN v > split THEN 'trip' ELSE 'stop' END AS kmeans FROM v LEFT JOIN b USING (user_id)),
r AS (SELECT *, CASE WHEN lag(kmeans) {_W} = kmeans THEN 0 ELSE 1 END AS new FROM k), g AS (SELECT *, sum(new) {_W} AS run FROM r)"""
_HEADING = f"""hv AS (SELECT * FROM pts WHERE value <> 0), hh AS (SELECT *, value >= stddev_pop(value) OVER (PARTITION BY user_id) + round_even((max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id)) / 2, 0) AS inn FROM hv),
hg AS (SELECT *, sum((NOT inn)::INT) {_W} AS run FROM hh), hz AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM hg),
hs AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY run) AS stop FROM hz WHERE inn AND run < last)"""

#: Clusters in time, the noise counter walked point by point; for use under WITH RECURSIVE.
_RELABEL = f"""lb AS (SELECT *, CASE WHEN point_id % 5 < 2 THEN -1 ELSE point_id * 13 % 97 // 60 END AS label, row_number() {_W} AS i FROM pts),
fl AS (SELECT user_id, arg_min(label, i) AS first_label FROM lb WHERE label <> -1 GROUP BY 1),
rw AS (SELECT user_id, point_id, i, CASE WHEN label = -1 THEN -1 ELSE 0 END AS stop, 0 AS new, CASE WHEN label = -1 THEN 1 ELSE 0 END AS streak, first_label AS last FROM lb JOIN fl USING (user_id) WHERE i = 1
  UNION ALL SELECT user_id, point_id, i, CASE WHEN label = -1 THEN -1 WHEN label <> last OR streak = 4 THEN new + 1 ELSE new END,
    CASE WHEN label <> -1 AND (label <> last OR streak = 4) THEN new + 1 ELSE new END,
    CASE WHEN label = -1 THEN streak + 1 WHEN label = last AND streak = 4 THEN 0 ELSE streak END, CASE WHEN label = -1 THEN last ELSE label END
  FROM (SELECT n.*, w.new, w.streak, w.last FROM rw w JOIN lb n ON n.user_id = w.user_id AND n.i = w.i + 1))"""

_ENDS = ("t", "lat", "lon", "easting", "northing", "point_id")
_MOST = lambda order: ", ".join(f"arg_{f}({n}_{c}, {order}) AS {n}_{c}" for n, f in (("f", "min"), ("z", "max")) for c in _ENDS)
#: The older diary: rows `ro` of trips; for use under WITH RECURSIVE.
_OLDER = (
    _gaps()
    + ", "
    + _entrances()
    + f""", o1 AS (SELECT *, {_at("f_easting", "f_northing")} AS fp, {_at("z_easting", "z_northing")} AS zp FROM gp),
o2 AS (SELECT *, lag(zp) {_T} AS pz FROM o1),
o3 AS (SELECT *, coalesce(pz <> fp AND gap_s < 4800 AND gap_m / nullif(gap_s, 0) > 0.1, false) AS cond FROM o2),
o4 AS (SELECT *, cond AND NOT coalesce(lag(cond) {_T}, false) AS ride FROM o3),
o5 AS (SELECT *, sum((NOT ride)::INT) {_T} AS num, NOT ride AND coalesce(gap_m / nullif(gap_s, 0) * 3.6 > 2.0, false) AS fast FROM o4),
o6 AS (SELECT *, last_value(CASE WHEN NOT ride AND NOT fast THEN num END IGNORE NULLS) {_T} AS key, coalesce(lead(cond) {_T}, false) AS cond_next, coalesce(lead(fast) {_T}, false) AS fast_next FROM o5),
ot AS (SELECT user_id, key AS segment_group, sum(n_points) AS n_points, {_MOST("segment_group")} FROM o6 GROUP BY 1, 2),
ol AS (SELECT *, row_number() {_T} AS i, lag(z_t) {_T} AS pt, lead(f_t) {_T} AS nt, lead(segment_group) {_T} AS nk, n_points = 1 AND coalesce(lag(segment_group) {_T} = segment_group - 1 AND lead(segment_group) {_T} = segment_group + 1, false) AS lone,
  lag(z_easting) {_T} AS pe, lag(z_northing) {_T} AS pn, lead(f_easting) {_T} AS ne, lead(f_northing) {_T} AS nn FROM ot),
ow AS (SELECT user_id, segment_group, i, false AS tested, false AS gives FROM ol WHERE i = 1
  UNION ALL SELECT n.user_id, n.segment_group, n.i, n.lone AND NOT w.gives, n.lone AND NOT w.gives AND {geo.planar("n.pe", "n.pn", "n.f_easting", "n.f_northing")} > {geo.planar("n.f_easting", "n.f_northing", "n.ne", "n.nn")}
  FROM ow w JOIN ol n ON n.user_id = w.user_id AND n.i = w.i + 1),
ofa AS (SELECT ol.*, tested, CASE WHEN gives THEN 'next' WHEN tested THEN 'previous' END AS fate, CASE WHEN gives THEN nt WHEN tested THEN pt END AS set_t,
  CASE WHEN gives THEN nk ELSE last_value(CASE WHEN NOT tested THEN segment_group END IGNORE NULLS) {_T} END AS host, segment_group - sum(tested::INT) {_T} AS rk FROM ol JOIN ow USING (user_id, segment_group, i)),
oh AS (SELECT user_id, host AS segment_group, sum(n_points) AS n_points, max(rk) FILTER (host = segment_group) AS rk, bool_or(fate = 'next') AS before, bool_or(fate = 'previous') AS behind,
  arg_min(f_point_id, i) FILTER (host = segment_group) AS own_first, arg_min(z_point_id, i) FILTER (host = segment_group) AS own_last, arg_min(coalesce(set_t, f_t), i) AS f_t, arg_max(coalesce(set_t, z_t), i) AS z_t,
  {", ".join(f"arg_{f}({n}_{c}, i) AS {n}_{c}" for n, f in (("f", "min"), ("z", "max")) for c in _ENDS if c != "t")} FROM ofa x GROUP BY user_id, host),
oz AS (SELECT *, {_at("f_easting", "f_northing", 300.0)} AS fp, {_at("z_easting", "z_northing", 300.0)} AS zp FROM oh),
og AS (SELECT *, lag(zp) {_T} AS pz, lag(z_t) {_T} AS pt, lag(z_lat) {_T} AS plat, lag(z_lon) {_T} AS plon, lag(z_easting) {_T} AS pe, lag(z_northing) {_T} AS pn FROM oz),
om AS (SELECT *, round({geo.planar("pe", "pn", "f_easting", "f_northing")}, 3) AS m, ((f_t - pt) % 86400 + 86400) % 86400 AS s FROM og),
on_ AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN m < 250 THEN 'missing trip - less than 250m' WHEN pz <> fp THEN 'missing trip - metro' WHEN m <= 750 THEN 'cold start' ELSE 'missing trip' END AS gn FROM om),
oq AS (SELECT *, rk + sum((coalesce(gn IN ('missing trip', 'missing trip - metro'), false))::INT) {_T} AS trip, CASE WHEN n_points = 1 AND gn IS DISTINCT FROM 'cold start' THEN 'single point'
  WHEN coalesce(CASE WHEN gn = 'cold start' THEN pz ELSE fp END <> zp, false) THEN 'complete trip - metro' ELSE 'complete trip' END AS note FROM on_),
pe_ AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment_group ORDER BY t, point_id) = 1 AS fi, row_number() OVER (PARTITION BY user_id, segment_group ORDER BY t DESC, point_id DESC) = 1 AS la FROM seg),
ro0 AS (SELECT q.user_id, q.trip, q.segment_group AS host, 1 AS place, p.t AS o, p.point_id, coalesce(set_t, p.t) AS t, p.lat, p.lon, p.easting, p.northing, p.period_before AS brk, q.note,
    list_filter([CASE WHEN fi AND cond OR la AND cond_next THEN 'metro' END, CASE WHEN fi AND fast OR la AND fast_next THEN 'velocity' END,
      CASE WHEN fate = 'next' OR (before AND fate IS NULL AND p.point_id = own_first) THEN 'single point - before' END,
      CASE WHEN fate = 'previous' OR (behind AND fate IS NULL AND p.point_id = own_last) THEN 'single point - after' END], lambda x: x IS NOT NULL) AS codes
  FROM pe_ p JOIN o6 ON o6.user_id = p.user_id AND o6.segment_group = p.segment_group JOIN ofa ON ofa.user_id = p.user_id AND ofa.segment_group = o6.key JOIN oq q ON q.user_id = p.user_id AND q.segment_group = ofa.host),
fc AS (SELECT user_id, host, arg_min(codes, ROW(o, point_id)) AS codes FROM ro0 GROUP BY 1, 2),
ro1 AS (SELECT user_id, trip, place, o, point_id, t, lat, lon, easting, northing, brk, note, codes FROM ro0
  UNION ALL SELECT user_id, trip, 0, NULL, NULL, f_t, plat, plon, pe, pn, s, CASE WHEN gn = 'cold start' THEN note ELSE gn END, [gn] FROM oq WHERE gn IN ('cold start', 'missing trip - less than 250m')
  UNION ALL SELECT user_id, trip - 1, 0, NULL, NULL, pt, plat, plon, pe, pn, s, gn, [gn] FROM oq WHERE gn IN ('missing trip', 'missing trip - metro')
  UNION ALL SELECT oq.user_id, trip - 1, 2, NULL, NULL, f_t, f_lat, f_lon, f_easting, f_northing, s, gn, codes FROM oq JOIN fc ON fc.user_id = oq.user_id AND fc.host = oq.segment_group WHERE gn IN ('missing trip', 'missing trip - metro')),
ro AS (SELECT *, row_number() OVER (PARTITION BY user_id, trip ORDER BY place, o, point_id) AS i, count(*) OVER (PARTITION BY user_id, trip) AS n,
  bool_or(note = 'missing trip - less than 250m') OVER (PARTITION BY user_id, trip) AS has_short, bool_or(note = 'single point') OVER (PARTITION BY user_id, trip) AS has_single FROM ro1),
rd AS (SELECT user_id, trip, i, easting AS ae, northing AS an, 0.0::DOUBLE AS far FROM ro WHERE i = 1
  UNION ALL SELECT user_id, trip, i, CASE WHEN note <> 'missing trip - less than 250m' THEN easting ELSE ae END, CASE WHEN note <> 'missing trip - less than 250m' THEN northing ELSE an END,
    far + CASE WHEN n = 2 AND has_short AND has_single THEN 0 ELSE d END
  FROM (SELECT x.*, w.ae, w.an, w.far, round({geo.planar("w.ae", "w.an", "x.easting", "x.northing")}, 3) AS d FROM rd w JOIN ro x ON x.user_id = w.user_id AND x.trip = w.trip AND x.i = w.i + 1)),
os AS (SELECT user_id, trip, arg_min(t, i) AS s_t, arg_max(t, i) AS e_t, arg_min(lat, i) AS olat, arg_min(lon, i) AS olon, arg_max(lat, i) AS dlat, arg_max(lon, i) AS dlon, arg_min(easting, i) AS oe, arg_min(northing, i) AS on2,
  arg_max(easting, i) AS de, arg_max(northing, i) AS dn, round(arg_max(far, i), 3) AS far, list_sort(list_distinct(flatten(list(codes)))) AS codes,
  CASE WHEN bool_or(note = 'complete trip - metro') THEN 2 WHEN bool_or(note = 'complete trip') THEN 1 WHEN bool_or(note = 'single point') THEN 201 WHEN bool_or(note = 'missing trip') THEN 101 ELSE 102 END AS own
  FROM ro JOIN rd USING (user_id, trip, i) GROUP BY 1, 2)"""
)

#: Logger segments split at stop locations: points `sp` with piece; for use under WITH RECURSIVE.
_SPLIT = (
    _seg().replace(", good AS (SELECT * FROM pts WHERE h_accuracy <= 50)", f", {_walk('pts', _STEP)}, good AS (SELECT pts.* FROM pts JOIN walk USING (user_id, point_id) WHERE kept)")
    + f""", {_SURVEY}, pu AS (SELECT user_id, place_order, label, {_UTM} FROM places),
sg AS (SELECT * FROM (SELECT *, row_number() {_W} AS rn FROM seg) WHERE rn > 1),
nr AS (SELECT s.user_id, point_id, arg_min(label, place_order) AS label, arg_min(p.easting, place_order) AS e, arg_min(p.northing, place_order) AS n FROM sg s JOIN pu p ON p.user_id = s.user_id AND {geo.planar("p.easting", "p.northing", "s.easting", "s.northing")} <= 60 GROUP BY 1, 2),
t0 AS (SELECT sg.*, label, e, n, label IS NOT NULL AS inside FROM sg LEFT JOIN nr USING (user_id, point_id)),
s1 AS (SELECT *, CASE WHEN lag(inside) OVER q <> inside THEN 1 ELSE 0 END AS new, lag(t) OVER q AS bt, lead(t) OVER q AS at_ FROM t0 WINDOW q AS (PARTITION BY user_id, segment_group ORDER BY t, point_id)),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id, segment_group ORDER BY t, point_id) AS stay FROM s1),
s3 AS (SELECT *, row_number() OVER w AS i, count(*) OVER v AS k, max(t) OVER v - min(t) OVER v AS lasts, max(stay) OVER (PARTITION BY user_id, segment_group) AS last_stay, max(segment_group) OVER (PARTITION BY user_id) AS last_group
  FROM s2 WINDOW v AS (PARTITION BY user_id, segment_group, stay), w AS (PARTITION BY user_id, segment_group, stay ORDER BY t, point_id)),
s4 AS (SELECT *, inside AND stay <> last_stay AND lasts >= 120 AS splits, inside AND stay = last_stay AND segment_group = last_group AS ends, count(*) OVER (PARTITION BY user_id, segment_group, stay, label) AS own FROM s3),
s5 AS (SELECT *, sum((splits AND i = 1)::INT) OVER (PARTITION BY user_id, segment_group ORDER BY t, point_id) - splits::INT AS piece FROM s4),
mo AS (SELECT user_id, segment_group, stay, arg_min(e, ROW(-own, i)) AS se, arg_min(n, ROW(-own, i)) AS sn, arg_min(bt, i) FILTER (i = 1) AS came, arg_max(at_, i) FILTER (i = k) AS gone FROM s5 WHERE splits OR ends GROUP BY 1, 2, 3),
h0 AS (SELECT s5.*, se, sn, came, gone, CASE WHEN i <= round_even(k / 2, 0) THEN 0 ELSE 1 END AS side FROM s5 JOIN mo USING (user_id, segment_group, stay)),
h1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment_group, stay, side ORDER BY CASE side WHEN 0 THEN i ELSE -i END) AS o FROM h0),
hw AS (SELECT user_id, segment_group, stay, side, o, {geo.planar("se", "sn", "easting", "northing")} <= 200 AS seen, easting AS ae, northing AS an, NULL::DOUBLE AS least, true AS leads FROM h1 WHERE o = 1
  UNION ALL SELECT user_id, segment_group, stay, side, o, seen OR near, CASE WHEN seen THEN ae ELSE easting END, CASE WHEN seen THEN an ELSE northing END, CASE WHEN seen THEN d END, leads AND (NOT seen OR least IS NULL OR d < least)
  FROM (SELECT n.*, w.seen, w.ae, w.an, w.least, w.leads, {geo.planar("w.ae", "w.an", "n.easting", "n.northing")} AS d, {geo.planar("n.se", "n.sn", "n.easting", "n.northing")} <= 200 AS near
    FROM hw w JOIN h1 n ON n.user_id = w.user_id AND n.segment_group = w.segment_group AND n.stay = w.stay AND n.side = w.side AND n.o = w.o + 1)),
sp AS (SELECT user_id, segment_group, piece, point_id, t, lat, lon, easting, northing, distance_before FROM s5 WHERE NOT splits AND NOT ends
  UNION ALL SELECT user_id, segment_group, piece + side, point_id, t, lat, lon, easting, northing, distance_before FROM h1 JOIN hw USING (user_id, segment_group, stay, side, o)
  WHERE leads AND CASE side WHEN 0 THEN t - came <= 120 ELSE splits AND gone - t <= 120 END)"""
)

_LAT, _LON = geo.to_latlon("easting", "northing", "18")


def oracle_sql() -> dict[str, str]:
    p = "WITH " + _pts()
    return {
        "accuracy_filter": f"WITH {_good()} SELECT user_id, point_id, t, h_accuracy FROM good",
        "user_semijoin": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT user_id FROM events)",
        "time_range_inclusive": p + " SELECT user_id, point_id, t FROM pts WHERE t BETWEEN 17045000 AND 17055000",
        "time_range_exclusive": p + " SELECT user_id, point_id, t FROM pts WHERE t > 17045000 AND t < 17055000",
        "utm_project": f"WITH {_pts(WIDE)} SELECT point_id, easting, northing, 18 AS zone, 'T' AS letter FROM pts",
        "utm_round_trip": f"WITH {_pts(WIDE)} SELECT point_id, round(0.0, 6)::DOUBLE AS dlat, 0.0::DOUBLE AS dlon FROM pts",
        "kinematics": f"WITH {_pts(WIDE)}, {_kin('pts')} SELECT user_id, point_id, duration_s, round(distance_m, 4) AS distance_m, round(bearing, 4) AS bearing, round(coalesce({geo.delta_heading('pb', 'bearing')}, 0), 4) AS delta_heading FROM k2",
        "haversine_standard": f"WITH {_pts(WIDE)} SELECT point_id, round({geo.haversine(geo.lit(45.5), geo.lit(-73.6), 'lat', 'lon', False)}, 3) AS distance_m FROM pts",
        "gap_segments": f"WITH {_seg()} SELECT user_id, point_id, segment_group, period_before, round(distance_before, 1) AS distance_before FROM seg",
        "logger_segments": f"WITH {_seg()}, n AS (SELECT *, row_number() {_W} AS i FROM seg) SELECT user_id, point_id, segment_group FROM n WHERE i > 1",
        "segment_summary": f"WITH {_trips()} SELECT user_id, segment_group, f_t AS start_t, z_t AS end_t, n_points, round(direct_distance, 1) AS direct_distance, round(cumulative_distance, 1) AS cumulative_distance FROM tr",
        "short_extent": f"WITH {_seg()}, c AS (SELECT user_id, segment_group, avg(easting) AS ce, avg(northing) AS cn FROM seg GROUP BY 1, 2), far AS (SELECT user_id, segment_group FROM seg JOIN c USING (user_id, segment_group) GROUP BY 1, 2 HAVING max({geo.planar('ce', 'cn', 'easting', 'northing')}) > 250) SELECT user_id, point_id FROM seg JOIN far USING (user_id, segment_group)",
        "missing_segments": f"WITH {_gaps()} SELECT user_id, segment_group, round(gap_m, 1) AS distance FROM gp WHERE gap_m > 250",
        "nearest_entrance_first": f"WITH {_good()}, {_entrances()} SELECT user_id, point_id, {_at('good.easting', 'good.northing', 100.0)} AS place FROM good",
        "subway_links": _paired(_subway(False)),
        "metro_links_older": f"WITH {_subway(True)}, q AS (SELECT *, lag(condition) {_T} AS before FROM cn) SELECT user_id, segment_group, condition AND NOT coalesce(before, false) AS link FROM q",
        "velocity_links": _paired(_speed(">= 2.0")),
        "velocity_links_older": f"WITH {_speed('> 2.0')} SELECT user_id, segment_group, condition AS link FROM cn",
        "missing_trips": f"WITH RECURSIVE {_MISSING} SELECT user_id, segment_group, kind, round(gap_m, 1) AS gap_m, gap_s FROM miss",
        "trip_codes": f"WITH RECURSIVE {_MISSING} SELECT user_id, segment_group, trip_code FROM coded",
        "merged_diary": f"""WITH RECURSIVE {_MISSING}, u AS (SELECT user_id, segment_group, 2 AS after, trip_code, f_t AS start_t, z_t AS end_t FROM coded
  UNION ALL SELECT user_id, segment_group, 1, {_GAP_CODE}, pt, f_t FROM miss WHERE kind IN ('general', 'subway', 'known_location')
  UNION ALL SELECT m.user_id, next_group, 0, 104, m.f_t, n.f_t FROM miss m JOIN tr n ON n.user_id = m.user_id AND n.segment_group = m.next_group WHERE kind = 'known_location')
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY segment_group, after) AS trip_num, trip_code, start_t, end_t FROM u""",
        "linked_trips": f"WITH RECURSIVE {_LINKED} SELECT user_id, trip_key, count(*) AS n_points, concat_ws(',', CASE WHEN any_value(sub) THEN 'subway' END, CASE WHEN any_value(walk) THEN 'walking' END) AS labels FROM seg JOIN keys USING (user_id, segment_group) GROUP BY 1, 2",
        "trip_points": f"""WITH RECURSIVE {_LINKED} SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY trip_key) AS trip_num, row_number() OVER q AS seq, point_id, round(round(sum(distance_before) OVER q, 3), 1) AS trip_distance
FROM lseg WINDOW q AS (PARTITION BY user_id, trip_key ORDER BY t, point_id)""",
        "phone_diary": f"WITH RECURSIVE {_DIARY} SELECT user_id, trip_num, trip_code, merge_codes, seq, point_id, t, lat, lon, h_accuracy, period_before, round(trip_distance, 1) AS trip_distance FROM dia",
        "lone_points": f"WITH RECURSIVE {_trips()}, {_SURVEY}, {_fates('tr')} SELECT user_id, segment_group, fate FROM fates WHERE fate IS NOT NULL",
        "trip_summaries": f"""WITH RECURSIVE {_DIARY}, ts AS (SELECT user_id, trip_num AS trip_id, any_value(trip_code) AS trip_code, any_value(merge_codes) AS merge_codes, arg_min(t, seq) AS s, arg_max(t, seq) AS e, arg_min(lat, seq) AS olat, arg_min(lon, seq) AS olon,
  arg_max(lat, seq) AS dlat, arg_max(lon, seq) AS dlon, arg_max(trip_distance, seq) AS far FROM dia GROUP BY 1, 2)
SELECT user_id, trip_id, trip_code, merge_codes, make_timestamp(CAST(s AS BIGINT) * 1000000) AS "start_UTC", {_local("s")} AS start, make_timestamp(CAST(e AS BIGINT) * 1000000) AS "end_UTC", {_local("e")} AS "end", olat, olon, dlat, dlon,
  round(round({geo.planar(geo.easting("olat", "olon"), geo.northing("olat", "olon"), geo.easting("dlat", "dlon"), geo.northing("dlat", "dlon"))}, 3), 1) AS direct_distance, round(far, 1) AS cumulative_distance FROM ts""",
        "older_distances": f"""WITH RECURSIVE {_seg()}, q0 AS (SELECT user_id, point_id, segment_group // 2 AS trip_num, easting, northing, CASE WHEN point_id % 3 = 0 THEN 'short' WHEN point_id % 5 < 2 THEN 'single' END AS note,
  CASE WHEN point_id % 4 <> 0 THEN period_before ELSE 0 END AS brk, row_number() OVER (PARTITION BY user_id, segment_group // 2 ORDER BY t, point_id) AS i, count(*) OVER (PARTITION BY user_id, segment_group // 2) AS n FROM seg),
q1 AS (SELECT *, n = 2 AND count(*) FILTER (note = 'short') OVER w > 0 AND count(*) FILTER (note = 'single') OVER w > 0 AS none FROM q0 WINDOW w AS (PARTITION BY user_id, trip_num)),
qw AS (SELECT user_id, trip_num, point_id, i, easting AS ae, northing AS an, 0.0::DOUBLE AS distance, 0.0::DOUBLE AS total, 0.0::DOUBLE AS speed FROM q1 WHERE i = 1
  UNION ALL SELECT user_id, trip_num, point_id, i, CASE WHEN note IS DISTINCT FROM 'short' THEN easting ELSE ae END, CASE WHEN note IS DISTINCT FROM 'short' THEN northing ELSE an END,
    CASE WHEN none THEN 0 ELSE d END, total + CASE WHEN none THEN 0 ELSE d END, CASE WHEN none THEN 0 WHEN brk > 0 THEN d / brk ELSE speed END
  FROM (SELECT n.*, w.ae, w.an, w.total, w.speed, round({geo.planar("w.ae", "w.an", "n.easting", "n.northing")}, 3) AS d FROM qw w JOIN q1 n ON n.user_id = w.user_id AND n.trip_num = w.trip_num AND n.i = w.i + 1))
SELECT user_id, point_id, distance, round(round(total, 3), 1) AS trip_distance, round(speed, 6) AS avg_speed FROM qw""",
        "older_diary": f"""WITH RECURSIVE {_OLDER} SELECT user_id, trip AS trip_id, CASE WHEN far = 0 THEN 201 WHEN far < 250 THEN 202 ELSE own END AS trip_code, s_t AS start_t, e_t AS end_t, olat, olon, dlat, dlon,
  array_to_string(codes, ', ') AS merge_codes, round(round({geo.planar("oe", "on2", "de", "dn")}, 3), 1) AS direct_distance, round(far, 1) AS cumulative_distance FROM os""",
        "polylines": f"WITH {_seg(WIDE)} SELECT user_id, segment_group, (row_number() OVER (PARTITION BY user_id, segment_group ORDER BY t, point_id) - 1)::INT AS seq, round(lat * 100000) / 100000 AS lat, round(lon * 100000) / 100000 AS lon FROM seg",
        "sql_functions": f"""WITH {_pts(WIDE)} SELECT point_id, easting, northing, 18 AS zone, 'T' AS letter, round({geo.haversine(geo.lit(45.5), geo.lit(-73.6), 'lat', 'lon')}, 3) AS far,
  round({geo.bearing(geo.lit(45.5), geo.lit(-73.6), 'lat', 'lon')}, 4) AS bearing, 0.0::DOUBLE AS dlat FROM pts""",
        "stop_split": f"WITH RECURSIVE {_SPLIT} SELECT user_id, segment_group, piece, point_id FROM sp",
        "logger_trips": f"""WITH RECURSIVE {_SPLIT}, c AS (SELECT user_id, segment_group, piece, avg(easting) AS ce, avg(northing) AS cn FROM sp GROUP BY 1, 2, 3),
far AS (SELECT user_id, segment_group, piece FROM sp JOIN c USING (user_id, segment_group, piece) GROUP BY 1, 2, 3 HAVING max({geo.planar('ce', 'cn', 'easting', 'northing')}) > 250),
kp AS (SELECT sp.*, dense_rank() OVER (PARTITION BY user_id ORDER BY segment_group, piece) AS key FROM sp JOIN far USING (user_id, segment_group, piece)),
en AS (SELECT user_id, key, {", ".join(f"arg_{f}({c}, ROW(t, point_id)) AS {n}_{c}" for n, f in (("f", "min"), ("z", "max")) for c in ("t", "lat", "lon", "easting", "northing"))} FROM kp GROUP BY 1, 2),
ga AS (SELECT n.*, p.z_t AS pt, p.z_lat AS plat, p.z_lon AS plon, round({geo.planar("p.z_easting", "p.z_northing", "n.f_easting", "n.f_northing")}, 3) AS m FROM en n JOIN en p ON p.user_id = n.user_id AND p.key = n.key - 1),
un AS (SELECT user_id, key, 1 AS after, 1 AS trip_code, row_number() OVER w AS seq, point_id, t, lat, lon, round(coalesce(sum(distance_before) OVER (PARTITION BY user_id, key ORDER BY t, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS trip_distance
    FROM kp WINDOW w AS (PARTITION BY user_id, key ORDER BY t, point_id)
  UNION ALL SELECT user_id, key, 0, 101, 1, NULL, pt, plat, plon, 0.0 FROM ga WHERE m > 250 UNION ALL SELECT user_id, key, 0, 101, 2, NULL, f_t, f_lat, f_lon, m FROM ga WHERE m > 250)
SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY key, after) AS trip_num, trip_code, seq, point_id, t, lat, lon, round(trip_distance, 1) AS trip_distance FROM un""",
        "core_distances": f"""WITH {_pts()}, o AS (SELECT a.user_id, a.point_id, {geo.planar("a.easting", "a.northing", "b.easting", "b.northing")} AS d, count(*) OVER (PARTITION BY a.user_id, a.point_id) AS n,
  row_number() OVER (PARTITION BY a.user_id, a.point_id ORDER BY {geo.planar("a.easting", "a.northing", "b.easting", "b.northing")}) AS k FROM pts a JOIN pts b USING (user_id))
SELECT user_id, point_id, round(d, 2) AS core FROM o WHERE k = least(n, 21)""",
        "stops_in_time": f"WITH RECURSIVE {_pts()}, {_RELABEL} SELECT user_id, point_id, stop FROM rw",
        "weighted_centres": f"""WITH RECURSIVE {_pts()}, {_RELABEL}, s0 AS (SELECT user_id, point_id, stop, t, easting, northing, max(stop) OVER (PARTITION BY user_id) AS lost FROM rw JOIN pts USING (user_id, point_id) WHERE stop <> -1),
s1 AS (SELECT user_id, stop FROM s0 WHERE stop < lost GROUP BY 1, 2 HAVING max(t) - min(t) >= 600), s2 AS (SELECT s0.* FROM s0 JOIN s1 USING (user_id, stop)),
nn AS (SELECT a.user_id, a.stop, a.point_id, any_value(a.easting) AS easting, any_value(a.northing) AS northing, coalesce(min(CASE WHEN a.easting <> b.easting OR a.northing <> b.northing
  THEN {geo.planar("a.easting", "a.northing", "b.easting", "b.northing")} END), 1e16) AS d FROM s2 a JOIN s2 b ON a.user_id = b.user_id AND a.stop = b.stop GROUP BY 1, 2, 3)
SELECT user_id, stop, round(sum(easting / d) / sum(1 / d), 4) AS easting, round(sum(northing / d) / sum(1 / d), 4) AS northing, count(*) AS n_points FROM nn GROUP BY 1, 2""",
        "attribute_stops": f"""WITH RECURSIVE {_pts()}, a0 AS (SELECT user_id, point_id, (point_id * 17 % 40) / 100.0 AS v, (point_id * 29 % 180)::DOUBLE AS h, coalesce(t - lag(t) {_W}, 0) AS dur, row_number() {_W} AS i FROM pts),
a1 AS (SELECT *, lag(v) q AS pv, lead(v) q AS nv, coalesce(lead(v) q <= 0.15 OR lead(h) q > 90, false) AS ns FROM (SELECT * FROM a0)),
aw AS (SELECT user_id, point_id, i, NULL::VARCHAR AS label, nv FROM a1 WHERE i = 1
  UNION ALL SELECT user_id, point_id, i, CASE WHEN i = 2 OR nv IS NULL THEN c WHEN l = 'stop' AND ns THEN CASE WHEN c = 'trip' AND dur >= 60 THEN 'trip' ELSE 'stop' END
    WHEN l = 'trip' AND NOT ns THEN CASE WHEN c = 'stop' AND dur >= 120 THEN 'stop' ELSE 'trip' END
    WHEN l = 'trip' AND ns AND c = 'trip' AND CASE WHEN pv = 0 THEN v > 0 ELSE (v - pv) / pv > 1 END THEN 'stop' ELSE c END, nv
  FROM (SELECT n.*, CASE WHEN n.v <= 0.15 THEN 'stop' ELSE 'trip' END AS c, w.label AS l FROM aw w JOIN a1 n ON n.user_id = w.user_id AND n.i = w.i + 1))
SELECT user_id, point_id, CASE WHEN nv IS NULL THEN 'stop' ELSE label END AS label FROM aw""".replace(" q ", " OVER (PARTITION BY user_id ORDER BY i) "),
        "spike_filter": f"WITH RECURSIVE {_good(WIDE)}, {_walk('good', _SPIKE)} SELECT user_id, point_id FROM walk WHERE kept",
        "logger_preprocess": f"WITH RECURSIVE {_pts(WIDE)}, {_walk('pts', _STEP)} SELECT user_id, point_id, coalesce(wt - pt, 0) AS duration_s, round(coalesce({geo.haversine('pla', 'plo', 'wla', 'wlo')}, 0), 3) AS distance_m FROM walk WHERE kept",
        "rolling_avg": p + f", n AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY user_id) AS c, sum(value) OVER (PARTITION BY user_id ORDER BY t, point_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS s FROM pts) SELECT user_id, point_id, CASE WHEN i - 2 >= 10 AND c - i >= 10 THEN round(s / 21, 6) END AS rolling_avg FROM n",
        "trailing_avg": p + f", n AS (SELECT *, row_number() {_W} AS i, avg(value) OVER (PARTITION BY user_id ORDER BY t, point_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM pts) SELECT user_id, point_id, CASE WHEN i >= 5 THEN round(s, 6) END AS trailing_avg FROM n",
        "complete_days": f"WITH {_DAYS} SELECT user_id, date, has_trips, is_complete, n_trips FROM days",
        "inactivity": f"WITH {_DAYS} SELECT user_id, date, consecutive_inactive_days, first_inactive_day, inactive_day_streak, inactivity_streak FROM ina",
        "explained_days": f"WITH {_DAYS} SELECT user_id, date, is_complete OR explained AS is_complete, explained, CASE WHEN is_complete OR explained THEN 'complete' WHEN has_trips THEN 'incomplete' ELSE 'inactive' END AS state FROM ex",
        "explained_days_geodesic": "WITH " + _DAYS.replace(geo.haversine("a.e_lat", "a.e_lon", "b.s_lat", "b.s_lon"), _ellipsoid("a.e_lat", "a.e_lon", "b.s_lat", "b.s_lon")) + " SELECT user_id, date, explained FROM ex",
        "unpivot_locations": f"WITH {_SURVEY} SELECT * FROM places",
        "survey_locations": f"WITH {_SURVEY} SELECT user_id, label, lat, lon FROM places",
        "located_segments": f"WITH {_seg()}, {_centres('seg', 'segment_group', 'sc')} SELECT user_id, segment_group, round({_LAT}, 5) AS lat, round({_LON}, 5) AS lon FROM sc",
        "label_points_last": p + f", {_SURVEY}, {_label('arg_max', 'pts', 300.0)} SELECT user_id, point_id, label FROM pts LEFT JOIN lab USING (user_id, point_id)",
        "label_points_first": p + f", {_SURVEY}, {_label('arg_min', 'pts', 300.0)} SELECT user_id, point_id, label FROM pts LEFT JOIN lab USING (user_id, point_id)",
        "location_overlaps": f"WITH {_SURVEY} SELECT a.user_id, a.label AS label_a, b.label AS label_b, round({geo.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 2) AS distance_m FROM places a JOIN places b ON a.user_id = b.user_id AND a.place_order < b.place_order WHERE {geo.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 300",
        "commutes_dwells": f"WITH {_SPANS} SELECT * FROM spans",
        "activity_daily": f"""WITH {_SPANS}, {_pieces("spans")}, x AS (SELECT user_id, date, count(*) FILTER (kind = 'commute') AS num_trips, coalesce(sum(CASE WHEN kind = 'commute' THEN seconds END), 0) AS trips_duration_s, {_sums("{k}_{x}_s", "seconds", "coalesce({}, 0)")} FROM pc GROUP BY 1, 2),
m AS (SELECT user_id, {_local("t")}::DATE AS date, count(*) AS num_points, round(round(sum(distance_before), 3), 1) AS trips_distance_m FROM seg GROUP BY 1, 2)
SELECT coalesce(x.user_id, m.user_id) AS user_id, coalesce(x.date, m.date) AS date, coalesce(num_trips, 0) AS num_trips, coalesce(trips_duration_s, 0) AS trips_duration_s, coalesce(commute_work_s, 0) AS commute_work_s, coalesce(commute_study_s, 0) AS commute_study_s,
coalesce(dwell_home_s, 0) AS dwell_home_s, coalesce(dwell_work_s, 0) AS dwell_work_s, coalesce(dwell_study_s, 0) AS dwell_study_s, coalesce(num_points, 0) AS num_points, coalesce(trips_distance_m, 0) AS trips_distance_m FROM x FULL JOIN m ON x.user_id = m.user_id AND x.date = m.date""",
        "activity_daily_pivot": f"""WITH {_SPANS}, dy AS (SELECT user_id, trip_key, 'commute' AS kind, label, start, "end" FROM dyn
  UNION ALL SELECT user_id, trip_key, kind, coalesce(label, 'uncategorized'), start, "end" FROM spans WHERE kind = 'dwell'), {_pieces("dy")}
SELECT user_id, date, {", ".join(f"sum(seconds) FILTER (kind = '{k}' AND label = '{x}') AS {k}_{x.replace('-', '_')}" for k, xs in (("commute", ("home-home", "home-study", "home-work", "study-study", "study-work", "work-work", "uncategorized")), ("dwell", ("home", "study", "work", "uncategorized"))) for x in xs)} FROM pc GROUP BY 1, 2""",
        "condensed_trips": f"WITH {_DAYS} SELECT dt.user_id, trip_num, CASE WHEN trip_code < 100 THEN 'complete' ELSE 'missing' END AS trip_type, date, coalesce(is_complete, false) AS complete_day FROM dt LEFT JOIN days USING (user_id, date)",
        "midnight_split": f"""WITH {_pts(clock=1)}, q AS (SELECT point_id, make_timestamp(t * 1000000) AS s, make_timestamp(t * 1000000) + INTERVAL 9 HOURS AS e FROM pts)
SELECT point_id, s::DATE AS date, epoch(e) - epoch(s) AS seconds FROM q WHERE day(s) = day(e) UNION ALL SELECT point_id, s::DATE, epoch(date_trunc('day', e)) - epoch(s) FROM q WHERE day(s) <> day(e)
UNION ALL SELECT point_id, e::DATE, epoch(e) - epoch(date_trunc('day', e)) FROM q WHERE day(s) <> day(e)""",
        "day_split": f"""WITH {_pts(clock=1)}, q AS (SELECT point_id, make_timestamp(t * 1000000) AS s, make_timestamp(t * 1000000) + INTERVAL 40 HOURS AS e FROM pts),
r AS (SELECT *, unnest(generate_series(date_trunc('day', s), date_trunc('day', e), INTERVAL 1 DAY)) AS d FROM q)
SELECT point_id, d::DATE AS date, epoch(least(e, d + INTERVAL 1 DAY)) - epoch(greatest(s, d)) AS seconds FROM r""",
        "local_dates": f"WITH {_pts(clock=1)} SELECT user_id, {_local('t')}::DATE AS date, count(*) AS n_points FROM pts GROUP BY 1, 2",
        "stop_centroids": f"WITH {_seg()} SELECT user_id, segment_group, round(round(avg(easting), 3), 1) AS easting, round(round(avg(northing), 3), 1) AS northing, min(t) AS first_t, max(t) AS last_t, count(*) AS n_points FROM seg GROUP BY 1, 2",
        "heading_stops": p + f", {_HEADING} SELECT user_id, point_id, stop FROM hs",
        "kmeans_runs": p + f", {_KMEANS} SELECT user_id, point_id, CASE WHEN kmeans = 'stop' AND max(t) OVER q - min(t) OVER q < 120 THEN 'trip' ELSE kmeans END AS kmeans, run FROM g WINDOW q AS (PARTITION BY user_id, run)",
        "condensed_places": f"WITH RECURSIVE {_seg()}, {_centres('seg', 'segment_group', 'sc')}, {_condensed('sc', 'segment_group', 'pl')} SELECT user_id, place, round(easting, 1) AS easting, round(northing, 1) AS northing FROM pl",
        "activity_locations": f"""WITH RECURSIVE {_pts()}, {_KMEANS}, {_HEADING}, ks AS (SELECT pts.*, run FROM g JOIN pts USING (user_id, point_id) WHERE kmeans = 'stop'), {_centres("ks", "run", "ka")}, {_centres("hs", "stop", "ha")},
{_condensed("ka", "run", "pa")}, {_condensed("ha", "stop", "pb")},
ok AS (SELECT pa.user_id, pa.place AS at_, arg_min(pb.easting, pb.place) AS easting, arg_min(pb.northing, pb.place) AS northing FROM pb JOIN pa ON pa.user_id = pb.user_id
  AND {geo.planar("pa.easting", "pa.northing", "pb.easting", "pb.northing")} <= 50 GROUP BY 1, 2)
SELECT user_id, round(easting, 1) AS easting, round(northing, 1) AS northing, 'location_' || row_number() OVER (PARTITION BY user_id ORDER BY at_) AS label FROM ok""",
        "dbscan": f"""WITH RECURSIVE {_pts()}, nb AS (SELECT a.user_id, a.point_id AS p, b.point_id AS q FROM pts a JOIN pts b ON a.user_id = b.user_id AND {geo.planar("a.easting", "a.northing", "b.easting", "b.northing")} < 120),
core AS (SELECT user_id, p FROM nb GROUP BY 1, 2 HAVING count(*) >= 5), cl AS (SELECT nb.* FROM nb JOIN core a USING (user_id, p) JOIN core b ON b.user_id = nb.user_id AND b.p = nb.q),
reach AS (SELECT user_id, p AS root, p FROM core UNION SELECT r.user_id, r.root, cl.q FROM reach r JOIN cl ON cl.user_id = r.user_id AND cl.p = r.p),
lab AS (SELECT user_id, p, dense_rank() OVER (PARTITION BY user_id ORDER BY root) AS cluster FROM (SELECT user_id, p, min(root) AS root FROM reach GROUP BY 1, 2)),
bor AS (SELECT nb.user_id, nb.p, min(cluster) AS cluster FROM nb JOIN lab ON lab.user_id = nb.user_id AND lab.p = nb.q WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.user_id = nb.user_id AND c.p = nb.p) GROUP BY 1, 2)
SELECT pts.user_id, point_id, coalesce(lab.cluster, bor.cluster, -1) AS cluster FROM pts LEFT JOIN lab ON lab.user_id = pts.user_id AND lab.p = point_id LEFT JOIN bor ON bor.user_id = pts.user_id AND bor.p = point_id""",
        "activity_condensed": f"""WITH {_SPANS}, {_DAYS.replace(_seg(clock=1, gap=DAY_GAP) + ", ", "", 1)}, x AS (SELECT user_id, min(start) AS first_seen, max("end") AS last_seen, count(*) FILTER (kind = 'commute') AS num_trips,
  sum("end" - start) FILTER (kind = 'commute') AS total_commute_s, sum("end" - start) FILTER (kind = 'commute' AND label = 'work') AS commute_time_work_s, sum("end" - start) FILTER (kind = 'commute' AND label = 'study') AS commute_time_study_s,
  sum("end" - start) FILTER (kind = 'dwell' AND label = 'home') AS stay_time_home_s, sum("end" - start) FILTER (kind = 'dwell' AND label = 'work') AS stay_time_work_s, sum("end" - start) FILTER (kind = 'dwell' AND label = 'study') AS stay_time_study_s FROM spans GROUP BY 1),
y AS (SELECT user_id, count(*) FILTER (is_complete) AS complete_days, count(*) FILTER (has_trips AND NOT is_complete) AS incomplete_days, count(*) FILTER (NOT has_trips AND NOT is_complete) AS inactive_days FROM days GROUP BY 1)
SELECT x.*, complete_days, incomplete_days, inactive_days, round(num_trips / nullif(complete_days + incomplete_days, 0), 6) AS avg_trips_per_day FROM x LEFT JOIN y USING (user_id)""",
        "dedupe_stations": f"WITH e0 AS (SELECT {_spot('s_suppkey', 53, 17, TIGHT)} FROM supplier) SELECT DISTINCT round(lat, 6) AS lat, round(lon, 6) AS lon FROM e0",
        "count_users": "SELECT count(*) AS n_users FROM customer",
        "trip_diff": f"""WITH {_trips()}, k6 AS (SELECT user_id, t, point_id, sum(CASE WHEN period_before > 600 THEN 1 ELSE 0 END) {_W} AS segment_group FROM k),
t6 AS (SELECT user_id, segment_group, min(t) AS s, max(t) AS e FROM k6 GROUP BY 1, 2)
SELECT user_id, tr.segment_group, CASE WHEN t6.s IS NULL THEN -1 WHEN f_t = t6.s AND z_t = t6.e THEN 1 ELSE 0 END AS match FROM tr LEFT JOIN t6 USING (user_id, segment_group)""",
    }
