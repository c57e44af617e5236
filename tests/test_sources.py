"""Files in, tables, files out."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tripweave.sources import catalog, csv, sinks

HEAD = "uuid,latitude,longitude,altitude,speed,direction,h_accuracy,v_accuracy,acceleration_x,acceleration_y,acceleration_z,point_type,mode_detected,timestamp_UTC,timestamp_epoch"


def write(tmp_path, name, text, encoding="utf-8"):
    (tmp_path / name).write_text(text, encoding=encoding)
    return str(tmp_path / name)


def test_coordinates_with_mark_blanks_and_no_time(spark, tmp_path):
    rows = "A-B1,45.5,-73.6,,1.5,,10,,,,,,,2024-01-01 10:00:00,1704103200\nA-B1,45.5,-73.6,,,,,,,,,,,,\n"
    got = csv.coordinates(spark, write(tmp_path, "c.csv", HEAD + "\n" + rows, "utf-8-sig")).collect()
    assert len(got) == 1 and got[0].user_id == "ab1" and got[0].altitude is None and got[0].timestamp_UTC == dt.datetime(2024, 1, 1, 10)


def test_missing_column_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="latitude"):
        csv.coordinates(spark, write(tmp_path, "c.csv", "uuid,timestamp_UTC\na,2024-01-01\n"))


def test_logger_signs_years_and_zeros(spark, tmp_path):
    head = ",".join(csv.LOGGER)
    rows = ["1,24/1/2,3:04:05,,,45.5,S,73.6,W,10,1.5 km/h,ann", "2,2024/01/02,03:04:06,,,0.4,N,0.9,E,,,ann", "3,24/1/2,3:04:05,,,,N,,E,,,ann"]
    got = csv.logger_coordinates(spark, write(tmp_path, "q.csv", head + "\n" + "\n".join(rows) + "\n")).collect()
    assert [(r.latitude, r.longitude, r.speed, r.timestamp_UTC) for r in got] == [(-45.5, -73.6, 1.5, dt.datetime(2024, 1, 2, 3, 4, 5))]
    assert got[0].user_id == csv.user_key_of("ann")
    assert csv.null_survey(csv.logger_coordinates(spark, str(tmp_path / "q.csv"))).count() == 1


def test_stations_sniff_the_separator(spark, tmp_path):
    got = csv.stations(spark, write(tmp_path, "s.csv", "Name;Y;X\na;45.5;-73.6\nb;45.5;-73.6\n")).collect()
    assert [(r.latitude, r.longitude) for r in got] == [(45.5, -73.6)]


def test_utc_normalised(spark):
    df = spark.createDataFrame([("2024-07-01 12:00:00", "45.5, -73.6"), ("0000-00-00 00:00:00", None), ("", "x")], "at string, home string")
    got = csv.utc_normalised(df, ["at"], "America/Montreal", ["extra"], split_locations={"home": ("lat", "lon")}).collect()
    assert [r["at"] for r in got] == [dt.datetime(2024, 7, 1, 16), dt.datetime(1999, 1, 1), dt.datetime(1999, 1, 1)]
    assert (got[0].lat, got[0].lon, got[2].lat, got[0].extra) == (45.5, -73.6, None, None)


def test_catalog_replaces_users_only(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    c.save("trips", spark.createDataFrame([(u, u * 10) for u in range(20)], "user_id long, x long"))
    c.replace_users("trips", spark.createDataFrame([(3, -1)], "user_id long, x long"))
    got = {r.user_id: r.x for r in c.read("trips").collect()}
    assert got == {u: (-1 if u == 3 else u * 10) for u in range(20)}
    assert c.user("trips", 5).first().x == 50 and not c.exists("other")
    with pytest.raises(catalog.UserNotFoundError):
        c.require_user("trips", 99)


def test_catalog_is_atomic(spark, tmp_path, monkeypatch):
    """A failure between write and commit changes nothing; a reader keeps its snapshot; writers of unlike buckets both win, of like ones the second fails."""
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "user_id long, x long")
    everything = lambda df: sorted(tuple(r) for r in df.collect())
    c.save("trips", frame(*[(u, u) for u in range(30)]))
    before, pinned = everything(c.read("trips")), c.read("trips")

    with monkeypatch.context() as m:
        m.setattr(catalog._Files, "rename_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            c.replace_users("trips", frame((3, -1)))
    assert everything(c.read("trips")) == before and c.snapshots("trips") == [1]
    assert c.vacuum("trips") == 1 and everything(c.read("trips")) == before

    c.replace_users("trips", frame((3, -1), (3, -2)))
    after = sorted([r for r in before if r[0] != 3] + [(3, -2), (3, -1)])
    assert everything(c.read("trips")) == after and everything(pinned) == before and everything(c.read("trips", 1)) == before
    c.delete_users("trips", frame((4, 0)).select("user_id"))
    assert everything(c.read("trips")) == [r for r in after if r[0] != 4]

    def between(user, value):
        """Another writer commits while this one has written and not committed."""
        commit = catalog.Catalog._commit

        def late(self, *args, **kw):
            monkeypatch.setattr(catalog.Catalog, "_commit", commit)
            catalog.Catalog(spark, str(tmp_path / "cat")).replace_users("trips", frame((user, value)))
            return commit(self, *args, **kw)

        monkeypatch.setattr(catalog.Catalog, "_commit", late)

    bucket = lambda u: spark.range(1).select(catalog.Catalog._bucket(F.lit(u).cast("long"))).first()[0]
    other = next(u for u in range(5, 30) if bucket(u) != bucket(20) and u != 20)
    between(other, 77)
    c.replace_users("trips", frame((20, 88)))
    got = dict(everything(c.read("trips")[["user_id", "x"]].where("user_id <> 3")))
    assert got[20] == 88 and got[other] == 77
    between(20, 99)
    with pytest.raises(catalog.ConcurrentWriteError):
        c.replace_users("trips", frame((20, 111)))
    assert c.user("trips", 20).first().x == 99
    c.replace_users("trips", frame((5, 1)).withColumn("more", F.lit("m")))
    assert c.read("trips").where("more is not null").count() == 1 and len(c.snapshots("trips")) == catalog.KEPT_SNAPSHOTS
    c.clear("trips")
    assert c.read("trips").count() == 0 and c.exists("trips") and "more" in c.read("trips").columns


def test_ids_stay_and_grow_without_gaps(spark, tmp_path):
    ids = catalog.Ids(spark, str(tmp_path / "ids"))
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    first = {r.key: r.id for r in ids.assign(names(*[f"u{i}" for i in range(50)], "u3", None), "name").collect()}
    assert sorted(first.values()) == list(range(1, 51))
    again = {r.key: r.id for r in ids.assign(names(*[f"u{i}" for i in range(60)]), "name").collect()}
    assert {k: v for k, v in again.items() if k in first} == first and sorted(again.values()) == list(range(1, 61))
    assert {r.key: r.id for r in ids.assign(names("u1"), "name").collect()} == again
    rows = catalog.with_row_ids(spark.range(1000).withColumnRenamed("id", "x").repartition(7), ["x"], 5)
    got = sorted((r.id, r.x) for r in rows.collect())
    assert [i for i, _ in got] == list(range(5, 1005)) and [x for _, x in got] == list(range(1000))


def test_survey_keeps_ids_and_replaces_trips(spark, tmp_path):
    """A logger survey read twice keeps its users' numbers; saved trips have ids that go on, other users keep theirs."""
    from tripweave.session import Survey

    head = ",".join(csv.LOGGER)
    (tmp_path / "in").mkdir()
    line = lambda n, name: f"{n},24/1/2,3:04:0{n},,,45.{n},N,73.6,W,10,1.5 km/h,{name}"
    write(tmp_path / "in", "coordinates.csv", "\n".join([head, line(1, "ann"), line(2, "bob"), line(3, "ann")]) + "\n")
    write(tmp_path / "in", "locations.csv", "user,label,latitude,longitude\nann,home,45.1,-73.6\n")
    survey = Survey(spark, str(tmp_path / "out"))
    survey.ingest_logger(str(tmp_path / "in"))
    first = {r.key: r.id for r in survey.ids.tables.read("user_ids").collect()}
    write(tmp_path / "in", "coordinates.csv", "\n".join([head, line(1, "zoe"), line(2, "bob"), line(3, "abe")]) + "\n")
    survey.ingest_logger(str(tmp_path / "in"), force=True)
    assert survey.points().count() == 3 and survey.users().count() == 3
    again = {r.key: r.id for r in survey.ids.tables.read("user_ids").collect()}
    assert {k: again[k] for k in first} == first and sorted(again.values()) == [1, 2, 3, 4]

    trips = lambda *rows: spark.createDataFrame(list(rows), "user_id string, trip_num int, seq int")
    survey.save_trips(trips(("a", 1, 1), ("a", 1, 2), ("b", 1, 1)))
    survey.save_trips(trips(("a", 1, 1)))
    rows = sorted(tuple(r) for r in survey.tables.read("detected_trips").select("user_id", "id").collect())
    assert rows == [("a", 4), ("b", 3)]
    assert [r.id for r in survey.load_trips("b").collect()] == [3]
    days = spark.createDataFrame([("b", dt.date(2024, 1, 2), 77, 78), ("b", dt.date(2024, 1, 1), 77, None)], "user_id string, date date, start_point_id long, end_point_id long")
    survey.tables.replace_users("detected_trips", survey.tables.read("detected_trips").withColumn("point_id", F.when(F.col("user_id") == "b", 77)))
    survey.save_days(days)
    assert [(r.date.day, r.start_point_id, r.end_point_id, r.timezone) for r in survey.load_days("b").collect()] == [(1, 3, None, "America/Montreal"), (2, 3, None, "America/Montreal")]
    survey.save_entrances(spark.createDataFrame([(45.5, -73.6), (45.5, -73.6), (45.4, -73.5)], "latitude double, longitude double"))
    stored = survey.load_entrances().orderBy("place_id").collect()
    assert [(r.place_id, r.lat) for r in stored] == [(1, 45.4), (2, 45.5)] and round(stored[1].northing) == 5039450
    assert survey.load_locations().first().label == "home" and survey.load_locations().columns[-2:] == ["easting", "northing"]
    survey.clear_trips(trips(("a", 0, 0)).select("user_id"))
    assert [r.user_id for r in survey.tables.read("detected_trips").collect()] == ["b"]
    survey.clear_trips()
    assert survey.tables.read("detected_trips").count() == 0
    survey.drop()
    assert not survey.tables.exists("coordinates") and survey.tables.exists("user_locations")
    with pytest.raises(RuntimeError):
        survey.users()


def test_csv_and_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", True), ("b", False)], "uuid string, has_trips boolean")
    sinks.csv(df, str(tmp_path / "out"), ["uuid", "has_trips", "start_latitude"], one_file=True)
    back = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert sorted((r.uuid, r.has_trips, r.start_latitude) for r in back) == [("a", "1", None), ("b", "0", None)]
    pts = spark.createDataFrame([(1, 2, 2, -73.6, 45.6), (1, 2, 1, -73.5, 45.5)], "user_id long, trip_num long, seq long, longitude double, latitude double")
    sinks.geojson_lines(sinks.line_features(pts, ["user_id", "trip_num"], []), str(tmp_path / "g"))
    feature = json.loads(spark.read.text(str(tmp_path / "g")).first()[0])
    assert feature["geometry"] == {"type": "LineString", "coordinates": [[-73.5, 45.5], [-73.6, 45.6]]}


def test_map_match_answer_and_polyline(spark):
    answer = {"tracepoints": [{"location": [1.0, 2.0], "name": "a", "matchings_index": 0, "waypoint_index": 0}, None, {"location": [3.0, 4.0], "name": "b", "matchings_index": 0, "waypoint_index": 1}], "matchings": [{"confidence": 0.5, "geometry": "", "legs": [{"weight": 7.0}]}]}
    got = sinks.matched_points(spark.createDataFrame([(1, json.dumps(answer))], "trip_num int, json string")).orderBy("seq").collect()
    assert [(r.seq, r.longitude, r.weight) for r in got] == [(0, 1.0, 0.0), (2, 3.0, 7.0)]
    line = {"matchings": [{"confidence": 0.9, "geometry": "_p~iF~ps|U_ulLnnqC_mqNvxq`@", "legs": [{"weight": 7.0}, {"weight": 2.0}]}]}
    found = sinks.matched_lines(spark.createDataFrame([(1, json.dumps(line))], "trip_num int, json string")).first()
    assert found.line == [[-120.2, 38.5], [-120.95, 40.7], [-126.453, 43.252]] and (found.confidence, found.weight) == (0.9, 9.0)


def test_polyline_round_trip(spark):
    import random

    from tripweave.functions import polyline

    rng = random.Random(3)
    rows = [([(round(rng.uniform(-180, 180), 5), round(rng.uniform(-90, 90), 5)) for _ in range(n)],) for n in (0, 1, 2, 40)] + [([(0.0, 0.0), (0.0, 0.0), (-0.00001, 0.00001)],), (None,)]
    df = spark.createDataFrame(rows, "p array<struct<lon: double, lat: double>>").withColumn("e", polyline.encode(F.col("p")))
    got = df.select("p", "e", polyline.decode(F.col("e")).alias("d")).collect()
    assert all(r.d == r.p for r in got) and got[0].e == "" and got[-1].e is None and got[4].e == "????A@"
    assert spark.range(1).select(polyline.encode(F.expr("array(named_struct('lon', -120.2D, 'lat', 38.5D), named_struct('lon', -120.95D, 'lat', 40.7D))"))).first()[0] == "_p~iF~ps|U_ulLnnqC"
    assert spark.range(1).select(polyline.decode(F.lit("_p~iF~ps|U_ulL"))).first()[0] == [(-120.2, 38.5)]


def test_transforms_by_name(spark):
    from tripweave.functions.sql import Transforms

    known = Transforms()

    @known.add("clean", "short")
    def short(frame, least):
        return frame.where(F.col("id") >= least)

    assert known.run("clean", "short", spark.range(5), least=3).count() == 2 and known.names("clean") == ["short"]
    with pytest.raises(LookupError):
        known.run("clean", "long", spark.range(1))
    with pytest.raises(ValueError):
        known.add("clean", "short")(short)


def test_session_stream_equals_batch_segments(spark, tmp_path):
    from tripweave.streaming.sessions import session_segments

    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for s in (0, 200, 600, 800, 90000)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = session_segments(stream, 300).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n_points for r in spark.table("sessions").collect()) == [2, 2]
    assert spark.createDataFrame(rows, "user_id long, ts timestamp").select(F.count("*")).first()[0] == 5


def test_csv_rows_of_a_phone_diary(spark, tmp_path):
    """Every column of the trip, summary and activity files is filled from the operators' results."""
    from pyspark.sql import functions as F

    from tripweave.operators import activity, days, segment, stitch
    from tripweave.plans import adapters, queries

    d = "/root/testdata/sf0.001"
    points = queries._segments(spark, d)
    diary = stitch.phone_diary(points, adapters.entrances(spark, d), queries._rules(), queries._known(spark, d)).cache()
    rows = sinks.trip_rows(diary, start=7)
    got = rows.orderBy("id").collect()
    want = diary.orderBy("user_id", "trip_num", "seq").collect()
    assert rows.columns == sinks.TRIP_POINTS and [r.id for r in got] == list(range(7, 7 + len(want)))
    assert [(r.trip, r.timestamp_epoch, r.latitude) for r in got] == [(r.trip_num, r.t, r.lat) for r in want]
    assert all((r.h_accuracy == -1) == (r.trip_code in (101, 102, 104)) and r.h_accuracy is not None for r in got)
    summaries = stitch.diary_summaries(diary, "America/Montreal").cache()
    codes = {r.merge_codes for r in sinks.summary_rows(summaries).select("merge_codes").collect()}
    assert {"walking", "too short", None} <= codes and sinks.summary_rows(summaries).columns == sinks.TRIP_SUMMARIES and summaries.count() == diary.select("user_id", "trip_num").distinct().count()
    for r in summaries.limit(20).collect():
        own = [x for x in want if (x.user_id, x.trip_num) == (r.user_id, r.trip_id)]
        assert (r.olat, r.dlon, r.cumulative_distance, r.trip_code) == (own[0].lat, own[-1].lon, own[-1].trip_distance, own[0].trip_code)
    places = queries._places(spark, d)
    local_days = summaries.select("user_id", F.to_date("start").alias("date")).distinct().withColumn("is_complete", F.lit(True))
    condensed = sinks.condensed_trip_rows(summaries, local_days, places, 400.0)
    assert condensed.columns == sinks.CONDENSED_TRIPS and condensed.count() == summaries.count() and condensed.where("not complete_day").count() == 0
    spans, labelled = queries._spans(spark, d)
    complete = days.complete_days(queries._day_trips(spark, d))
    sinks.banner_csv(sinks.activity_rows(activity.condensed(spans, complete), summaries), str(tmp_path / "a"), sinks.ACTIVITY_SUMMARIES, [["Survey timezone:", "America/Montreal"]])
    sinks.banner_csv(sinks.daily_rows(activity.daily(spans, labelled, "America/Montreal"), labelled, "America/Montreal", ["dwell_home_s"]), str(tmp_path / "b"), [*sinks.ACTIVITIES_DAILY, "dwell_home_s"], [["Survey timezone:", "America/Montreal"]])
    sinks.banner_csv(sinks.location_rows(places), str(tmp_path / "c"), sinks.ACTIVITY_LOCATIONS, [["Activity Locations"]])
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert "Activity Locations" in lines and "UUID,Label,Latitude,Longitude" in lines and len(lines) == places.count() + 2
    assert spark.read.text(str(tmp_path / "a")).where("value like 'Survey timezone:,%'").count() == 1 and spark.read.text(str(tmp_path / "b")).count() > 2
    assert segment.summaries(points).count() >= summaries.where("trip_code not in (101, 102, 104)").count()
    plan = diary._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) < 300
    diary.unpersist()
    summaries.unpersist()
