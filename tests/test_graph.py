"""From archives to a graph: a small world of two feeds, and each step's odd cases."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from quayside.operators import calendar, feeds, graph, reach, resolve
from quayside.sources import gtfs, sinks

DAY = datetime.date(2026, 9, 8)  # a Tuesday
NEXT = datetime.date(2026, 9, 9)
WEEK = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"


@pytest.fixture
def world(tmp_path):
    def put(name, **members):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for member, text in members.items():
                z.writestr(f"{member}.txt", text)

    put(
        "north",
        agency="agency_id,agency_name,agency_timezone\n1,N,Europe/Copenhagen\n2,M,Europe/London\n",
        stops="stop_id,stop_name,stop_lat,stop_lon,parent_station\nh,Havn,55.0,9.0,\nh1,Havn spor 1,55.0,9.0,h\nm,Mitte,54.0,9.5,\nst,Stub Stadt,0,0,\nlost,Nowhere Else,,,\n",
        routes="route_id,route_short_name,route_long_name\nr1,EC 7,Havn - Mitte\nr2,Bus 4,\nr3,,Nachtzug\n",
        trips="route_id,service_id,trip_id,trip_short_name,trip_headsign\nr1,all,t1,,\nr2,all,t2,,\nr3,sat,t3,,\nr1,off,t4,,\n",
        stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,10:00:00,10:01:00,m,20\nt1,08:00:00,08:00:00,h1,5\nt1,,,h,7\nt1,12:00:30,,st,30\nt2,09:00:00,09:00:00,h,1\nt2,09:30:00,09:30:00,m,2\nt3,21:00:00,21:00:00,h,1\nt3,23:00:00,23:00:00,m,2\nt4,06:00:00,06:00:00,h,1\nt4,07:00:00,07:00:00,m,2\n",
        calendar=WEEK + "all,1,1,1,1,1,1,1,20260901,20260930\nsat,0,0,0,0,0,1,0,20260901,20260930\noff,0,1,0,0,0,0,0,20260901,20260930\n",
        calendar_dates=f"service_id,date,exception_type\noff,{DAY:%Y%m%d},2\n",
    )
    put(
        "south",
        agency="agency_id,agency_name,agency_timezone\n9,S,Europe/London\n",
        stops="stop_id,stop_name,stop_lat,stop_lon,parent_station\nm,S+U Mitte Bahnhof,54.001,9.5,\nst,Stub Stadt,53.0,9.9,\nz,Ziel,52.0,10.0,\n",
        routes="route_id,route_short_name,route_long_name\nr1,IC,\n",
        # equal ids as in the other feed; a name for each trip
        trips="route_id,service_id,trip_id,trip_short_name,trip_headsign\nr1,all,t1,EC 7,\nr1,all,t9,local,\n",
        stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,11:02:00,11:20:00,st,1\nt1,12:30:00,12:30:00,z,2\nt9,05:00:00,05:00:00,st,1\nt9,06:00:00,06:00:00,z,2\n",
        calendar=WEEK + "all,0,1,0,0,0,0,0,20260908,20260908\noff,1,1,1,1,1,1,1,20260908,20260908\n",
    )
    conf = {"feeds": {"north": {"country": "DK", "route_allow": ["^EC", "zug$"]}, "south": {"country": "DE", "route_allow": ["^IC"], "trip_allow": ["^EC \\d"]}}}
    return f"file://{tmp_path}/*.zip", graph.configured(conf)


def test_two_feeds_to_journeys(spark, world, tmp_path):
    path, conf = world
    g = graph.build(spark, path, conf, [DAY, NEXT])
    stations = {r.id: (r.name, r.country) for r in g.stations.collect()}
    # the shortest of its own and its used platforms' names; a twin by name within reach; a stub takes the other feed's place
    assert stations == {"x:north:h": ("Havn", "DK"), "x:north:m": ("Mitte", "DK"), "x:south:st": ("Stub Stadt", "DE"), "x:south:z": ("Ziel", "DE")}
    trips = {(r.day, r.trip_id): (r.train, r.feeds) for r in g.trips.collect()}
    # one service in two feeds, joined at the border; the one of Saturdays is kept apart; of Wednesdays one feed knows nothing
    assert trips == {(str(DAY), "t1+t1"): ("EC 7", ["north", "south"]), (str(NEXT), "t1"): ("EC 7", ["north"]), ("extra", "t3"): ("Nachtzug", ["north"]), ("extra", "t4"): ("EC 7", ["north"])}
    calls = [(r.station, r.arr, r.dep) for r in g.calls.filter(f"day = '{DAY}'").orderBy("idx").collect()]
    # the other feed's clock is an hour behind; at the border the first's arrival and the second's departure
    assert calls == [("x:north:h", 480, 480), ("x:north:m", 600, 601), ("x:south:st", 720, 740), ("x:south:z", 810, 810)]
    valid = {(r.day, r.feed): (r.covered, r.sampled) for r in g.validity.collect()}
    assert valid == {(str(DAY), "north"): (True, True), (str(NEXT), "north"): (True, True), (str(DAY), "south"): (True, True), (str(NEXT), "south"): (False, False)}
    # stops that no station was found for, and what isn't known of it
    assert {(r.feed, r.stop_id) for r in g.unmapped.collect()} <= {("north", "lost")}
    found = reach.journeys(g.calls.filter(f"day = '{DAY}'").drop("day").withColumn("trip_id", F.col("trip_ord")), g.stations.select(F.col("id").alias("origin"))).collect()
    assert {(r.origin, r.dest, r.trains, r.duration) for r in found if r.origin == "x:north:h"} == {("x:north:h", "x:north:m", 1, 120), ("x:north:h", "x:south:st", 1, 240), ("x:north:h", "x:south:z", 1, 330)}
    graph.write(g, f"file://{tmp_path}/graph")
    assert sinks.read_graph(spark, f"file://{tmp_path}/graph/calls").count() == g.calls.count()


def test_a_graph_that_goes_back_in_time_is_refused(spark, world, tmp_path):
    stations = spark.createDataFrame([("a", 0.001, -0.009), ("b", 0.02, 0.0)], "id string, lat double, lon double")
    calls = spark.createDataFrame([("1", 1, 5, 9), ("1", 2, 8, 8), ("2", 1, 1, 1), ("2", 2, 1, 1)], "trip_id string, idx int, arr int, dep int")
    assert {tuple(r) for r in feeds.problems(stations, calls).collect()} == {("near zero", "a"), ("times go back", "1")}
    with pytest.raises(feeds.InvalidGraph, match="near zero: a; times go back: 1"):
        feeds.validated(stations, calls)
    feeds.validated(stations.filter("id = 'b'"), calls.filter("trip_id = '2'"))


def test_services_of_equal_id_stay_their_feeds_own(spark):
    rows = [("a", "s", 127, DAY, DAY), ("b", "s", 127, DAY, DAY)]
    cal = spark.createDataFrame(rows, "feed string, service_id string, days int, start_date date, end_date date")
    exc = spark.createDataFrame([("b", "s", DAY, False, datetime.datetime(2026, 1, 1), 0)], "feed string, service_id string, date date, is_add boolean, ts timestamp, row_order long")
    days = spark.createDataFrame([(DAY,)], "date date")
    running = calendar.active(cal, exc, days)
    assert [(r.feed, r.service_id) for r in running.collect()] == [("a", "s")]
    assert [(r.feed, r.service_id) for r in calendar.absent(cal, exc, running).collect()] == [("b", "s")]


def test_parents_of_any_depth_and_in_circles(spark):
    rows = [("f", str(k), str(k - 1) if k else "") for k in range(51)] + [("f", "a", "b"), ("f", "b", "c"), ("f", "c", "a"), ("f", "tail", "a"), ("f", "child", "gone"), ("f", "own", "own"), ("g", "1", "2"), ("g", "2", "")]
    got = {(r.feed, r.stop_id): r.station for r in feeds.topmost(spark.createDataFrame(rows, "feed string, stop_id string, parent string")).collect()}
    assert all(got["f", str(k)] == "0" for k in range(51)) and len(got) == len(rows)
    # the walk ends before it would come back
    assert [got["f", k] for k in ("a", "b", "c", "tail", "child", "own")] == ["c", "a", "b", "c", "child", "own"]
    assert got["g", "1"] == got["g", "2"] == "2"


def test_unknown_zones_count_as_the_reference_clock(spark):
    rows = spark.createDataFrame([("a", "Europe/London", 1), ("a", "Nowhere/X", 0), ("b", None, 0), ("c", "", 0), ("d", "Europe/Lisbon", 3), ("d", "Asia/Tokyo", 9)], "feed string, agency_timezone string, row_order long")
    assert {r.feed: r["shift"] for r in feeds.feed_shifts(rows).collect()} == {"a": 0, "b": 0, "c": 0, "d": 60}


def test_brands_and_stop_patterns_see_raw_ids(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        for name, text in {
            "stops": "stop_id,stop_name,stop_lat,stop_lon,parent_station\nBlue-1,Eins,50,8,one\none,Eins,50,8,\ntwo,Zwei,51,8,\n",
            "routes": "route_id,route_short_name,route_long_name\nr,X1,\n",
            "trips": "route_id,service_id,trip_id,trip_short_name,trip_headsign\nr,s,t1,,Zwei\nr,s,t2,,\nr,s,t3,,Zwei\n",
            "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"{t},10:00:00,10:00:00,{a},1\n{t},11:00:00,11:00:00,two,2\n" for t, a in (("t1", "Blue-1"), ("t2", "Blue-1"), ("t3", "one"))),
            "calendar": WEEK + "s,1,1,1,1,1,1,1,20260901,20260930\n",
        }.items():
            z.writestr(f"{name}.txt", text)
    conf = graph.configured({"feeds": {"n": {"country": "DE", "route_allow": ["X"], "stop_id_brand": {"^Blue-": "Blue"}}}})
    members = graph.scan(spark, f"file://{tmp_path}/n.zip", conf)
    services, _ = graph.running(members, [DAY])
    trips, calls = graph.body(members, conf, services)
    assert {(r.trip_id, r.train) for r in trips.collect()} == {("t1", "Blue Zwei"), ("t2", "X1")}
    assert {(r.raw_id, r.stop_id) for r in calls.collect()} == {("Blue-1", "one"), ("two", "two")}
    assert calls.count() == 4 and gtfs.MEMBERS["stops"]


def test_empty_feed_has_an_empty_graph(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("routes.txt", "route_id,route_short_name\nr,EC 1\n")
    g = graph.build(spark, f"file://{tmp_path}/e.zip", graph.configured({"feeds": {"e": {"country": "DE", "route_allow": ["EC"]}}}), [DAY])
    assert g.stations.count() == g.calls.count() == g.trips.count() == 0


def test_names_are_given_by_id_or_by_stop(spark):
    stations = spark.createDataFrame([("1", "Alt", 50.0, 8.0), ("2", "Hauptbahnhof", 50.0, 9.0), ("3", "Hauptbahnhof", 53.0, 9.0)], "id string, name string, lat double, lon double")
    stops = spark.createDataFrame([(1, "f", "a", "Alt"), (2, "f", "b", "Hauptbahnhof"), (3, "f", "c", "Hauptbahnhof")], "ord long, feed string, stop_id string, name string")
    mapping = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("f", "c", "3")], "feed string, stop_id string, station string")
    out, issues = resolve.renamed(stations, {"1": "Neu", "f@Hbf~53.001,9.0": "Nord Hbf", "f@Hauptbahnhof": "Erste", "9": "Nobody"}, mapping, stops)
    assert {r.id: r.name for r in out.collect()} == {"1": "Neu", "2": "Erste", "3": "Nord Hbf"}
    assert {r.detail for r in issues.collect()} == {"name of 'f@Hauptbahnhof' is ambiguous: 2, 3", "name of '9' matches no station"}
