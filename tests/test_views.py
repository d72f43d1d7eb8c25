"""Destinations over days, local clocks, and what readers derive, on small worlds with known answers."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quayside.operators import client, frequency, reach, views
from quayside.streaming import events


def test_destinations_over_days_with_an_extra_one(spark):
    days = ["2026-09-07", "2026-09-08", "2026-09-09"]
    journeys = spark.createDataFrame([(days[0], 1, 2, 1, 60, ["f"]), (days[1], 1, 2, 1, 50, ["f"]), (days[1], 1, 2, 2, 40, ["f", "g"]), ("extra", 1, 2, 1, 45, ["f"]), ("extra", 1, 3, 2, 90, ["g"])], "day string, origin long, dest long, trains int, duration long, feeds array<string>")
    evidence = spark.createDataFrame([(days[0], 1, 10, 480, 2, 540, None, None), (days[0], 1, 11, 480, 2, 545, None, None), (days[1], 1, 12, 500, 2, 550, None, None), (days[2], 1, 13, 500, 2, None, 600, None)], "day string, origin long, trip long, departure long, dest long, arr1 long, arr2 long, arr3 long")
    valid = spark.createDataFrame([(d, f, d != days[2] or f == "g", True) for d in days for f in "fg"], "day string, feed string, covered boolean, sampled boolean")
    rows = {r.id: r for r in frequency.destinations(journeys, evidence, reach.useful(evidence), days, valid).collect()}
    two, three = rows[2], rows[3]
    assert [tuple(j) for j in two.journeys] == [(1, 45, "extra"), (2, 40, days[1])] and [tuple(j) for j in three.journeys] == [(2, 90, "extra")]
    f = two.frequency
    # a day counts if all feeds of some journey cover it; directs of all days count
    assert (f.requested_sample_days, f.sample_days, f.available_days, f.direct_days, f.direct_trips) == (3, 2, 2, 2, 3)
    assert (f.direct_per_active_day, f.weekly_direct_estimate, f.availability, f.active_months, two.direct_per_day) == (1.5, 10, "coverage_limited", ["Sep"], 2)
    assert (three.frequency.sample_days, three.frequency.available_days, three.frequency.availability, three.histogram_by_trains, three.direct_per_day) == (3, 0, "limited", None, 0)
    h = two.histogram_by_trains
    # the third tier is like the second
    assert set(h) == {"1", "2"} and h["1"][days[0]][8] == 2 and h["2"][days[2]][8] == 1 and sum(h["1"][days[2]]) == 0


def test_months_are_named_in_the_order_of_their_days(spark):
    rows = [(1, 2, datetime.date(2025, 12, 30), True, 1, 1), (1, 2, datetime.date(2026, 1, 2), True, 1, 0), (1, 2, datetime.date(2026, 2, 2), False, 1, 1), (1, 2, datetime.date(2026, 4, 2), True, 0, 0)]
    got = frequency.summary(spark.createDataFrame(rows, "origin int, dest int, day date, covered boolean, journeys long, directs long")).first()
    assert (got.months, got.covered_days, got.active_days, got.direct_trips, got.requested_sample_days) == ("Dec,Jan", 3, 2, 2, 4)


def test_days_without_journeys_may_be_left_out(spark):
    asked = [(datetime.date(2025, 12, 30), True), (datetime.date(2026, 1, 2), True), (datetime.date(2026, 2, 2), False), (datetime.date(2026, 12, 29), True), (datetime.date(2026, 12, 30), True)]
    held = {(1, 2): [1, 1, 2, 1, 0], (1, 3): [0, 0, 1, 0, 0], (2, 1): [1, 1, 1, 1, 1]}
    every = [(*k, *day, n, n) for k, counts in held.items() for day, n in zip(asked, counts, strict=True)]
    whole = frequency.summary(spark.createDataFrame(every, "origin int, dest int, day date, covered boolean, journeys long, directs long"))
    few = spark.createDataFrame([(*r[:3], *r[4:]) for r in every if r[-1]], "origin int, dest int, day date, journeys long, directs long")
    got = frequency.summary(few, spark.createDataFrame(asked, "day date, covered boolean"))
    assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    by = {(r.origin, r.dest): (r.requested_sample_days, r.covered_days, r.active_days, r.direct_trips, r.months, r.availability) for r in got.collect()}
    assert by == {(1, 2): (5, 4, 3, 5, "Dec,Jan", "limited"), (1, 3): (5, 4, 0, 1, "", "limited"), (2, 1): (5, 4, 4, 5, "Dec,Jan", "year_round")}


CALLS = "day string, trip_id long, idx int, station long, arr long, dep long"


def test_days_never_share_a_journey(spark):
    calls = spark.createDataFrame([("a", 1, 1, 1, 480, 480), ("a", 1, 2, 2, 500, 500), ("b", 2, 1, 2, 520, 520), ("b", 2, 2, 3, 600, 600), ("b", 1, 1, 1, 480, 480), ("b", 1, 2, 2, 505, 505)], CALLS)
    origins = spark.createDataFrame([(1,)], "origin long")
    got = {tuple(r) for r in reach.journeys(calls, origins).select("day", "origin", "dest", "trains", "duration").collect()}
    assert got == {("a", 1, 2, 1, 20), ("b", 1, 2, 1, 25), ("b", 1, 3, 2, 120)}
    seen = {(r.day, r.dest, r.arr1, r.arr2) for r in reach.evidence(calls, origins).collect()}
    assert seen == {("a", 2, 500, 500), ("b", 2, 505, 505), ("b", 3, None, 600)}


def test_floors_and_times_are_local(spark):
    stations = spark.createDataFrame([(1, "PT"), (2, "DE"), (3, None), (4, "FI")], "id long, country string")
    offsets = reach.local_offsets(stations)
    assert {tuple(r) for r in offsets.collect()} == {(1, -60), (4, 60)}
    calls = spark.createDataFrame([("a", 1, 1, 1, 320, 320), ("a", 1, 2, 5, 330, 331), ("a", 1, 3, 2, 360, 360), ("a", 2, 1, 9, 380, 380), ("a", 2, 2, 4, 400, 400)], CALLS).drop("day")
    origins = spark.createDataFrame([(1, -60)], "origin long, offset int")
    # five o'clock there is six on the reference clock
    assert reach.departure_floors(calls, origins).count() == 0
    origins = spark.createDataFrame([(1,)], "origin long")
    paths = spark.createDataFrame([(2, 9, 15, "metro", 0)], "a long, b long, minutes int, mode string, ord long")
    labels = reach.rounds(calls, reach.departure_floors(calls, origins), paths)
    trips = spark.createDataFrame([(1, "IC 1", ["f"]), (2, "RE", ["g"])], "trip_id long, train string, feeds array<string>")
    legs = reach.legs(labels, reach.best_journeys(labels))
    rows = reach.displayed(legs, calls, trips, paths, offsets).filter("dest = 4").orderBy("pos").collect()
    assert [(r.type, r.train, r.dep, r.arr, r.from_id, r.to_id, r.via, r.mode, r.minutes) for r in rows] == [("train", "IC 1", "04:20", "06:00", 1, 2, [5], None, None), ("transfer", None, None, None, 2, 9, None, "metro", 15), ("train", "RE", "06:20", "07:40", 9, 4, [], None, None)]


def test_histograms_and_dayparts(spark):
    zero, bins = [0] * 24, [1] + [0] * 10 + [2] + [0] * 11 + [3]
    rows = spark.createDataFrame([(1, {"1": {"2026-09-07": bins}, "3": {"2026-09-08": zero}}), (2, {"2": {"2026-09-07": bins[:5]}}), (3, {"2": {}}), (4, None)], "id int, h map<string, map<string, array<long>>>")
    at = lambda n: {r.id: r.x for r in rows.select("id", client.tier_or_below(F.col("h"), F.lit(n)).alias("x")).collect()}
    assert at(2) == {1: {"2026-09-07": bins}, 2: {"2026-09-07": bins[:5]}, 3: {}, 4: None} and at(1)[2] is None and at(3)[1] == {"2026-09-08": zero}
    parts = {r.id: r.x for r in rows.select("id", client.dayparts(client.tier_or_below(F.col("h"), F.lit(2))).alias("x")).collect()}
    assert [tuple(p) for p in parts[1]] == [("2026-09-07", "Mon", 3, 0, 3)] and parts[2] is parts[3] is parts[4] is None


def test_city_union_keeps_whole_rows(spark):
    rows = spark.createDataFrame([(0, 1, 9, 2, 100, "x"), (1, 2, 9, 1, 300, "y"), (0, 1, 8, None, None, "none"), (1, 2, 8, 3, 500, "z"), (0, 1, 7, 1, 60, "p"), (1, 2, 7, 1, 60, "q")], "reach_ord int, origin int, dest int, trains int, duration int, more string")
    assert {tuple(r) for r in views.city_union(rows).collect()} == {(9, 2, 1, 300, "y"), (8, 2, 3, 500, "z"), (7, 1, 1, 60, "p")}


def plain_ride(paths, ms):
    """Place on a ride in plain code."""
    km = lambda a, b: math.hypot((b[0] - a[0]) * 111.32 * math.cos(math.radians((a[1] + b[1]) / 2)), (b[1] - a[1]) * 111.32)
    lengths = [sum(km(a, b) for a, b in zip(p, p[1:])) for p in paths]
    spans = [(7000 * n / sum(lengths), 1000 if k == len(paths) - 1 else 500) for k, n in enumerate(lengths)]
    t = ms % sum(a + b for a, b in spans)
    for path, n, (move, stand) in zip(paths, lengths, spans):
        if t < move:
            f = t / move
            left = f * f * (3 - 2 * f) * n
            for a, b in zip(path, path[1:]):
                if left <= km(a, b):
                    return a[0] + (b[0] - a[0]) * left / km(a, b), a[1] + (b[1] - a[1]) * left / km(a, b), True
                left -= km(a, b)
        t -= move
        if t < stand:
            return (*path[-1], False)
        t -= stand


def test_ride(spark):
    paths = [[(8.0, 50.0), (8.5, 50.5), (9.0, 50.2)], [(9.0, 50.2), (9.0, 51.0)]]
    schema = "journey int, leg int, path array<struct<lon: double, lat: double>>"
    phases = client.ride_phases(spark.createDataFrame([(1, k + 1, p) for k, p in enumerate(paths)] + [(2, 1, [(1.0, 1.0)]), (3, 1, [(1.0, 1.0), (1.0, 1.0)])], schema))
    assert [(r.journey, r.pos, r.kind) for r in phases.orderBy("journey", "pos").collect()] == [(1, 0, "move"), (1, 1, "dwell"), (1, 2, "move"), (1, 3, "dwell")]
    times = [0, 100, 1500, 2500, 3777, 4300, 5000, 7400, 8400, 8600, 12_345, -100]
    got = {r.ms: r for r in client.ride_at(phases, spark.createDataFrame([(1, t) for t in times], "journey int, ms int")).collect()}
    for t in times:
        lon, lat, moving = plain_ride(paths, t)
        assert (got[t].lon, got[t].lat, got[t].moving) == (pytest.approx(lon), pytest.approx(lat), moving)
    assert got[8400].bearing == pytest.approx(0.0) and 30 < got[100].bearing < 34


def test_headings_turn_the_shorter_way(spark):
    rows = spark.createDataFrame([(None, -10.0, 5.0), (350.0, 10.0, 1e9), (10.0, 350.0, 140.0)], "b double, t double, ms double")
    got = [r[0] for r in rows.select(client.smoothed_bearing(F.col("b"), F.col("t"), F.col("ms"))).collect()]
    assert got == [350.0, pytest.approx(10.0), pytest.approx(350 + 20 * math.exp(-1))]


def test_feature_collections(spark):
    rows = spark.createDataFrame([(2, "B", 1.0, 2.0), (1, "A", 3.0, 4.0)], "id int, name string, lon double, lat double")
    got = client.feature_collection(rows, "Point", F.array("lon", "lat"), F.col("id"), ["name"]).first().value
    assert got == '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[3.0,4.0]},"properties":{"id":"1","name":"A"}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"id":"2","name":"B"}}]}'


def test_hop_points_follow_the_way_of_travel(spark):
    rows = spark.createDataFrame([("a", "b", [(0.0, 0.0), (1.0, 1.0)]), ("b", "a", [(0.0, 0.0), (1.0, 1.0)]), ("b", "a", [])], "a string, b string, c array<struct<lon: double, lat: double>>")
    place = lambda x: F.struct(F.lit(x).alias("lon"), F.lit(x).alias("lat"))
    got = [[tuple(p) for p in r[0]] for r in rows.select(client.hop_points(F.col("a"), F.col("b"), F.col("c"), place(7.0), place(8.0))).collect()]
    assert got == [[(0.0, 0.0), (1.0, 1.0)], [(1.0, 1.0), (0.0, 0.0)], [(7.0, 7.0), (8.0, 8.0)]]


def test_curves_leave_and_reach_their_stations(spark):
    stations = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.0, 9.0), (3, 50.0, 10.0), (4, 51.0, 9.0)], "id long, lat double, lon double")
    hops = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 2), (2, 2, 3), (3, 2, 4)], "trip_id long, a long, b long")
    got = {r.hop: r.points for r in views.curves(hops, stations).collect()}
    assert set(got) == {"1|2", "2|3", "2|4"} and all(8 <= len(p) <= 40 for p in got.values())
    at = {r.id: (r.lon, r.lat) for r in stations.collect()}
    for hop, p in got.items():
        a, b = hop.split("|")
        assert (tuple(p[0]), tuple(p[-1])) == (at[int(a)], at[int(b)])
    # the heaviest way through is straight
    assert all(x.lat == pytest.approx(50.0) for h in ("1|2", "2|3") for x in got[h])
    assert abs(got["2|4"][1].lon - 9.0) > 0.05


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    folder = f"file://{tmp_path}/events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = events.stream(spark, folder, batch.schema, late="1000 days")
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r.hour, r.event_type, r.n) for r in df.collect())
    assert rows(spark.table("hourly")) == rows(events.hourly(batch))
