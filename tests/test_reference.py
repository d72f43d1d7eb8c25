"""Every query with SQL against DuckDB, and small worlds with known answers."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quayside.functions import text
from quayside.operators import reach, resolve
from quayside.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(SF + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = c.execute(registry.SQL[name])
    cols = [x[0] for x in cur.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(cols, r))) for r in cur.fetchall())
    df = registry.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    assert sorted(cols) == sorted(df.columns)
    assert got == want


CALLS = "trip_id long, idx int, station long, arr long, dep long"


def test_two_feed_world(spark):
    rows = [(1, 1, 1, 480, 480), (1, 2, 2, 540, 542), (1, 3, 3, 600, 600), (2, 1, 1, 720, 720), (2, 2, 2, 770, 770), (3, 1, 2, 545, 545), (3, 2, 3, 605, 605), (4, 1, 3, 630, 630), (4, 2, 4, 720, 720)]
    calls = spark.createDataFrame(rows, CALLS)
    got = {tuple(r) for r in reach.journeys(calls, spark.createDataFrame([(1,), (2,), (4,)], "origin long")).select("origin", "dest", "trains", "duration").collect()}
    assert {(1, 2, 1, 50), (1, 3, 1, 120), (1, 4, 2, 240), (2, 3, 1, 58)} <= got
    assert not any(o == 4 for o, *_ in got)


def test_transfer_is_inclusive_and_footpath_needs_a_train(spark):
    calls = spark.createDataFrame([(1, 1, 1, 480, 480), (1, 2, 2, 600, 600), (2, 1, 2, 610, 610), (2, 2, 3, 700, 700), (3, 1, 9, 620, 620), (3, 2, 4, 690, 690)], CALLS)
    paths = spark.createDataFrame([(2, 9, 20, "metro", 0), (1, 9, 1, "walk", 1)], "a long, b long, minutes int, mode string, ord long")
    got = {(r.dest, r.trains) for r in reach.journeys(calls, spark.createDataFrame([(1,)], "origin long"), paths).collect()}
    assert got == {(2, 1), (3, 2), (4, 2)}


def test_chain_of_near_stops_is_not_one_station(spark):
    rows = [(1, "a", "X", 50.0, 8.0), (2, "b", "X", 50.004, 8.0), (3, "c", "X", 50.008, 8.0)]
    got = {r.ord: r.canonical for r in resolve.merge_in_order(spark.createDataFrame(rows, "ord long, stop_id string, name string, lat double, lon double")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_names_and_codes(spark):
    df = spark.createDataFrame([("S+U München Hauptbahnhof", "12345678:7654321"), ("Łódź Ostbahnhof", "de:1234567:1"), ("Bahnhof", "x")], "n string, c string")
    rows = df.select(text.merge_name(F.col("n")), text.code_of(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("munchenhbf", None), ("lodzost", "1234567"), ("bahnhof", None)]


def test_every_station_is_an_origin(spark):
    sf = "/root/testdata/sf0.01"
    calls = [tuple(r) for r in registry.june(spark, sf).select("trip_id", "idx", "station", "arr", "dep").collect()]
    trips, deps = {}, {}
    for t, i, s, a, d in sorted(calls):
        trips.setdefault(t, []).append((s, a, d))
        deps.setdefault(s, []).append(d)
    walks = [(x, y, r.minutes) for r in registry.tt.footpaths(spark, sf).collect() for x, y in ((r.a, r.b), (r.b, r.a))]
    want = set()
    for origin in (r.id for r in registry.tt.stations(spark, sf).collect()):
        # floors with the same next departure count once, as the least
        floors = {}
        for f in reach.FLOORS:
            if nxt := [d for d in deps.get(origin, ()) if d >= f]:
                floors.setdefault(min(nxt), f)
        for floor in floors.values():
            best, ready = {}, {origin: floor}
            for _ in range(reach.ROUNDS):
                got = dict(best)
                for stops in trips.values():
                    on = False
                    for s, a, d in stops:
                        if on and s != origin:
                            got[s] = min(a, got.get(s, a))
                        on = on or ready.get(s, d + 1) <= d
                best = got
                ready = {s: a + reach.TRANSFER for s, a in best.items()}
                for x, y, m in walks:
                    if x in best:
                        ready[y] = min(ready.get(y, best[x] + m), best[x] + m)
                ready[origin] = floor
            want |= {(origin, floor, s, a) for s, a in best.items()}
    got = {tuple(r) for r in registry.QUERIES["reach_round3"](spark, sf).select("origin", "floor", "station", "arr").collect()}
    assert got == want and max(r[0] for r in got) >= 10


def test_queries_take_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    table, run = lambda n: registry.tt.table(spark, sf, n), lambda n: registry.QUERIES[n](spark, sf)
    assert registry.tt.raw_stops(spark, sf).count() == table("supplier").count() + table("customer").count()
    members = {r.ord: r.rep for r in run("place_members").collect()}
    assert len(members) == table("supplier").count() + table("customer").count() and any(r.a % 2 and r.b % 2 for r in run("proximity_pairs").collect())
    assert run("overlap_rank").count() == table("supplier").count()
    nations = {r.n_nationkey: r.n_name for r in table("nation").collect()}
    lived = {nations[r.c_nationkey] for r in table("customer").collect()}
    assert all(r.covered == (r.country in lived) for r in run("coverage_sets").collect())
    assert run("service_week_dates").select("anchor").distinct().count() == table("orders").select(F.to_date("o_orderdate")).distinct().count()


def test_through_and_daily_queries_take_all_dates(spark):
    run = lambda n: registry.QUERIES[n](spark, SF)
    calls, trips = {}, {r.trip_id: r.train for r in registry.tt.trips(spark, SF).collect()}
    for r in registry.tt.stop_times(spark, SF).orderBy("trip_id", "idx").collect():
        calls.setdefault(r.trip_id, []).append(r)
    own = [t for t, label in trips.items() if any(c.isdigit() for c in label) and len(calls[t]) >= 2]
    starts = {}
    for t in own:
        starts.setdefault((trips[t], calls[t][0].station), []).append(t)
    want = set()
    for a in own:
        x = calls[a]
        for b in starts.get((trips[a], x[-1].station), ()):
            y = calls[b]
            if a != b and 0 <= y[0].dep - x[-1].arr <= 60 and not {c.station for c in x[:-1]} & {c.station for c in y[1:]}:
                want.add((a, b))
    assert {(r.a, r.b) for r in run("through_candidates").collect()} == want
    joined = [int(t) for r in run("through_join").collect() for t in r.members.split("+")]
    assert sorted(joined) == sorted(own)
    least, rides = {}, 0
    for x in calls.values():
        first = {}
        for c in x:
            first.setdefault(c.station, c)
        found = {}
        for s, c in first.items():
            for d in x:
                if d.idx > c.idx and d.station != s:
                    found[s, d.station] = min(d.arr - c.dep, found.get((s, d.station), d.arr - c.dep))
        rides += len(found)
        for k, v in found.items():
            least[k] = min(v, least.get(k, v))
    assert {(r.origin, r.dest): r.duration for r in run("best_journeys_across_days").collect()} == least
    summary = run("frequency_summary").collect()
    assert {(r.origin, r.dest) for r in summary} == set(least) and sum(r.direct_trips for r in summary) == rides


def test_frequency_is_not_taken_over_pairs_by_weeks(spark, monkeypatch):
    given, summary = [], registry.frequency.summary
    monkeypatch.setattr(registry.frequency, "summary", lambda rows, *more: given.append(rows) or summary(rows, *more))
    out = registry.frequency_summary(spark, SF)
    assert given[0].count() <= out.agg(F.sum("direct_trips")).first()[0]  # no row without a ride
