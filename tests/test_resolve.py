"""Stations, aliases, through services, countries and catalogues on small and on random worlds."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.functions import text
from quayside.operators import resolve
from quayside.plans import registry

SMALL = "/root/testdata/sf0.001"
STOPS = "ord long, feed string, stop_id string, name string, code string, country string, lat double, lon double"


def merged(spark, rows, aliases=None, order=("a", "b", "c")):
    df = spark.createDataFrame([(k, f, i, n, c, f.upper(), y, x) for k, (f, i, n, c, y, x) in enumerate(rows)], STOPS)
    stations, mapping, issues = resolve.merge_stations(df, resolve.Aliases(aliases or {}), {f: k for k, f in enumerate(order)})
    return {r.id: r.name for r in stations.collect()}, {(r.feed, r.stop_id): r.station for r in mapping.collect()}, {r.detail for r in issues.collect()}


def test_codes_twins_and_new_stations(spark):
    rows = [("a", "1", "Köln Hbf", "8000207", 50.94, 6.95), ("b", "1", "Koeln", "8000207", 51.5, 7.5), ("b", "2", "Köln Hauptbahnhof", None, 50.941, 6.951), ("b", "3", "Köln Hbf", "7777777", 50.942, 6.95), ("c", "9", "Anywhere", "7777777", 40.0, 0.0), ("c", "8", "Köln Hbf", None, 51.2, 6.95)]
    stations, mapping, issues = merged(spark, rows)
    # a known code wins over place; an unknown code takes a twin and then stands for it; beyond reach it is a new station
    assert mapping == {("a", "1"): "8000207", ("b", "1"): "8000207", ("b", "2"): "8000207", ("b", "3"): "8000207", ("c", "9"): "8000207", ("c", "8"): "x:c:8"}
    assert stations == {"8000207": "Köln Hbf", "x:c:8": "Köln Hbf"} and not issues


def test_aliases_of_all_kinds(spark):
    rows = [("a", "1", "Basel SBB", None, 47.55, 7.59), ("a", "2", "Hauptbahnhof", None, 50.0, 8.0), ("a", "3", "Hauptbahnhof", None, 53.0, 8.0), ("b", "1", "Bâle", None, 47.56, 7.60), ("b", "2", "Central", None, 53.001, 8.0), ("b", "3", "Gare", None, 10.0, 10.0), ("b", "4", "Old", None, 50.001, 8.0), ("b", "5", "Odd", None, 1.0, 1.0), ("c", "1", "Hauptbahnhof", None, 50.002, 8.0)]
    aliases = {"b:1": "a@Basel SBB", "b@Central": "a@Hauptbahnhof~53.0,8.0", "b:3": "8509999", "b:4": "a@Hauptbahnhof", "b:5": "a@Gone", "c:1": "x:a:dead", "c@Unused": "1"}
    stations, mapping, issues = merged(spark, rows, aliases)
    assert mapping == {("a", "1"): "x:a:1", ("a", "2"): "x:a:2", ("a", "3"): "x:a:3", ("b", "1"): "x:a:1", ("b", "2"): "x:a:3", ("b", "3"): "8509999", ("b", "4"): "x:a:2", ("b", "5"): "x:b:5", ("c", "1"): "x:a:2"}
    assert stations["8509999"] == "Gare"
    assert issues == {"alias target 'a@Hauptbahnhof' (for b:4) is ambiguous: x:a:2, x:a:3", "alias target 'a@Gone' (for b:5) matches no stop", "alias key 'c@Unused' matches no stop"}


def test_stops_without_a_position_never_make_a_station(spark):
    rows = [("a", "s", "Praha", None, None, None), ("a", "t", "Twice", None, None, None), ("a", "u", "None", None, None, None), ("a", "v", "By alias", None, None, None), ("a", "w", "Named", None, None, None), ("b", "1", "Praha", None, 50.0, 14.0), ("b", "2", "Twice", None, 10.0, 1.0), ("c", "2", "Twice", None, 20.0, 1.0)]
    stations, mapping, _ = merged(spark, rows, {"a:v": "x:c:2", "a@Named": "b@Twice", "a:u": "x:z:gone"})
    assert mapping == {("b", "1"): "x:b:1", ("b", "2"): "x:b:2", ("c", "2"): "x:c:2", ("a", "s"): "x:b:1", ("a", "v"): "x:c:2", ("a", "w"): "x:b:2"}
    assert set(stations) == {"x:b:1", "x:b:2", "x:c:2"}


def test_blocks_decide_as_one_fold_over_all_stops(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = []
        for feed in "abc":
            for k in range(40):
                code = str(8_000_000 + r.randrange(12)) if r.random() < 0.3 else None
                rows.append((feed, str(k), r.choice(["Nord", "Süd Hbf", "Sud Hauptbahnhof", "West", "Ost"]), code, 50 + r.randrange(3) * 0.1 + r.randrange(6) * 0.002, 8 + r.randrange(4) * 0.0025))
        aliases = {f"b:{r.randrange(40)}": r.choice(["a@Nord", "a@Süd Hbf~50.1,8.0", "x:a:3", "x:c:5", "x:a:gone", "8000003", "9000001"]) for _ in range(6)} | {"c@West": "b@Ost"}
        stations, mapping, _ = merged(spark, rows, aliases)
        cells = [(k, f, i, text.merged_text(n), c, y, x) for k, (f, i, n, c, y, x) in enumerate(rows)]
        want = {(rows[o][0], rows[o][1]): s for o, s, *_ in resolve.fold_block(cells, resolve.Aliases(aliases), {"a": 0, "b": 1, "c": 2})}
        assert mapping == want and set(stations) == set(want.values())


def test_stops_without_aliases_are_decided_in_rounds_as_one_by_one(spark):
    for seed in range(3):
        r = random.Random(seed + 10)
        rows = []
        for k in range(250):
            code = str(8_000_000 + r.randrange(40)) if r.random() < 0.4 else None
            # chains of places less than 500 m apart, and repeated ones
            rows.append((r.choice("abc"), str(k), r.choice(["Nord", "Süd Hbf", "Sud Hauptbahnhof"]), code, 50 + r.randrange(30) * 0.002, 8 + r.randrange(5) * 0.0035))
        rows.sort(key=lambda x: x[0])
        stations, mapping, issues = merged(spark, rows)
        cells = [(k, f, i, text.merged_text(n), c, y, x) for k, (f, i, n, c, y, x) in enumerate(rows)]
        want = {(rows[o][0], rows[o][1]): s for o, s, *_ in resolve.fold_block(cells, resolve.Aliases({}), {"a": 0, "b": 1, "c": 2})}
        assert mapping == want and set(stations) == set(want.values()) and not issues


def test_pairs_of_places_stand_for_all_pairs_of_stops(spark):
    r = random.Random(7)
    rows = []
    for k in range(300):
        y = r.choice((-60.0, 0.0, 50.0, 71.0))
        rows.append((k, r.choice(("A", "B")), y + r.randrange(-6, 7) * 0.0011, r.choice((-0.004, 0.0, 8.0)) + r.randrange(6) * 0.003))
    stops = spark.createDataFrame(rows, "ord long, name string, lat double, lon double")
    rep = {x.ord: x.rep for x in resolve.place_members(stops).collect()}
    near = {(x.a, x.b) for x in resolve.proximity_pairs(resolve.places(stops)).collect()}
    for i, n, y, x in rows:
        for j, m, v, w in rows:
            if i < j and n == m:
                a, b = sorted((rep[i], rep[j]))
                assert (resolve._metres((y, x), (v, w)) < 500) == (a == b or (a, b) in near)
    once = {x.ord: x.canonical for x in resolve.merge_one_hop(stops).collect()}
    assert once == {i: min([j for j, m, v, w in rows if m == n and resolve._metres((y, x), (v, w)) < 500]) for i, n, y, x in rows}


@pytest.mark.parametrize("block", [3, resolve.BLOCK])
def test_stop_pairs_are_all_pairs_of_stops(spark, monkeypatch, block):
    monkeypatch.setattr(resolve, "BLOCK", block)
    r = random.Random(11)
    rows = [(k, r.choice(("A", "B")), 50 + r.randrange(4) * 0.0022, 8 + r.randrange(4) * 0.003) for k in range(150)] + [(150, "A", None, 8.0)]
    want = sorted((i, j) for i, n, y, x in rows for j, m, v, w in rows if i < j < 150 and n == m and resolve._metres((y, x), (v, w)) < 500)
    got = resolve.stop_pairs(spark.createDataFrame(rows, "ord long, name string, lat double, lon double"))
    assert sorted(map(tuple, got.collect())) == want and any(rows[i][1:] == rows[j][1:] for i, j in want) and any(rows[i][1:] != rows[j][1:] for i, j in want)


def test_proximity_pairs_query_gives_pairs_of_stops(spark):
    """The whole job of the SQL: pairs of stops, not of their places alone."""
    got = registry.QUERIES["proximity_pairs"](spark, SMALL)
    members = {x.ord: x.rep for x in registry.QUERIES["place_members"](spark, SMALL).collect()}
    near = {(x.a, x.b) for x in registry.QUERIES["place_pairs"](spark, SMALL).collect()}
    want = sorted((i, j) for i in members for j in members if i < j and (members[i] == members[j] or tuple(sorted((members[i], members[j]))) in near))
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == want and len(want) > len(near)


def test_first_independent_nodes_of_random_graphs(spark):
    r = random.Random(3)
    pairs = sorted({tuple(sorted(r.sample(range(80), 2))) for _ in range(160)} | {(k, k + 1) for k in range(100, 130)})
    makers, want = [], {}
    for node in sorted({x for p in pairs for x in p}):
        hit = [m for m in makers if (m, node) in pairs]
        if hit:
            want[node] = hit[0]
        else:
            makers.append(node)
    assert {x.node: x.canonical for x in resolve.first_independent(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


def test_connected_takes_long_chains(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1001)]
    got = {r.node: r.group for r in resolve.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


CALLS = "trip_id long, idx int, station long, arr long, dep long"


def whole_fold(trips, calls):
    """Services, and pairs left in each pass by label, of all trips at once in plain code."""
    own = {t: [c for c in sorted(calls) if c[0] == t] for t, n in trips if any(x.isdigit() for x in n)}
    label = dict(trips)
    live = [([t], own[t]) for t in sorted(own) if len(own[t]) >= 2]
    left = {}
    for _ in range(5):
        pairs = []
        for i, (ma, a) in enumerate(live):
            for j, (mb, b) in enumerate(live):
                gap = b[0][4] - a[-1][3]
                if i != j and label[ma[0]] == label[mb[0]] and a[-1][2] == b[0][2] and 0 <= gap <= 60 and not {c[2] for c in a[:-1]} & {c[2] for c in b[1:]}:
                    pairs.append((gap, i, j))
        unclear = [p for p in pairs if any(q != p and q[0] == p[0] and (q[1] == p[1] or q[2] == p[2]) for q in pairs)]
        for _, i, _ in unclear:
            left[label[live[i][0][0]]] = left.get(label[live[i][0][0]], 0) + 1
        used, gone = set(), set()
        for p in sorted(set(pairs) - set(unclear)):
            if not used & set(p[1:]):
                used |= set(p[1:])
                gone.add(p[2])
                live[p[1]] = (live[p[1]][0] + live[p[2]][0], live[p[1]][1] + live[p[2]][1][1:])
        if not gone:
            break
        live = [s for k, s in enumerate(live) if k not in gone]
    return {tuple(m) for m, _ in live}, left


def test_through_services_by_groups_as_by_labels(spark):
    r = random.Random(1)
    for _ in range(3):
        trips, calls = [], []
        for t in range(60):
            trips.append((t, r.choice(["EC 1", "EC 2", "ICE"])))
            at, place = r.randrange(300, 500, 10), r.randrange(12)
            for idx in range(1, r.randrange(2, 4) + 1):
                calls.append((t, idx, place, at, at + 2))
                at, place = at + r.randrange(10, 60, 5), (place + r.randrange(1, 5)) % 12
        c = spark.createDataFrame(calls, CALLS)
        df = spark.createDataFrame([(*x, "f") for x in trips], "trip_id long, train string, feed string")
        services, left = whole_fold(trips, calls)
        joined = resolve.join_through(df, c)
        assert {tuple(x.members) for x in joined.collect()} == services
        assert {x.train: x.n for x in resolve.ambiguous_labels(df, c).collect()} == left
        by = {}
        for x in resolve.through_calls(joined, c).orderBy("head", "idx").collect():
            by.setdefault(x.head, []).append((x.station, x.arr, x.dep))
        for members in services:
            want = []
            for t in members:
                own = [x[2:] for x in sorted(y for y in calls if y[0] == t)]
                if want:
                    want[-1] = (*want[-1][:2], own[0][2])
                    own = own[1:]
                want += own
            assert by[members[0]] == want


def test_joined_trips_name_their_feeds_once(spark):
    trips = spark.createDataFrame([(1, "EC 9", "a"), (2, "EC 9", "b"), (3, "EC 9", "a")], "trip_id long, train string, feed string")
    services = spark.createDataFrame([(1, [1, 2, 3])], "head long, members array<long>")
    assert [tuple(r) for r in resolve.through_trips(services, trips).collect()] == [(1, "1+2+3", "EC 9", ["a", "b"])]


def test_countries_by_override_then_polygon_with_audit(spark):
    stations = spark.createDataFrame([("1", "In", "FR", 1.0, 1.0), ("2", "Out", "XX", 50.0, 50.0), ("3", "Forced", "FR", 2.0, 2.0), ("4", "Twin", "FR", 2.001, 2.0), ("5", "Same", "AA", 3.0, 3.0)], "id string, name string, country string, lat double, lon double")
    square = [("AA", 0, 0, 0.0, 0.0, 9.0, 0.0), ("AA", 0, 0, 9.0, 0.0, 9.0, 9.0), ("AA", 0, 0, 9.0, 9.0, 0.0, 9.0), ("AA", 0, 0, 0.0, 9.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "iso string, ord int, ring int, x1 double, y1 double, x2 double, y2 double")
    overrides = spark.createDataFrame([(0, "here", 2.0, 2.0, "ZZ"), (1, "far", 80.0, 0.0, "QQ")], "ord int, o_name string, o_lat double, o_lon double, country string")
    out, audit = resolve.assign_countries(stations, edges, overrides)
    assert {r.id: r.country for r in out.collect()} == {"1": "AA", "2": "XX", "3": "ZZ", "4": "AA", "5": "AA"}
    assert {tuple(r) for r in audit.collect()} == {("changed", "1", "FR", "AA"), ("changed", "3", "FR", "ZZ"), ("changed", "4", "FR", "AA"), ("no polygon", "2", "XX", "XX"), ("unused override", "far", None, "QQ"), ("ambiguous override", "here", "3", "ZZ")}


def test_points_on_borders_match_nothing(spark):
    schema = "id long, name string, lat double, lon double"
    ours = spark.createDataFrame([(1, "Basel (Gr)", 47.5, 7.6), (2, "Basel", 47.5, 7.6), (3, "Elsewhere", 47.5, 7.601), (4, "Far", 1.0, 1.0)], schema)
    theirs = spark.createDataFrame([(10, "Basel SBB", 47.501, 7.6), (11, "Basel (Gr)", 47.53, 7.6)], schema)
    matches = resolve.match_catalogue(ours, theirs)
    assert {(r.id, r.candidate, r.how) for r in matches.collect()} == {(2, 10, 2), (3, 10, 3)}
    assert {(r.kind, r.n) for r in resolve.match_counts(ours, matches).collect()} == {("border", 1), ("name", 1), ("coord", 1)}


def test_copies_of_a_catalogue_are_never_paired(spark, monkeypatch):
    """200 stations and 200 offers of one place were 40,000 pairs; a place meets a place."""
    met = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(resolve, "grid_km", F.udf(lambda *at: met.add(1) or 0.1, "double"))
    rows = lambda name: spark.range(200).select("id", F.lit(name).alias("name"), F.lit(47.5).alias("lat"), F.lit(7.6).alias("lon"))
    found = resolve.match_catalogue(rows("Basel"), rows("Basel SBB")).collect()
    assert len(found) == 200 and {(r.candidate, r.how) for r in found} == {(0, 2)} and met.value < 10


def test_names_with_letters_of_all_scripts(spark):
    names = ["Hà Nội", "ﬁnal Straße", "Łódź", "Αθήνα", "Москва Й", "한국 ①", "S+U Nörd Bahnhof", "ȘƬ ŉ", "a͏b"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.merge_name(F.col("n")).alias("m"), text.search_name(F.col("n")).alias("s"), text.fold(F.col("n")).alias("f"))
    for r in df.collect():
        assert r.f == text.bare(r.n) and r.s == text.bare(r.n).lower() and r.m == text.merged_text(r.n)
    assert text.merged_text("Hà Nội") == "hanoi" and text.merged_text("ﬁnal Straße") == "finalstrae"
