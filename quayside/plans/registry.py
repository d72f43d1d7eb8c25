"""Queries of the library's operators over the projected timetable, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions import geo, text
from quayside.operators import calendar, client, coverage, feeds, frequency, reach, resolve, search, views
from quayside.sources import dims
from quayside.sources import timetable as tt
from quayside.sources.scratch import written
from quayside.streaming import events as ev
from quayside.streaming import horizon

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **more: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = tt.oracle(sql, **more)
        return f

    return add


def june(spark, sf):
    """The calls of one service day, for which the orders of June 1998 stand."""
    return tt.stop_times(spark, sf, *tt.SLICE)


def origins(spark, sf):
    return tt.stations(spark, sf).select(F.col("id").alias("origin"))


#: The three rounds as plain SQL.
def _round_views() -> dict[str, str]:
    out = {
        "o_floors": "SELECT DISTINCT station AS origin, min(f) OVER (PARTITION BY station, d) AS floor, d AS dep FROM (SELECT station, f, min(dep) AS d FROM tt_slice, range(300, 1260, 60) AS r(f) WHERE dep >= f GROUP BY station, f)",
        "o_paths": "SELECT a AS source, b AS target, minutes, mode, ord * 2 AS way FROM tt_footpaths UNION ALL SELECT b, a, minutes, mode, ord * 2 + 1 FROM tt_footpaths",
        "o_r1": "SELECT origin, floor, origin AS station, floor AS ready, origin AS prev, NULL::VARCHAR AS mode FROM o_floors",
    }
    for k in (1, 2, 3):
        if k > 1:
            out[f"o_c{k}"] = f"SELECT origin, floor, station, arr + 10 AS ready, -1 AS way, station AS prev, NULL::VARCHAR AS mode FROM o_l{k - 1} UNION ALL SELECT origin, floor, target, arr + minutes, way, source, o_paths.mode FROM o_l{k - 1} JOIN o_paths ON source = station"
            out[f"o_r{k}"] = f"SELECT origin, floor, station, ready, prev, mode FROM (SELECT *, row_number() OVER (PARTITION BY origin, floor, station ORDER BY ready, way) AS rn FROM o_c{k}) WHERE rn = 1 AND station <> origin UNION ALL SELECT origin, floor, origin, floor, origin, NULL FROM o_floors"
        out[f"o_b{k}"] = f"SELECT * FROM (SELECT origin, floor, trip_id, idx AS board_idx, r.station AS board, dep AS board_dep, prev, mode, row_number() OVER (PARTITION BY origin, floor, trip_id ORDER BY idx) AS rn FROM o_r{k} r JOIN tt_slice s ON s.station = r.station AND ready <= dep) WHERE rn = 1"
        out[f"o_d{k}"] = f"SELECT b.origin, b.floor, s.station, s.arr, 1 AS new, b.trip_id, s.idx AS alight_idx, board_dep, prev, board_idx, board, mode FROM o_b{k} b JOIN tt_slice s ON s.trip_id = b.trip_id AND s.idx > board_idx AND s.station <> b.origin"
        union = f"SELECT * FROM o_d{k}" + (f" UNION ALL SELECT origin, floor, station, arr, 0, trip_id, alight_idx, board_dep, prev, board_idx, board, mode FROM o_l{k - 1}" if k > 1 else "")
        out[f"o_l{k}"] = f"SELECT origin, floor, station, arr, trip_id, alight_idx, board_dep, prev, board_idx, board, mode FROM (SELECT *, row_number() OVER (PARTITION BY origin, floor, station ORDER BY arr, new, trip_id, alight_idx) AS rn FROM ({union})) WHERE rn = 1"
        own = f"SELECT origin, floor, station, arr, 1 AS trains, board_dep AS first_dep FROM o_l{k} WHERE prev = origin"
        out[f"o_w{k}"] = own + (f" UNION ALL SELECT l.origin, l.floor, l.station, l.arr, w.trains + 1, w.first_dep FROM o_l{k} l JOIN o_w{k - 1} w ON w.origin = l.origin AND w.floor = l.floor AND w.station = l.prev WHERE l.prev <> l.origin" if k > 1 else "")
    every = " UNION ALL ".join(f"SELECT *, {k} AS k FROM o_w{k}" for k in (1, 2, 3))
    out["o_best"] = f"SELECT origin, station AS dest, trains, arr - first_dep AS duration, floor, k FROM (SELECT *, row_number() OVER (PARTITION BY origin, station, trains ORDER BY arr - first_dep, floor, k) AS rn FROM ({every})) WHERE rn = 1"
    out["o_journeys"] = "SELECT origin, dest, trains, duration, floor, k FROM (SELECT *, min(duration) OVER (PARTITION BY origin, dest ORDER BY trains ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o_best) WHERE b IS NULL OR duration < b"
    # legs of the chosen journeys, from the last back to the first
    leg = "l.trip_id, prev, board, l.station AS alight, board_idx, alight_idx, board_dep, arr, mode"
    out["o_n3"] = "SELECT origin, floor, dest, trains, trains AS leg, dest AS station FROM o_journeys WHERE k = 3"
    for k in (3, 2, 1):
        out[f"o_g{k}"] = f"SELECT n.origin, n.floor, n.dest, n.trains, n.leg, {leg} FROM o_n{k} n JOIN o_l{k} l ON l.origin = n.origin AND l.floor = n.floor AND l.station = n.station"
        if k > 1:
            out[f"o_n{k - 1}"] = f"SELECT origin, floor, dest, trains, leg - 1 AS leg, prev AS station FROM o_g{k} WHERE prev <> origin UNION ALL SELECT origin, floor, dest, trains, trains, dest FROM o_journeys WHERE k = {k - 1}"
    out["o_legs"] = " UNION ALL ".join(f"SELECT origin, dest, trains, leg, trip_id, prev, board, alight, board_idx, alight_idx, board_dep, arr, mode FROM o_g{k}" for k in (1, 2, 3))
    # evidence: one search for each trip that calls at the origin
    out["o_first"] = "SELECT station AS origin, trip_id AS start, min(idx) AS from_idx, min_by(dep, idx) AS departure FROM tt_slice GROUP BY ALL"
    out["o_e1"] = "SELECT origin, start, station, min(arr) AS arr FROM o_first f JOIN tt_slice s ON s.trip_id = f.start AND idx > from_idx AND station <> origin GROUP BY ALL"
    for k in (2, 3):
        out[f"o_er{k}"] = f"SELECT origin, start, station, min(ready) AS ready FROM (SELECT origin, start, station, arr + 10 AS ready FROM o_e{k - 1} UNION ALL SELECT origin, start, target, arr + minutes FROM o_e{k - 1} JOIN o_paths ON source = station) GROUP BY ALL"
        out[f"o_eb{k}"] = f"SELECT origin, start, trip_id, min(idx) AS board_idx FROM o_er{k} r JOIN tt_slice s ON s.station = r.station AND ready <= dep GROUP BY ALL"
        out[f"o_e{k}"] = f"SELECT origin, start, station, min(arr) AS arr FROM (SELECT * FROM o_e{k - 1} UNION ALL SELECT b.origin, b.start, s.station, s.arr FROM o_eb{k} b JOIN tt_slice s ON s.trip_id = b.trip_id AND s.idx > board_idx) GROUP BY ALL"
    out["o_evidence"] = "SELECT e.origin, e.start AS trip, departure, e.station AS dest, e1.arr AS arr1, e2.arr AS arr2, e.arr AS arr3 FROM o_e3 e JOIN o_first USING (origin, start) LEFT JOIN o_e2 e2 ON e2.origin = e.origin AND e2.start = e.start AND e2.station = e.station LEFT JOIN o_e1 e1 ON e1.origin = e.origin AND e1.start = e.start AND e1.station = e.station WHERE e.station <> e.origin"
    out["o_points"] = "SELECT origin, dest, trip, departure, 1 AS trains, arr1 AS arr FROM o_evidence WHERE arr1 IS NOT NULL UNION ALL SELECT origin, dest, trip, departure, 2, arr2 FROM o_evidence WHERE arr2 IS NOT NULL AND (arr1 IS NULL OR arr2 < arr1) UNION ALL SELECT origin, dest, trip, departure, 3, arr3 FROM o_evidence WHERE arr3 IS NOT NULL AND (arr2 IS NULL OR arr3 < arr2)"
    out["o_useful"] = "SELECT origin, dest, trip, departure, min(trains) AS tier FROM (SELECT *, CASE WHEN trains = 2 THEN min(CASE WHEN trains <= 2 THEN arr END) OVER w ELSE min(arr) OVER w END AS b FROM o_points WINDOW w AS (PARTITION BY origin, dest ORDER BY departure DESC, trains, arr, trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE trains = 1 OR b IS NULL OR arr < b GROUP BY ALL"
    return out


tt.VIEWS.update(_round_views())


# reachability

@query("reach_journeys", "SELECT origin, dest, trains, duration, floor, k FROM o_journeys")
def reach_journeys(spark, sf):
    return reach.journeys(june(spark, sf), origins(spark, sf), tt.footpaths(spark, sf))


def _labels(k):
    def run(spark, sf):
        calls = reach.prepared(june(spark, sf))
        return reach.rounds(calls, reach.departure_floors(calls, origins(spark, sf)), tt.footpaths(spark, sf), k)[-1].select("origin", "floor", "station", "arr", "trip_id", "alight_idx", "board_dep", "prev")

    return run


for _k in (1, 2, 3):
    query(f"reach_round{_k}", f"SELECT origin, floor, station, arr, trip_id, alight_idx, board_dep, prev FROM o_l{_k}")(_labels(_k))


@query("departure_floors", "SELECT origin, floor, dep FROM o_floors")
def departure_floors(spark, sf):
    return reach.departure_floors(june(spark, sf), origins(spark, sf))


def _search(spark, sf):
    """(calls, labels, journeys) of one search, written once for all that reads them; labels and journeys with their share."""
    calls = reach.prepared(june(spark, sf))
    labels = reach.rounds(calls, reach.departure_floors(calls, origins(spark, sf)), tt.footpaths(spark, sf), shares=True)
    return calls, labels, reach.kept(reach.best_journeys(labels), "journeys")


def _legs(spark, sf):
    _, labels, journeys = _search(spark, sf)
    return reach.settled(reach.legs(labels, journeys), "legs")


_clock = "lpad(((T // 60) % 24)::VARCHAR, 2, '0') || ':' || lpad((T % 60)::VARCHAR, 2, '0')"


@query("reach_legs", f"SELECT origin, dest, trains, leg, trip_id, prev, board, alight, board_idx, alight_idx, board_dep, arr, mode, {_clock.replace('T', 'board_dep')} AS dep_clock, {_clock.replace('T', 'arr')} AS arr_clock FROM o_legs")
def reach_legs(spark, sf):
    return _legs(spark, sf).withColumns({"dep_clock": text.clock(F.col("board_dep")), "arr_clock": text.clock(F.col("arr"))})


def _countries(spark, sf):
    """Stations with the country codes that have clocks of their own, among others."""
    return tt.stations(spark, sf).withColumn("country", F.element_at(F.array(F.lit("PT"), F.lit("FI"), F.lit("DE")), (F.col("id") % 3 + 1).cast("int")))


_off = dict(x_off="SELECT id, [-60, 60, 0][id % 3 + 1] AS off FROM tt_stations")


@query("local_departure_floors", "SELECT DISTINCT station AS origin, min(f) OVER (PARTITION BY station, d) AS floor, d AS dep FROM (SELECT station, f - off AS f, min(dep) AS d FROM tt_slice JOIN x_off ON id = station, range(300, 1260, 60) AS r(f) WHERE dep >= f - off GROUP BY station, f - off)", **_off)
def local_departure_floors(spark, sf):
    offsets = reach.local_offsets(_countries(spark, sf)).withColumnRenamed("id", "origin")
    return reach.departure_floors(june(spark, sf), origins(spark, sf).join(offsets, "origin", "left"))


@query("journey_display", f"""SELECT origin, dest, trains, row_number() OVER (PARTITION BY origin, dest, trains ORDER BY leg, part)::INT AS pos, type, train, dep, arr, from_id, to_id, via, feeds, mode, minutes FROM (
  SELECT origin, dest, trains, leg, 1 AS part, 'train' AS type, train, {_clock.replace('T', '(board_dep + a.off + 1440)')} AS dep, {_clock.replace('T', '(arr + b.off + 1440)')} AS arr, board AS from_id, alight AS to_id,
    coalesce((SELECT string_agg(station, ',' ORDER BY idx) FROM tt_slice s WHERE s.trip_id = l.trip_id AND idx > board_idx AND idx < alight_idx), '') AS via, feed AS feeds, NULL AS mode, NULL::INT AS minutes
  FROM o_legs l JOIN tt_trips USING (trip_id) JOIN x_off a ON a.id = board JOIN x_off b ON b.id = alight
  UNION ALL SELECT origin, dest, trains, leg, 0, 'transfer', NULL, NULL, NULL, prev, board, NULL, NULL, l.mode, (SELECT min(minutes) FROM o_paths p WHERE source = prev AND target = board AND p.mode = l.mode) FROM o_legs l WHERE l.mode IS NOT NULL)""", **_off)
def journey_display(spark, sf):
    trips = tt.trips(spark, sf, *tt.SLICE).select("trip_id", "train", F.array("feed").alias("feeds"))
    calls, labels, journeys = _search(spark, sf)
    shown = reach.displayed(reach.settled(reach.legs(labels, journeys), "legs"), calls, trips, tt.footpaths(spark, sf), reach.local_offsets(_countries(spark, sf)))
    return shown.withColumns({"via": F.array_join(F.col("via").cast("array<string>"), ","), "feeds": F.array_join("feeds", ",")})


@query("departure_evidence", "SELECT origin, trip, departure, dest, arr1, arr2, arr3 FROM o_evidence")
def departure_evidence(spark, sf):
    return reach.evidence(june(spark, sf), origins(spark, sf), tt.footpaths(spark, sf))


@query("useful_departures", "SELECT * FROM o_useful")
def useful_departures(spark, sf):
    return reach.profile(june(spark, sf), origins(spark, sf), tt.footpaths(spark, sf))


@query("hour_histogram_tiers", """SELECT origin, dest, tier, bins FROM (
  SELECT origin, dest, unnest([{'tier': 1, 'bins': t1}, {'tier': 2, 'bins': CASE WHEN t1 IS NULL OR t2 <> t1 THEN t2 END}, {'tier': 3, 'bins': CASE WHEN NOT coalesce(t3 = coalesce(CASE WHEN t1 IS NULL OR t2 <> t1 THEN t2 END, t1), false) THEN t3 END}], recursive := true)
  FROM (SELECT origin, dest, max(CASE WHEN tier = 1 THEN bins END) AS t1, max(CASE WHEN tier = 2 THEN bins END) AS t2, max(CASE WHEN tier = 3 THEN bins END) AS t3 FROM o_bins GROUP BY ALL)) WHERE bins IS NOT NULL""",
    o_counts="SELECT origin, dest, t AS tier, ((departure // 60) % 24)::INT AS h, count(*) AS n FROM o_useful, range(1, 4) AS r(t) WHERE t >= tier GROUP BY ALL",
    o_keys="SELECT DISTINCT origin, dest, tier FROM o_counts",
    o_bins="SELECT k.origin, k.dest, k.tier, array_to_string(list(coalesce(n, 0) ORDER BY r.h), ',') AS bins FROM o_keys k CROSS JOIN range(0, 24) AS r(h) LEFT JOIN o_counts c ON c.origin = k.origin AND c.dest = k.dest AND c.tier = k.tier AND c.h = r.h GROUP BY ALL")
def hour_histogram_tiers(spark, sf):
    return frequency.histogram(useful_departures(spark, sf)).withColumn("bins", F.array_join(F.col("bins").cast("array<string>"), ","))


@query("hour_histogram_local", "SELECT k.origin, k.dest, array_to_string(list(coalesce(n, 0) ORDER BY r.h), ',') AS bins FROM (SELECT DISTINCT origin, dest FROM x_counts) k CROSS JOIN range(0, 24) AS r(h) LEFT JOIN x_counts c ON c.origin = k.origin AND c.dest = k.dest AND c.h = r.h GROUP BY ALL", **_off,
    x_counts="SELECT origin, dest, (((departure + off) // 60 + 24) % 24)::INT AS h, count(*) AS n FROM o_useful JOIN x_off ON id = origin WHERE tier = 1 GROUP BY ALL")
def hour_histogram_local(spark, sf):
    bins = frequency.histogram(useful_departures(spark, sf), reach.local_offsets(_countries(spark, sf)))
    return bins.filter("tier = 1").select("origin", "dest", F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"))


@query("direct_counts", "SELECT origin, dest, count(*) AS directs FROM o_evidence WHERE arr1 IS NOT NULL GROUP BY ALL")
def direct_counts(spark, sf):
    return frequency.direct_counts(reach.direct(june(spark, sf), origins(spark, sf)))


@query("daypart_rollup", """SELECT origin, dest, sum(CASE WHEN h < 12 THEN 1 ELSE 0 END)::BIGINT AS morning, sum(CASE WHEN h >= 12 AND h < 18 THEN 1 ELSE 0 END)::BIGINT AS afternoon, sum(CASE WHEN h >= 18 THEN 1 ELSE 0 END)::BIGINT AS evening
  FROM (SELECT origin, dest, (departure // 60) % 24 AS h FROM o_useful) GROUP BY ALL""")
def daypart_rollup(spark, sf):
    return frequency.dayparts(useful_departures(spark, sf))


# over days: weeks stand for sampled days

_daily = dict(
    d_weeks="SELECT (row_number() OVER (ORDER BY w) - 1)::INT AS day_ord, w::DATE AS day, w AS t0, w + INTERVAL 7 DAY AS t1 FROM (SELECT unnest(generate_series(date_trunc('week', min(o_orderdate))::TIMESTAMP, date_trunc('week', max(o_orderdate))::TIMESTAMP, INTERVAL 7 DAY)) AS w FROM orders)",
    d_calls="SELECT day_ord, day, s.* FROM tt_stop_times s JOIN orders ON o_orderkey = trip_id JOIN d_weeks ON o_orderdate >= t0 AND o_orderdate < t1",
    d_direct="SELECT a.day_ord, a.day, a.station AS origin, a.trip_id, b.station AS dest, min(b.arr) - a.dep AS duration FROM (SELECT day_ord, day, station, trip_id, min(idx) AS idx, min_by(dep, idx) AS dep FROM d_calls GROUP BY ALL) a JOIN d_calls b ON b.trip_id = a.trip_id AND b.idx > a.idx AND b.station <> a.station GROUP BY a.day_ord, a.day, a.station, a.trip_id, b.station, a.dep",
)
#: Four sampled days for queries whose days are made up.
WEEKS = ("1998-06-01", "1998-06-08", "1998-06-15", "1998-06-22")


def _weeks(spark, sf):
    """day_ord, day: Mondays of all weeks from the first order to the last."""
    monday = lambda f: F.to_date(F.date_trunc("week", f("o_orderdate")))
    days = tt.orders_in(spark, sf).agg(monday(F.min).alias("a"), monday(F.max).alias("b")).filter("a is not null")
    return F.broadcast(days.select(F.posexplode(F.expr("sequence(a, b, interval 7 days)")).alias("day_ord", "day")))


def _direct(spark, sf):
    """day_ord, day, origin, trip_id, dest, duration: direct rides of all weeks, each of which stands for a day."""
    trips = tt.orders_in(spark, sf).join(_weeks(spark, sf), F.to_date(F.date_trunc("week", "o_orderdate")) == F.col("day")).select(F.col("o_orderkey").alias("trip_id"), "day_ord", "day")
    calls = tt.stop_times(spark, sf).join(trips, "trip_id")
    first = calls.groupBy("day_ord", "day", F.col("station").alias("origin"), "trip_id").agg(F.min(F.struct("idx", "dep")).alias("f"))
    later = first.join(tt.stop_times(spark, sf).select("trip_id", "idx", F.col("station").alias("dest"), "arr"), "trip_id").filter((F.col("idx") > F.col("f.idx")) & (F.col("dest") != F.col("origin")))
    return later.groupBy("day_ord", "day", "origin", "trip_id", "dest").agg((F.min("arr") - F.max("f.dep")).alias("duration"))


_FREQ = dict(
    d_pairs="SELECT DISTINCT origin, dest FROM d_direct",
    d_daily="SELECT p.origin, p.dest, w.day, w.day_ord <> 3 AS covered, count(d.trip_id) AS directs FROM d_pairs p CROSS JOIN d_weeks w LEFT JOIN d_direct d ON d.origin = p.origin AND d.dest = p.dest AND d.day_ord = w.day_ord GROUP BY ALL",
)


@query("frequency_summary", """SELECT origin, dest, requested_sample_days, covered_days, active_days, direct_days, direct_trips, coalesce(months, '') AS months, rate AS direct_per_active_day,
  CASE WHEN direct_trips > 0 AND covered_days > 0 THEN round_even(direct_trips * 7 / covered_days, 0)::BIGINT END AS direct_per_week,
  CASE WHEN covered_days < 3 THEN 'coverage_limited' WHEN active_days = covered_days THEN 'year_round' ELSE 'limited' END AS availability, round_even(coalesce(rate, 0), 0)::BIGINT AS direct_per_day
  FROM (SELECT *, CASE WHEN direct_days > 0 THEN round_even(direct_trips / direct_days, 1) END AS rate FROM (SELECT origin, dest, count(*) AS requested_sample_days, count(*) FILTER (covered) AS covered_days, count(*) FILTER (covered AND directs > 0) AS active_days,
  count(*) FILTER (covered AND directs > 0) AS direct_days, sum(directs)::BIGINT AS direct_trips, (SELECT string_agg(m, ',' ORDER BY f) FROM (SELECT strftime(day, '%b') AS m, min(day) AS f FROM d_daily y WHERE y.origin = d.origin AND y.dest = d.dest AND covered AND directs > 0 GROUP BY ALL)) AS months FROM d_daily d GROUP BY origin, dest))""", **_daily, **_FREQ)
def frequency_summary(spark, sf):
    counts = _direct(spark, sf).groupBy("origin", "dest", "day").agg(F.count("*").alias("directs"))
    days = _weeks(spark, sf).select("day", (F.col("day_ord") != 3).alias("covered"))
    return frequency.summary(counts, days)


@query("best_journeys_across_days", "SELECT origin, dest, 1 AS trains, min(duration) AS duration, arg_min(day_ord, (duration, day_ord)) AS day_ord FROM d_direct GROUP BY ALL", **_daily)
def best_journeys_across_days(spark, sf):
    return frequency.best_over_days(_direct(spark, sf).withColumn("trains", F.lit(1)))


@query("covered_days", """SELECT DISTINCT s.origin, s.dest, w.day FROM c_sets s CROSS JOIN d_weeks w WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM c_sets x) y JOIN c_valid v ON v.day = w.day AND v.feed = y.feed WHERE y.origin = s.origin AND y.dest = s.dest AND y.set_id = s.set_id AND NOT v.ok)""",
    d_weeks="SELECT (row_number() OVER () - 1)::INT AS day_ord, d::DATE AS day FROM (SELECT unnest(['1998-06-01', '1998-06-08', '1998-06-15', '1998-06-22']) AS d)",
    c_sets="SELECT c_custkey AS origin, c_nationkey AS dest, c_custkey % 2 AS set_id, r_name AS feed FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey IN (n_regionkey, c_custkey % 5)",
    c_valid="SELECT day, r_name AS feed, (r_regionkey + day_ord) % 3 <> 0 AS ok FROM region, d_weeks WHERE r_regionkey <> 4")
def covered_days(spark, sf):
    region = tt.table(spark, sf, "region")
    c = tt.table(spark, sf, "customer").join(tt.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    near = c.join(F.broadcast(region), (F.col("r_regionkey") == F.col("n_regionkey")) | (F.col("r_regionkey") == F.col("c_custkey") % 5))
    sets = near.groupBy(F.col("c_custkey").alias("origin"), F.col("c_nationkey").alias("dest"), (F.col("c_custkey") % 2).alias("set_id")).agg(F.collect_set("r_name").alias("feeds"))
    days = spark.createDataFrame(list(enumerate(WEEKS)), "day_ord int, d string").select("day_ord", F.col("d").cast("date").alias("day"))
    valid = region.filter("r_regionkey <> 4").join(F.broadcast(days), F.lit(True)).select("day", F.col("r_name").alias("feed"), ((F.col("r_regionkey") + F.col("day_ord")) % 3 != 0).alias("covered"), F.lit(None).cast("boolean").alias("sampled"))
    return frequency.covered_days(sets, valid)


#: In SQL a week's stations are others than those of any other week, so one search over all of them is one for each week.
_by_week = dict(
    **{k: v for k, v in _daily.items() if k != "d_direct"},
    tt_slice="SELECT trip_id, idx, station + day_ord * 1000000 AS station, arr, dep FROM d_calls",
    tt_footpaths="SELECT a + day_ord * 1000000 AS a, b + day_ord * 1000000 AS b, minutes, mode, ord FROM (" + tt.VIEWS["tt_footpaths"] + ") f, d_weeks",
    w_journeys="SELECT origin // 1000000 AS day_ord, origin % 1000000 AS origin, dest % 1000000 AS dest, trains, duration, floor, k FROM o_journeys",
    w_best="SELECT origin, dest, trains, duration, day_ord FROM (SELECT *, row_number() OVER (PARTITION BY origin, dest, trains ORDER BY duration, day_ord) AS rn FROM w_journeys) WHERE rn = 1",
    w_tiers="SELECT origin, dest, string_agg(trains || ':' || duration || ':' || day_ord, '|' ORDER BY trains) AS tiers FROM (SELECT *, min(duration) OVER (PARTITION BY origin, dest ORDER BY trains ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w_best) WHERE b IS NULL OR duration < b GROUP BY ALL",
    w_direct="SELECT origin // 1000000 AS day_ord, origin % 1000000 AS origin, dest % 1000000 AS dest, count(*) AS directs FROM o_evidence WHERE arr1 IS NOT NULL GROUP BY ALL",
    w_pairs="SELECT DISTINCT day_ord, origin, dest FROM w_journeys",
    w_months="SELECT origin, dest, string_agg(m, ',' ORDER BY f) AS months FROM (SELECT origin, dest, strftime(day, '%b') AS m, min(day) AS f FROM w_pairs JOIN d_weeks USING (day_ord) GROUP BY ALL) GROUP BY ALL",
    w_facts="SELECT origin, dest, count(*) AS active_days, count(directs) AS direct_days, coalesce(sum(directs), 0)::BIGINT AS direct_trips FROM w_pairs LEFT JOIN w_direct USING (day_ord, origin, dest) GROUP BY ALL",
    w_counts="SELECT origin % 1000000 AS origin, dest % 1000000 AS dest, t AS tier, ((departure // 60) % 24)::INT AS h, count(*) AS n FROM o_useful, range(1, 4) AS r(t) WHERE t >= tier GROUP BY ALL",
    w_bins="SELECT k.origin, k.dest, k.tier, array_to_string(list(coalesce(n, 0) ORDER BY r.h), ',') AS bins FROM (SELECT DISTINCT origin, dest, tier FROM w_counts) k CROSS JOIN range(0, 24) AS r(h) LEFT JOIN w_counts c ON c.origin = k.origin AND c.dest = k.dest AND c.tier = k.tier AND c.h = r.h GROUP BY ALL",
    w_wide="SELECT origin, dest, max(CASE WHEN tier = 1 THEN bins END) AS t1, max(CASE WHEN tier = 2 THEN bins END) AS t2, max(CASE WHEN tier = 3 THEN bins END) AS t3 FROM w_bins GROUP BY ALL",
    w_hist="SELECT origin, dest, concat_ws('|', '1:' || t1, '2:' || CASE WHEN t1 IS NULL OR t2 <> t1 THEN t2 END, '3:' || CASE WHEN NOT coalesce(t3 = coalesce(CASE WHEN t1 IS NULL OR t2 <> t1 THEN t2 END, t1), false) THEN t3 END) AS hours FROM w_wide",
)


def _week_calls(spark, sf):
    """Calls of all orders, with the week (day) that each runs in; weeks stand for sampled days."""
    weeks = tt.orders_in(spark, sf).select(F.col("o_orderkey").alias("trip_id"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("day"))
    return tt.stop_times(spark, sf).join(weeks, "trip_id")


@query("journeys_by_week", "SELECT * FROM w_journeys", **_by_week)
def journeys_by_week(spark, sf):
    """One search over all weeks, origins and floors."""
    found = reach.journeys(_week_calls(spark, sf), origins(spark, sf), tt.footpaths(spark, sf))
    return found.join(_weeks(spark, sf), "day").select("day_ord", "origin", "dest", "trains", "duration", "floor", "k")


@query("destinations_over_days", """SELECT f.origin, f.dest, tiers, (SELECT count(*) FROM d_weeks) AS requested_sample_days, active_days, direct_days, direct_trips, months, CASE WHEN direct_days > 0 THEN round_even(direct_trips / direct_days, 1) END AS direct_per_active_day,
  CASE WHEN active_days = (SELECT count(*) FROM d_weeks) THEN 'year_round' ELSE 'limited' END AS availability, coalesce(hours, '') AS hours FROM w_facts f JOIN w_tiers USING (origin, dest) JOIN w_months USING (origin, dest) LEFT JOIN w_hist USING (origin, dest)""", **_by_week)
def destinations_over_days(spark, sf):
    """What a reader is told of each destination over all weeks: journeys by trains, days, direct trips, months and hours."""
    calls, paths, weeks = reach.prepared(_week_calls(spark, sf)), tt.footpaths(spark, sf), written(_weeks(spark, sf), "weeks")
    found = reach.journeys(calls, origins(spark, sf), paths).join(F.broadcast(weeks), "day")  # sampled days
    key = ["origin", "dest", "day"]
    best = frequency.tiers_over_days(F.col("trains"), F.col("duration"), F.col("day_ord"))
    # journeys and direct rides of a pair are dealt out once and meet as rows of a day, then as the pair
    rides = reach.direct(calls, origins(spark, sf)).select(*key, F.lit(1).cast("long").alias("directs"))
    rows = found.select(*key, "trains", "duration", "day_ord").unionByName(rides, allowMissingColumns=True).repartition("origin", "dest")
    daily = rows.groupBy(*key).agg(*[c.alias(k) for k, c in best.items()], F.coalesce(F.sum("directs"), F.lit(0)).alias("directs")).filter(" or ".join(f"{k} is not null" for k in best))
    facts = frequency.summary(daily.withColumn("journeys", F.lit(1)), weeks.select("day", F.lit(True).alias("covered")), dealt=True, **{k: F.min(k) for k in best})
    useful = reach.by_days(calls, lambda own: reach.profile(own, origins(spark, sf), paths).select("origin", "dest", "departure", "tier"), "useful")
    bins = lambda t: F.when(F.col(f"t{t}").isNotNull(), F.concat(F.lit(f"{t}:"), F.array_join(F.col(f"t{t}").cast("array<string>"), ",")))
    hours = frequency.hours_by_tier(useful.repartition("origin", "dest")).select("origin", "dest", F.concat_ws("|", bins(1), bins(2), bins(3)).alias("hours"))
    out = facts.withColumn("tiers", frequency.tiers_text()).join(hours, ["origin", "dest"], "left")
    return out.select("origin", "dest", "tiers", "requested_sample_days", "active_days", "direct_days", "direct_trips", "months", "direct_per_active_day", "availability", F.coalesce("hours", F.lit("")).alias("hours"))


_ends = dict(t_ends="SELECT trip_id, count(*) AS n, min_by(station, idx) AS f, max_by(station, idx) AS l FROM tt_stop_times GROUP BY ALL")


@query("route_counts", "SELECT station, count(DISTINCT least(f, l) || '|' || greatest(f, l)) AS n_routes FROM tt_stop_times JOIN t_ends USING (trip_id) GROUP BY ALL", **_ends)
def route_counts(spark, sf):
    calls = tt.stop_times(spark, sf)
    return frequency.route_counts(calls.select("trip_id", "station").join(resolve.through_ends(calls), "trip_id"))


@query("n_dest", "SELECT origin, count(DISTINCT dest) AS n_dest FROM o_journeys GROUP BY ALL")
def n_dest(spark, sf):
    return frequency.destination_counts(reach_journeys(spark, sf))


# calendars

_CAL = dict(k_days="SELECT DATE '2024-01-08' + d::INT AS date FROM range(0, 7) AS r(d)",
    k_base="SELECT date, service_id, bool_or((days >> (isodow(date) - 1)) & 1 = 1) AS base FROM tt_calendar JOIN k_days ON date BETWEEN start_date AND end_date GROUP BY ALL",
    k_exc="SELECT date, service_id, max_by(is_add, (ts, row_order)) AS exc FROM tt_calendar_dates JOIN k_days USING (date) GROUP BY ALL",
    k_active="SELECT date, service_id FROM k_base FULL JOIN k_exc USING (date, service_id) WHERE coalesce(exc, base, false)")


def _week_days(spark):
    return spark.sql("SELECT explode(sequence(date'2024-01-08', date'2024-01-14')) AS date")


@query("calendar_window", "SELECT least((SELECT min(start_date) FROM tt_calendar), (SELECT min(date) FROM tt_calendar_dates)) AS first_day, greatest((SELECT max(end_date) FROM tt_calendar), (SELECT max(date) FROM tt_calendar_dates)) AS last_day")
def calendar_window(spark, sf):
    return calendar.window(tt.calendar(spark, sf), tt.calendar_dates(spark, sf))


@query("active_services_by_day", "SELECT date, service_id FROM k_active", **_CAL)
def active_services_by_day(spark, sf):
    return calendar.active(tt.calendar(spark, sf), tt.calendar_dates(spark, sf), _week_days(spark))


@query("absent_services", "SELECT service_id FROM tt_calendar UNION SELECT service_id FROM tt_calendar_dates EXCEPT SELECT service_id FROM k_active WHERE isodow(date) > 5", **_CAL)
def absent_services(spark, sf):
    """Services that don't run on the week's last two days."""
    return calendar.absent(tt.calendar(spark, sf), tt.calendar_dates(spark, sf), active_services_by_day(spark, sf).filter("weekday(date) > 4"))


@query("service_week_dates", """SELECT DISTINCT anchor, d::DATE AS day, anchor + ((8 - isodow(anchor)) % 7 + 1 + CASE WHEN isodow(anchor) = 1 THEN 0 ELSE 0 END)::INT AS tuesday FROM (
  SELECT anchor, unnest(generate_series(s, CASE WHEN last - first < 6 THEN last ELSE s + 6 END, INTERVAL 1 DAY)) AS d FROM (SELECT *, CASE WHEN last - first < 6 THEN first ELSE least(greatest(anchor - (isodow(anchor)::INT - 1), first), last - 6) END AS s FROM w_in)) """.replace("anchor + ((8 - isodow(anchor)) % 7 + 1 + CASE WHEN isodow(anchor) = 1 THEN 0 ELSE 0 END)::INT", "anchor + ((8 - isodow(anchor))::INT % 7 + 1)::INT"),
    w_in="SELECT DISTINCT o_orderdate::DATE AS anchor, DATE '1995-01-04' AS first, DATE '1995-01-04' + (o_custkey % 20)::INT AS last FROM orders")
def service_week_dates(spark, sf):
    o = tt.table(spark, sf, "orders")
    rows = o.select(F.to_date("o_orderdate").alias("anchor"), F.lit("1995-01-04").cast("date").alias("first"), F.expr("date_add(date'1995-01-04', cast(o_custkey % 20 as int))").alias("last")).distinct()
    return rows.select("anchor", F.explode(calendar.week(F.col("anchor"), F.col("first"), F.col("last"))).alias("day"), calendar.next_tuesday(F.col("anchor")).alias("tuesday")).distinct()


@query("bitmap_days", "SELECT p_partkey, day FROM (SELECT p_partkey, bin(p_partkey % 1000 + 1) AS bits, DATE '2024-01-01' + (p_size % 5)::INT AS start FROM part) b CROSS JOIN (SELECT DATE '2024-01-01' + d::INT AS day FROM range(0, 12) AS r(d)) WHERE day - start >= 0 AND day - start < length(bits) AND substr(bits, (day - start + 1)::INT, 1) = '1'")
def bitmap_days(spark, sf):
    p = tt.table(spark, sf, "part").select("p_partkey", F.expr("bin(p_partkey % 1000 + 1)").alias("bits"), F.expr("date_add(date'2024-01-01', cast(p_size % 5 as int))").alias("start"))
    return p.withColumn("day", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-12')"))).filter(calendar.runs(F.col("bits"), F.col("start"), F.col("day"))).select("p_partkey", "day")


# feeds

PATTERNS = ["^IC\\b", "^TGV\\b", "E \\d"]


@query("feed_route_filter", r"SELECT trip_id, train FROM tt_trips WHERE regexp_matches(train, '^IC\b') OR regexp_matches(train, '^TGV\b') OR regexp_matches(train, 'E \d')")
def feed_route_filter(spark, sf):
    t = tt.trips(spark, sf)
    routes = t.select(F.col("trip_id").alias("route_id"), F.col("train").alias("short_name"), F.lit("").alias("long_name"), F.col("trip_id").alias("row_order"))
    return feeds.allowed_routes(routes, PATTERNS).select(F.col("route_id").alias("trip_id"), F.col("label").alias("train"))


@query("stop_id_filter_brand", "SELECT trip_id, brand, CASE WHEN trip_id % 3 = 0 THEN train ELSE brand || ' ' || trip_id END AS label FROM (SELECT trip_id, min_by(brand, (idx, k)) AS brand FROM (SELECT trip_id, idx, unnest([{'k': CASE WHEN regexp_matches(sid, '^s1') THEN 1 END, 'brand': 'North'}, {'k': CASE WHEN regexp_matches(sid, '7$') THEN 2 END, 'brand': 'South'}], recursive := true) FROM (SELECT *, 's' || station AS sid FROM tt_stop_times)) WHERE k IS NOT NULL GROUP BY trip_id) JOIN tt_trips USING (trip_id)")
def stop_id_filter_brand(spark, sf):
    calls = tt.stop_times(spark, sf).select("trip_id", "idx", F.concat(F.lit("s"), F.col("station").cast("string")).alias("stop_id"))
    b = feeds.brands(calls, [("^s1", "North"), ("7$", "South")]).join(tt.trips(spark, sf), "trip_id")
    head = F.when(F.col("trip_id") % 3 == 0, "").otherwise(F.col("trip_id").cast("string"))
    return b.select("trip_id", "brand", feeds.branded_label(F.col("brand"), head, F.col("train")).alias("label"))


@query("untimed_rows_coalesce", "SELECT trip_id, idx, CASE WHEN trip_id % 5 = 1 THEN dep ELSE arr END AS arr, CASE WHEN trip_id % 5 = 2 THEN arr ELSE dep END AS dep FROM tt_stop_times WHERE trip_id % 5 <> 0")
def untimed_rows_coalesce(spark, sf):
    hms = lambda c: F.format_string("%02d:%02d:30", F.floor(F.col(c) / 60), F.col(c) % 60)
    k = F.col("trip_id") % 5
    raw = tt.stop_times(spark, sf).select("trip_id", "idx", F.when(k.isin(0, 1), " ").otherwise(hms("arr")).alias("arrival"), F.when(k.isin(0, 2), "").otherwise(hms("dep")).alias("departure"))
    return feeds.timed(raw).select("trip_id", "idx", F.col("arr").cast("long").alias("arr"), F.col("dep").cast("long").alias("dep"))


@query("trip_name_filter", r"SELECT feed, trip_id, CASE WHEN feed IN ('ASIA', 'EUROPE') THEN train ELSE 'line' END AS label FROM tt_trips WHERE (feed <> 'ASIA' OR regexp_matches(train, '^IC')) AND (feed <> 'EUROPE' OR regexp_matches(train, '\d$'))")
def trip_name_filter(spark, sf):
    t = tt.trips(spark, sf).select("feed", "trip_id", F.col("train").alias("short_name"), F.lit("line").alias("label"))
    return feeds.allowed_trips(t, {"ASIA": ["^IC"], "EUROPE": ["\\d$"], "AFRICA": None}).select("feed", "trip_id", "label")


@query("stop_id_filter", "SELECT feed, trip_id FROM tt_trips JOIN tt_stop_times USING (trip_id) GROUP BY ALL HAVING bool_or(feed <> 'ASIA' OR station % 10 = 7)")
def stop_id_filter(spark, sf):
    calls = tt.stop_times(spark, sf).join(tt.trips(spark, sf).select("trip_id", "feed"), "trip_id").select("feed", "trip_id", F.col("station").cast("string").alias("stop_id"))
    return feeds.stop_allowed_trips(calls, {"ASIA": ["7$"], "EUROPE": None})


@query("service_trips", "SELECT date, trip_id, train, count(*) AS n_calls FROM k_active JOIN tt_trips USING (service_id) JOIN tt_stop_times USING (trip_id) WHERE regexp_matches(train, '^IC') GROUP BY ALL", **_CAL)
def service_trips(spark, sf):
    """Trips of allowed routes and running services, with their calls."""
    t = tt.trips(spark, sf)
    routes = feeds.allowed_routes(t.select(F.col("trip_id").alias("route_id"), F.col("train").alias("short_name"), F.lit("").alias("long_name"), F.lit(0).alias("row_order")), ["^IC"])
    trips = t.select("trip_id", "service_id").join(routes.withColumnRenamed("route_id", "trip_id"), "trip_id").join(active_services_by_day(spark, sf), "service_id")
    calls = tt.stop_times(spark, sf).groupBy("trip_id").agg(F.count("*").alias("n_calls"))
    return trips.join(calls, "trip_id").select("date", "trip_id", F.col("label").alias("train"), "n_calls")


@query("unmapped_stops", "SELECT station AS stop_id, count(*) AS n_calls FROM tt_stop_times WHERE station % 9 = 0 GROUP BY ALL")
def unmapped_stops(spark, sf):
    mapping = tt.stations(spark, sf).filter("id % 9 <> 0").select(F.col("id").alias("stop_id"), F.col("id").alias("station"))
    return feeds.unmapped(tt.stop_times(spark, sf).withColumnRenamed("station", "stop_id"), mapping)


@query("first_seen_stops", "SELECT feed, stop_id, day_ord, row_order FROM (SELECT *, row_number() OVER (PARTITION BY feed, stop_id ORDER BY day_ord, row_order) AS n FROM (SELECT feed, station AS stop_id, day(service_day) AS day_ord, trip_id AS row_order FROM tt_trips JOIN tt_stop_times USING (trip_id))) WHERE n = 1")
def first_seen_stops(spark, sf):
    calls = tt.stop_times(spark, sf).join(tt.trips(spark, sf).select("trip_id", "feed", "service_day"), "trip_id")
    return feeds.first_seen(calls.select("feed", F.col("station").alias("stop_id"), F.day("service_day").alias("day_ord"), F.col("trip_id").alias("row_order")))


@query("stub_positions", "SELECT feed, stop_ord, CASE WHEN stop_ord % 5 > 2 THEN lat::DOUBLE END AS lat, CASE WHEN stop_ord % 5 > 2 THEN lon::DOUBLE END AS lon FROM tt_raw_stops")
def stub_positions(spark, sf):
    k = F.col("stop_ord") % 5
    raw = tt.raw_stops(spark, sf).withColumns({"y": F.when(k == 0, "").when(k == 1, "0.0").when(k == 2, " ").otherwise(F.col("lat").cast("string")), "x": F.when(k == 0, "8.0").when(k == 1, "0").otherwise(F.col("lon").cast("string"))})
    lat, lon = feeds.stub_coordinates(F.col("y"), F.col("x"))
    return raw.select("feed", "stop_ord", lat.alias("lat"), lon.alias("lon"))


@query("tz_shift", "SELECT s_suppkey, coalesce([0, 60, 420, -60, -480, 0, 0][s_suppkey % 7 + 1], 0)::INT AS shift FROM supplier")
def tz_shift(spark, sf):
    """Each seventh feed has a zone that nobody knows, each other seventh none."""
    zones = F.array(*[F.lit(z) for z in ("Europe/Berlin", "Europe/London", "America/Chicago", "Europe/Helsinki", "Asia/Tokyo", "Nowhere/Else", None)])
    return tt.table(spark, sf, "supplier").select("s_suppkey", feeds.zone_shift(F.element_at(zones, (F.col("s_suppkey") % 7 + 1).cast("int"))).alias("shift"))


@query("stop_parent_resolve", "SELECT s_suppkey AS stop_id, CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey - s_suppkey % 10 >= (SELECT min(s_suppkey) FROM supplier) THEN s_suppkey - s_suppkey % 10 ELSE s_suppkey END AS station FROM supplier")
def stop_parent_resolve(spark, sf):
    k = F.col("s_suppkey")
    stops = tt.table(spark, sf, "supplier").select(k.cast("string").alias("stop_id"), F.when(k % 10 == 0, "").when(k < 10, "0").otherwise((k - 1).cast("string")).alias("parent"))
    return feeds.topmost(stops).select(F.col("stop_id").cast("long").alias("stop_id"), F.col("station").cast("long").alias("station"))


@query("stop_display_name", "SELECT k % 60 AS station, min_by(name, (length(name), name)) AS name FROM (SELECT stop_ord AS k, name FROM tt_raw_stops) GROUP BY ALL")
def stop_display_name(spark, sf):
    return feeds.display_names(tt.raw_stops(spark, sf).select((F.col("stop_ord") % 60).alias("station"), "name"))


@query("remap_trips", "SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY idx)::INT AS idx, station, arr, dep FROM (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM (SELECT trip_id, idx, station - station % 2 AS station, arr, dep FROM tt_stop_times WHERE station % 9 <> 0)) WHERE n >= 2")
def remap_trips(spark, sf):
    mapping = tt.stations(spark, sf).filter("id % 9 <> 0").select(F.col("id").alias("stop_id"), (F.col("id") - F.col("id") % 2).alias("station"))
    return feeds.remapped(tt.stop_times(spark, sf).withColumnRenamed("station", "stop_id"), mapping)


@query("validate_graph", "SELECT trip_id, min(idx) AS first_idx FROM (SELECT *, lag(dep) OVER (PARTITION BY trip_id ORDER BY idx) AS b FROM (SELECT trip_id, idx, arr, dep + CASE WHEN trip_id % 7 = 0 THEN 60 ELSE 0 END AS dep FROM tt_stop_times)) WHERE arr < b GROUP BY ALL")
def validate_graph(spark, sf):
    return feeds.backward_trips(tt.stop_times(spark, sf).withColumn("dep", F.col("dep") + F.when(F.col("trip_id") % 7 == 0, 60).otherwise(0)))


# names, places, merging

_norm = "regexp_replace(replace(regexp_replace(lower(strip_accents(replace(replace(name, 'Ł', 'L'), 'ł', 'l'))), '[^a-z0-9]', '', 'g'), 'hauptbahnhof', 'hbf'), '^(.+)bahnhof$', '\\1')"
_dist = "6371000.0 * sqrt(pow(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(radians(b.lat - a.lat), 2))"
_stops = dict(m_stops=f"SELECT feed * 1000000 + stop_ord AS ord, stop_id, name, lat, lon, {_norm} AS norm FROM tt_raw_stops", m_places="SELECT norm, lat, lon, min(ord) AS rep, count(*) AS n FROM m_stops GROUP BY ALL", m_pairs=f"SELECT a.ord, b.ord AS other FROM m_stops a JOIN m_stops b ON a.norm = b.norm AND a.ord < b.ord WHERE {_dist} < 500")


def _raw(spark, sf):
    return tt.raw_stops(spark, sf).withColumn("ord", F.col("feed") * 1_000_000 + F.col("stop_ord"))


@query("name_normalize", f"SELECT DISTINCT name, {_norm} AS merge_name, regexp_replace(lower(strip_accents(replace(replace(name, 'Ł', 'L'), 'ł', 'l'))), '[^a-z0-9]', '', 'g') AS booking_name, lower(strip_accents(replace(replace(name, 'Ł', chr(1)), 'ł', chr(2)))).replace(chr(1), 'ł').replace(chr(2), 'ł') AS search_name FROM tt_raw_stops")
def name_normalize(spark, sf):
    n = F.col("name")
    return tt.raw_stops(spark, sf).select("name", text.merge_name(n).alias("merge_name"), text.booking_name(n).alias("booking_name"), text.search_name(n).alias("search_name")).distinct()


@query("uic_extract", "SELECT DISTINCT stop_id, CASE WHEN length(stop_id) = 10 THEN substr(stop_id, 4, 7) END AS code FROM tt_raw_stops")
def uic_extract(spark, sf):
    return tt.raw_stops(spark, sf).select("stop_id", text.code_of(F.col("stop_id")).alias("code")).distinct()


@query("proximity_pairs", "SELECT ord AS a, other AS b FROM m_pairs", **_stops)
def proximity_pairs(spark, sf):
    """All pairs of stops, those of one place included."""
    return resolve.stop_pairs(_raw(spark, sf))


@query("place_pairs", "SELECT a.rep AS a, b.rep AS b, a.n AS n_a, b.n AS n_b FROM m_places a JOIN m_places b ON a.norm = b.norm AND a.rep < b.rep WHERE " + _dist + " < 500", **_stops)
def place_pairs(spark, sf):
    """Pairs of places; place_members says which stops they stand for."""
    return resolve.proximity_pairs(resolve.places(_raw(spark, sf)))


@query("place_members", "SELECT ord, min(ord) OVER (PARTITION BY norm, lat, lon) AS rep FROM m_stops", **_stops)
def place_members(spark, sf):
    return resolve.place_members(_raw(spark, sf))


@query("station_merge_onehop", "SELECT s.ord, coalesce(min(p.ord), s.ord) AS canonical FROM m_stops s LEFT JOIN m_pairs p ON p.other = s.ord GROUP BY s.ord", **_stops)
def station_merge_onehop(spark, sf):
    return resolve.merge_one_hop(_raw(spark, sf))


def _greedy(within: str) -> dict[str, str]:
    """The merge in SQL: stops one by one, each with the stations made so far. within: the registry that a stop belongs to."""
    near = _dist.replace("a.", "x.").replace("b.", "q.")
    return dict(
        g_stops=f"SELECT *, {within} AS reg, CASE WHEN length(stop_id) = 10 THEN substr(stop_id, 4, 7) END AS code FROM m_stops",
        g_heads="SELECT *, CASE WHEN code IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY reg, code) END AS head FROM g_stops",
        g_queue="SELECT *, row_number() OVER (ORDER BY ord) AS n FROM g_heads WHERE ord = head",
        g_fold=f"SELECT 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::BIGINT AS canonical, []::STRUCT(o BIGINT, reg BIGINT, norm VARCHAR, lat DOUBLE, lon DOUBLE)[] AS made UNION ALL SELECT q.n, q.ord, coalesce(hit, q.ord), CASE WHEN hit IS NULL THEN list_append(made, {{'o': q.ord, 'reg': q.reg, 'norm': q.norm, 'lat': q.lat::DOUBLE, 'lon': q.lon::DOUBLE}}) ELSE made END FROM (SELECT q.*, made, list_filter(made, lambda x: x.reg = q.reg AND x.norm = q.norm AND {near} < 500)[1].o AS hit FROM g_fold g JOIN g_queue q ON q.n = g.n + 1) q",
        g_merged="SELECT h.ord, f.canonical, h.reg FROM g_heads h JOIN g_fold f ON f.ord = h.head",
    )


@query("station_merge_greedy", "SELECT ord, canonical FROM g_merged", **_stops, **_greedy("0::BIGINT"))
def station_merge_greedy(spark, sf):
    return resolve.merge_in_order(_raw(spark, sf))


@query("unmerged_duplicates", f"SELECT r.ord, m.ord AS other FROM g_made m JOIN g_reps r USING (norm, lat, lon) WHERE m.ord <> r.ord UNION ALL SELECT a.ord, b.ord FROM g_reps a JOIN g_reps b ON a.norm = b.norm AND a.ord < b.ord WHERE {_dist} < 500", **_stops, **_greedy("ord // 1000000"),
    g_made="SELECT ord, norm, lat, lon FROM m_stops WHERE ord IN (SELECT canonical FROM g_merged)", g_reps="SELECT norm, lat, lon, min(ord) AS ord FROM g_made GROUP BY ALL")
def unmerged_duplicates(spark, sf):
    """Stations of feeds that were merged each on its own."""
    raw = written(_raw(spark, sf), "raw")
    makers = resolve.merge_in_order(raw, registry=F.col("feed")).select(F.col("canonical").alias("ord")).distinct()
    made = written(makers.join(raw, "ord"), "made")
    return resolve.duplicates(made)


_thru = dict(
    h_ends="SELECT trip_id, count(*) AS n, min_by(station, idx) AS f, min_by(dep, idx) AS fd, max_by(station, idx) AS l, max_by(arr, idx) AS la, list(station ORDER BY idx) AS s FROM tt_stop_times GROUP BY ALL",
    h_own="SELECT * FROM h_ends JOIN tt_trips USING (trip_id) WHERE n >= 2 AND regexp_matches(train, '[0-9]')",
    h_pairs="SELECT x.trip_id AS a, y.trip_id AS b, x.train, y.fd - x.la AS gap FROM h_own x JOIN h_own y ON x.train = y.train AND x.l = y.f AND x.trip_id <> y.trip_id WHERE y.fd - x.la BETWEEN 0 AND 60 AND NOT list_has_any(x.s[:-2], y.s[2:])",
)


@query("through_candidates", "SELECT a, b, train, gap, count(*) OVER (PARTITION BY gap, a) > 1 OR count(*) OVER (PARTITION BY gap, b) > 1 AS ambiguous FROM h_pairs", **_thru)
def through_candidates(spark, sf):
    calls = tt.stop_times(spark, sf)
    return resolve.through_candidates(tt.trips(spark, sf), resolve.through_ends(calls), calls)


def _joined_views(calls: str, passes: int = 4) -> dict[str, str]:
    """Passes of joining in SQL: each goes through its pairs one by one. More passes than these do nothing on the compared tables."""
    out = dict(
        j_ends=f"SELECT trip_id, count(*) AS n, min_by(station, idx) AS f, min_by(dep, idx) AS fd, max_by(station, idx) AS l, max_by(arr, idx) AS la, list(station ORDER BY idx) AS s FROM {calls} GROUP BY ALL",
        j_live1="SELECT trip_id AS ord, train, [trip_id] AS m, s, f, fd, l, la FROM j_ends JOIN tt_trips USING (trip_id) WHERE n >= 2 AND regexp_matches(train, '[0-9]')",
    )
    for k in range(1, passes + 1):
        out[f"j_pairs{k}"] = f"SELECT *, count(*) OVER (PARTITION BY gap, i) > 1 OR count(*) OVER (PARTITION BY gap, j) > 1 AS unclear FROM (SELECT x.ord AS i, y.ord AS j, x.train, y.fd - x.la AS gap FROM j_live{k} x JOIN j_live{k} y ON x.train = y.train AND x.l = y.f AND x.ord <> y.ord WHERE y.fd - x.la BETWEEN 0 AND 60 AND NOT list_has_any(x.s[:-2], y.s[2:]))"
        out[f"j_queue{k}"] = f"SELECT i, j, row_number() OVER (ORDER BY gap, i, j) AS n FROM j_pairs{k} WHERE NOT unclear"
        out[f"j_fold{k}"] = f"SELECT 0::BIGINT AS n, []::BIGINT[] AS used, false AS took UNION ALL SELECT q.n, CASE WHEN free THEN used || [i, j] ELSE used END, free FROM (SELECT q.*, used, NOT list_contains(used, i) AND NOT list_contains(used, j) AS free FROM j_fold{k} g JOIN j_queue{k} q ON q.n = g.n + 1) q"
        out[f"j_took{k}"] = f"SELECT i, j FROM j_fold{k} JOIN j_queue{k} USING (n) WHERE took"
        out[f"j_live{k + 1}"] = f"SELECT x.ord, x.train, x.m || coalesce(y.m, []) AS m, x.s || coalesce(y.s[2:], []) AS s, x.f, x.fd, coalesce(y.l, x.l) AS l, coalesce(y.la, x.la) AS la FROM j_live{k} x LEFT JOIN j_took{k} c ON c.i = x.ord LEFT JOIN j_live{k} y ON y.ord = c.j WHERE x.ord NOT IN (SELECT j FROM j_took{k})"
    counted = [f"SELECT train FROM j_pairs{k} WHERE unclear" + (f" AND EXISTS (SELECT 1 FROM j_took{k - 1})" if k > 1 else "") for k in range(1, passes + 1)]
    out["j_left"] = " UNION ALL ".join(counted)
    out["j_services"] = f"SELECT ord AS head, m FROM j_live{passes + 1}"
    return out


@query("through_join", "SELECT head, array_to_string(m, '+') AS members FROM j_services", **_joined_views("tt_stop_times"))
def through_join(spark, sf):
    joined = resolve.join_through(tt.trips(spark, sf), tt.stop_times(spark, sf))
    return joined.select("head", F.array_join(F.col("members").cast("array<string>"), "+").alias("members"))


@query("ambiguous_labels", "SELECT train, count(*) AS n FROM j_left GROUP BY train ORDER BY n DESC, train LIMIT 5", **_joined_views("j_rough"),
    j_rough="SELECT trip_id, idx, station, arr - arr % 30 AS arr, dep - dep % 30 AS dep FROM tt_stop_times")
def ambiguous_labels(spark, sf):
    """Times by half hours, so that gaps are often equal."""
    half = lambda c: (F.col(c) - F.col(c) % 30).alias(c)
    return resolve.ambiguous_labels(tt.trips(spark, sf), tt.stop_times(spark, sf).select("trip_id", "idx", "station", half("arr"), half("dep")))


@query("through_calls", """SELECT head, row_number() OVER (PARTITION BY head ORDER BY pos, idx)::INT AS idx, station, arr, dep FROM (
  SELECT head, pos, idx, station, arr, CASE WHEN ends AND pos < n THEN lead(dep) OVER (PARTITION BY head ORDER BY pos, idx) ELSE dep END AS dep, starts AND pos > 1 AS again FROM (
    SELECT head, pos, n, c.*, idx = min(idx) OVER (PARTITION BY trip_id) AS starts, idx = max(idx) OVER (PARTITION BY trip_id) AS ends FROM (SELECT head, len(m) AS n, unnest(m) AS trip_id, generate_subscripts(m, 1) AS pos FROM j_services) JOIN tt_stop_times c USING (trip_id))) WHERE NOT again""", **_joined_views("tt_stop_times"))
def through_calls(spark, sf):
    calls = tt.stop_times(spark, sf)
    return resolve.through_calls(resolve.join_through(tt.trips(spark, sf), calls), calls)


@query("country_pip", "SELECT id, min_by(iso, o) AS iso FROM (SELECT id, 'AA' AS iso, 0 AS o FROM tt_stations WHERE lon >= 6 AND lon < 12 AND lat >= 48 AND lat < 54 AND NOT (lon >= 8 AND lon < 9 AND lat >= 50 AND lat < 52) UNION ALL SELECT id, 'BB', 1 FROM tt_stations WHERE lon >= 10 AND lon < 18 AND lat >= 47 AND lat < 56) GROUP BY id")
def country_pip(spark, sf):
    square = lambda iso, o, ring, x0, y0, x1, y1: [(iso, o, ring, *p) for p in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))]
    rows = square("AA", 0, 0, 6.0, 48.0, 12.0, 54.0) + square("AA", 0, 1, 8.0, 50.0, 9.0, 52.0) + square("BB", 1, 0, 10.0, 47.0, 18.0, 56.0)
    return resolve.in_polygons(tt.stations(spark, sf), spark.createDataFrame(rows, "iso string, ord int, ring int, x1 double, y1 double, x2 double, y2 double"))


_hav = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(s.lat - o_lat) / 2), 2) + cos(radians(o_lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - o_lon) / 2), 2)))"


@query("nearest_override", f"SELECT ord, min_by(id, (d, id)) AS id, count(*) AS n FROM (SELECT o.id AS ord, s.id, {_hav} AS d FROM (SELECT id, lat + 0.001 AS o_lat, lon + 0.001 AS o_lon FROM tt_stations WHERE id % 5 = 0) o, tt_stations s WHERE abs(s.lat - o_lat) < 0.01) WHERE d <= 500 GROUP BY ord")
def nearest_override(spark, sf):
    s = tt.stations(spark, sf)
    return resolve.nearest_override(s.filter("id % 5 = 0").select(F.col("id").alias("ord"), (F.col("lat") + 0.001).alias("o_lat"), (F.col("lon") + 0.001).alias("o_lon")), s)


_book = "regexp_replace(lower(strip_accents(replace(replace(NAME, 'Ł', 'L'), 'ł', 'l'))), '[^a-z0-9]', '', 'g')"


@query("grid_match", f"""SELECT id, min_by(candidate, (how, km, candidate)) AS candidate, min(how) AS how FROM (
  SELECT a.ord AS id, b.ord AS candidate, sqrt(pow((b.lon - a.lon) * 111.32 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((b.lat - a.lat) * 110.57, 2)) AS km,
    CASE WHEN a.bn = b.bn THEN 1 WHEN contains(a.bn, b.bn) OR contains(b.bn, a.bn) THEN 2 WHEN sqrt(pow((b.lon - a.lon) * 111.32 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((b.lat - a.lat) * 110.57, 2)) <= 0.5 THEN 3 END AS how
  FROM g_stops a JOIN g_stops b ON b.feed > 0 AND a.feed = 0 AND a.ord % 11 <> 0 AND abs(a.lat - b.lat) < 0.3 AND abs(a.lon - b.lon) < 0.3) WHERE km <= 5 AND how IS NOT NULL GROUP BY id""",
    g_stops=f"SELECT feed, feed * 1000000 + stop_ord AS ord, lat, lon, {_book.replace('NAME', 'name')} AS bn FROM tt_raw_stops")
def grid_match(spark, sf):
    s = _raw(spark, sf).withColumn("id", F.col("ord"))
    border = F.when(F.col("id") % 11 == 0, F.concat("name", F.lit(" (Gr)"))).otherwise(F.col("name"))
    return resolve.match_catalogue(s.filter("feed = 0").select("id", border.alias("name"), "lat", "lon"), s.filter("feed > 0").select("id", "name", "lat", "lon"))


# views

@query("shown_destinations", "SELECT origin, dest, duration, trains, CASE WHEN duration < 180 THEN 0 WHEN duration < 360 THEN 1 WHEN duration < 600 THEN 2 ELSE 3 END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY origin, dest ORDER BY duration, trains) AS rn FROM o_journeys WHERE trains <= 2) WHERE rn = 1 AND duration <= 480")
def shown_destinations(spark, sf):
    return views.shown(reach_journeys(spark, sf), 2, 480)


@query("min_trains", "SELECT origin, dest, min(trains) AS trains FROM o_journeys WHERE duration <= 480 GROUP BY ALL")
def min_trains(spark, sf):
    return client.fewest_trains(reach_journeys(spark, sf), most_minutes=480)


_hops = dict(v_hops="SELECT trip_id, station AS a, lead(station) OVER w AS b, lead(arr) OVER w - dep AS minutes FROM tt_stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY idx)")


@query("segments_dedup", "SELECT least(a::VARCHAR, b::VARCHAR) || '|' || greatest(a::VARCHAR, b::VARCHAR) AS hop, min(minutes) AS minutes, count(*) AS n, min(trip_id) AS first_trip FROM v_hops WHERE a <> b GROUP BY ALL", **_hops)
def segments_dedup(spark, sf):
    return views.segments(views.hops(tt.stop_times(spark, sf)))


@query("hop_weights", "SELECT a, b, count(*) AS w FROM v_hops WHERE a <> b GROUP BY ALL", **_hops)
def hop_weights(spark, sf):
    return views.hop_weights(views.hops(tt.stop_times(spark, sf)))


@query("hop_curves")
def hop_curves(spark, sf):
    return views.curves(views.hops(june(spark, sf)), tt.stations(spark, sf))


@query("leg_segments", "SELECT trip_id, station AS a, b, minutes FROM (SELECT trip_id, station, lead(station) OVER w AS b, lead(arr) OVER w - dep AS minutes FROM tt_stop_times WHERE station % 9 <> 0 WINDOW w AS (PARTITION BY trip_id ORDER BY idx)) WHERE b IS NOT NULL")
def leg_segments(spark, sf):
    return views.hops(tt.stop_times(spark, sf).filter("station % 9 <> 0")).select("trip_id", "a", "b", "minutes")


@query("path_cumulative_km", "SELECT trip_id, idx, round(sum(coalesce(d, 0)) OVER (PARTITION BY trip_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS km FROM (SELECT trip_id, idx, sqrt(pow((lon - lag(lon) OVER w) * 111.32 * cos(radians((lat + lag(lat) OVER w) / 2)), 2) + pow((lat - lag(lat) OVER w) * 111.32, 2)) AS d FROM tt_stop_times JOIN tt_stations ON id = station WINDOW w AS (PARTITION BY trip_id ORDER BY idx))")
def path_cumulative_km(spark, sf):
    return views.along_paths(tt.stop_times(spark, sf), tt.stations(spark, sf)).withColumn("km", F.round("km", 6))


@query("search_ranked", "SELECT stop_ord AS id, name, CASE WHEN starts_with(lower(strip_accents(name)), 'zur') THEN 0 ELSE 1 END AS tier, stop_ord % 17 AS n_dest FROM tt_raw_stops WHERE feed = 0 AND stop_ord % 13 <> 0 AND contains(lower(strip_accents(name)), 'zur') ORDER BY tier, CASE WHEN stop_ord % 10 = 0 THEN 0 ELSE 1 END, stop_ord % 17 DESC, length(name), stop_ord LIMIT 10")
def search_ranked(spark, sf):
    s = tt.raw_stops(spark, sf).filter("feed = 0").select(F.col("stop_ord").alias("id"), "name", (F.col("stop_ord") % 10 == 0).alias("is_capital"), (F.col("stop_ord") % 17).alias("n_dest"))
    return views.search(s, "Zür", [("zurigo", "zurich"), ("monaco di baviera", "munchen")], reach=s.filter("id % 13 <> 0"))


#: Names that other languages have for cities, as a configuration has them.
EXONYMS = [("Zurigo", "Zürich"), ("Monaco di Baviera", "München"), ("Praga", "Praha"), ("Colonia", "Köln"), ("Zuri", "Łódź")]
_low = "replace(replace(lower(strip_accents(replace(replace({0}, 'Ł', chr(1)), 'ł', chr(2)))), chr(1), 'ł'), chr(2), 'ł')"
_searches = dict(
    e_names="SELECT " + _low.format("a") + " AS a, " + _low.format("b") + " AS b FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EXONYMS) + ") t(a, b)",
    e_asked="SELECT p_partkey AS search_id, CASE WHEN p_partkey % 4 = 0 THEN upper(t) ELSE t END AS query FROM (SELECT p_partkey, substr(['München','Zürich','Łódź','Köln','Praha','Zurigo','Monaco di Baviera','Praga','Colonia'][p_partkey % 9 + 1] || ' ' || (p_partkey % 40) || ['',' Hbf',' Hauptbahnhof'][p_partkey % 3 + 1], 1 + p_size % 4, 1 + p_partkey // 7 % 12) AS t FROM part)",
    e_q="SELECT search_id, " + _low.format("query") + " AS q FROM e_asked",
    e_forms="SELECT DISTINCT q, q AS v FROM e_q UNION SELECT q, CASE WHEN starts_with(a, q) THEN b ELSE b || substr(q, length(a) + 1) END FROM (SELECT DISTINCT q FROM e_q) JOIN e_names ON starts_with(a, q) OR starts_with(q, a) WHERE length(q) >= 3",
    e_stations="SELECT id, name, n_dest, is_capital, " + _low.format("name") + " AS norm FROM (SELECT k * 2 + (feed > 0)::INT AS id, name || CASE WHEN feed > 0 AND k % 2 = 1 THEN ' ' || k ELSE '' END AS name, k % 17 AS n_dest, k % 10 = 0 AS is_capital FROM (SELECT *, stop_ord AS k FROM tt_raw_stops)) WHERE id % 13 <> 0",
    e_hits="SELECT q, id, name, n_dest, is_capital, length(norm) AS size, min(CASE WHEN starts_with(norm, v) THEN 0 ELSE 1 END) AS tier FROM e_forms JOIN e_stations ON contains(norm, v) GROUP BY ALL",
)


@query("search_table", "SELECT search_id, rank, id, name, tier, n_dest FROM e_q JOIN (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY tier, NOT is_capital, n_dest DESC, size, id))::INT AS rank FROM e_hits) USING (q) WHERE rank <= 10", **_searches)
def search_table(spark, sf):
    """Each part asks for a piece of a city's name; suppliers and customers are the stations."""
    k = F.col("p_partkey")
    whole = F.concat(tt._pick((*tt.CITIES, "Zurigo", "Monaco di Baviera", "Praga", "Colonia"), k % 9), F.lit(" "), (k % 40).cast("string"), tt._pick(tt.ENDINGS, k % 3))
    piece = F.substring(whole, 1 + F.col("p_size") % 4, F.expr("1 + p_partkey div 7 % 12"))
    asked = tt.table(spark, sf, "part").select(k.alias("search_id"), F.when(k % 4 == 0, F.upper(piece)).otherwise(piece).alias("query"))
    o, other = F.col("stop_ord"), F.col("feed") > 0
    name = F.when(other & (o % 2 == 1), F.concat("name", F.lit(" "), o.cast("string"))).otherwise(F.col("name"))
    s = tt.raw_stops(spark, sf).select((o * 2 + other.cast("int")).alias("id"), name.alias("name"), (o % 17).alias("n_dest"), (o % 10 == 0).alias("is_capital"))
    return search.search_all(s, asked, spark.createDataFrame(EXONYMS, "name string, native string"), reach=s.filter("id % 13 <> 0"))


@query("dest_options_grouped", "SELECT id, name, CASE WHEN t IS NOT NULL THEN t WHEN x IS NULL AND id % 25 = 1 THEN 4 ELSE 5 END AS grp FROM (SELECT id, name, min(CASE WHEN duration <= 480 THEN trains END) AS t, count(dest) AS c, max(dest) AS x FROM tt_stations LEFT JOIN o_journeys ON dest = id AND origin = 1 WHERE id <> 1 AND contains(lower(name), 'upp') GROUP BY ALL) ORDER BY grp, name, id LIMIT 12")
def dest_options_grouped(spark, sf):
    s = tt.stations(spark, sf)
    return views.destination_options(s, reach_journeys(spark, sf), s.filter("id % 25 = 1").select("id"), 1, "upp", 480)


_city = dict(y_groups="SELECT 'C' || (k % 3) AS city, (k % 3)::BIGINT AS city_ord, name AS member, min(k) AS pos FROM (SELECT stop_ord AS k, name FROM tt_raw_stops WHERE feed = 0 AND stop_ord < 40) GROUP BY ALL", y_stations="SELECT stop_ord AS id, name FROM tt_raw_stops WHERE feed = 0")


def _city_groups(spark, sf):
    raw = tt.raw_stops(spark, sf).filter("feed = 0")
    g = raw.filter("stop_ord < 40").groupBy(F.concat(F.lit("C"), (F.col("stop_ord") % 3).cast("string")).alias("city"), (F.col("stop_ord") % 3).alias("city_ord"), F.col("name").alias("member")).agg(F.min("stop_ord").alias("pos"))
    return g, raw.select(F.col("stop_ord").alias("id"), "name")


@query("city_members", "SELECT city, city_ord, array_to_string(list(id ORDER BY pos, id), ',') AS ids FROM y_groups JOIN y_stations ON name = member GROUP BY ALL HAVING count(*) >= 2", **_city)
def city_members(spark, sf):
    return views.cities(*_city_groups(spark, sf)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("transfers_valid", """SELECT city, a, b, minutes, mode, CASE WHEN minutes <= 0 THEN 'minutes' WHEN mode = 'rocket' THEN 'mode' WHEN NOT EXISTS (SELECT 1 FROM y_groups g WHERE g.city = t.city AND member = a) OR NOT EXISTS (SELECT 1 FROM y_groups g WHERE g.city = t.city AND member = b) THEN 'not in city'
  WHEN (SELECT count(*) FROM y_stations WHERE name = a) <> 1 OR (SELECT count(*) FROM y_stations WHERE name = b) <> 1 THEN 'ambiguous' END AS reason FROM y_transfers t""", **_city,
    y_transfers="SELECT x.city, x.member AS a, y.member AS b, (x.pos + y.pos) % 9 AS minutes, CASE WHEN (x.pos * y.pos) % 7 = 0 THEN 'rocket' ELSE 'metro' END AS mode FROM y_groups x JOIN y_groups y ON x.pos < y.pos AND y.pos < x.pos + 8")
def transfers_valid(spark, sf):
    g, s = _city_groups(spark, sf)
    x, y = g.alias("x"), g.alias("y")
    t = x.join(y, (F.col("x.pos") < F.col("y.pos")) & (F.col("y.pos") < F.col("x.pos") + 8)).select("x.city", F.col("x.member").alias("a"), F.col("y.member").alias("b"), ((F.col("x.pos") + F.col("y.pos")) % 9).alias("minutes"), F.when(F.col("x.pos") * F.col("y.pos") % 7 == 0, "rocket").otherwise("metro").alias("mode"))
    return views.transfer_checks(t, g, s)


@query("city_union", "SELECT dest, min_by(origin, (trains, duration, origin)) AS origin, min(trains) AS trains, min_by(duration, (trains, duration, origin)) AS duration FROM o_journeys WHERE origin IN (1, 2, 3) GROUP BY dest")
def city_union(spark, sf):
    return views.city_union(reach_journeys(spark, sf).filter("origin in (1, 2, 3)").withColumn("reach_ord", F.col("origin"))).select("dest", "origin", "trains", "duration")


@query("capitals", "SELECT country, name, (SELECT max(id) FROM tt_stations t WHERE t.country = a.country AND t.name = a.name) AS id FROM (SELECT n_name AS country, 'Supplier#' || lpad((n_nationkey * 10 + 10)::VARCHAR, 9, '0') AS name FROM nation) a")
def capitals(spark, sf):
    conf = {r.n_name.lower(): f"Supplier#{r.n_nationkey * 10 + 10:09d}" for r in tt.table(spark, sf, "nation").collect()}  # as a configuration has them
    return dims.capitals(spark, {"capitals": conf}, tt.stations(spark, sf))


@query("coverage_sets", "SELECT n_name AS country, bool_or(f) AS covered FROM (SELECT n_name, c_custkey IS NOT NULL AS f FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey SEMI JOIN supplier ON s_nationkey = n_nationkey) GROUP BY ALL")
def coverage_sets(spark, sf):
    """Customers stand for feeds."""
    n = tt.table(spark, sf, "nation")
    feed = tt.table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("country"))
    return views.coverage(tt.stations(spark, sf), feed)


#: Each customer is a square of two degrees by half a degree, in rows of 50; some lie across the box.
_land = dict(
    n_land="SELECT n_name, r_name, -44.0 + 2 * (c_custkey % 50) AS x, 20.25 + 0.5 * (c_custkey // 50) AS y FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    n_parts="SELECT n_name, r_name, 1.0 AS whole, greatest(0, least(x + 2, 45) - greatest(x, -25)) * greatest(0, least(y + 0.5, 72) - greatest(y, 27)) AS shown FROM n_land",
)


@query("coverage_tiers", "SELECT tier, sum(area)::DOUBLE AS area FROM (SELECT 'light' AS tier, shown AS area FROM n_parts WHERE r_name = 'ASIA' UNION ALL SELECT 'dark', CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN whole - shown ELSE whole END FROM n_parts) WHERE area > 0 GROUP BY tier", **_land)
def coverage_tiers(spark, sf):
    """Nations of one region are covered, those of another reachable."""
    n = tt.table(spark, sf, "nation").join(tt.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("iso"), "r_name")
    k = F.col("c_custkey")
    land = tt.table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("iso", k.alias("ord"), F.lit(0).alias("ring"), (-44.0 + 2 * (k % 50)).alias("x"), (20.25 + 0.5 * F.floor(k / 50)).alias("y"))
    corner = [(F.col("x") + dx, F.col("y") + dy) for dx, dy in ((0, 0), (2, 0), (2, 0.5), (0, 0.5))]
    side = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    edges = land.select("iso", "ord", "ring", F.explode(F.array(*[side(corner[i], corner[(i + 1) % 4]) for i in range(4)])).alias("e")).select("iso", "ord", "ring", "e.*")
    return coverage.areas(coverage.tiers(edges, n.filter("r_name = 'EUROPE'"), n.filter("r_name = 'ASIA'"))).select("tier", "area")


_hits = dict(v_hits="SELECT origin, dest, min(trains) AS trains FROM o_journeys GROUP BY ALL", v_n="SELECT origin AS id, count(*) AS n FROM v_hits GROUP BY ALL")


@query("overlap_rank", "SELECT s.id, name, coalesce(n, 0) AS n_dest, row_number() OVER (ORDER BY coalesce(n, 0) DESC, lower(name), s.id)::INT AS rank FROM tt_stations s LEFT JOIN v_n USING (id)", **_hits)
def overlap_rank(spark, sf):
    rows = tt.stations(spark, sf).join(n_dest(spark, sf).withColumnRenamed("origin", "id"), "id", "left").withColumn("n_dest", F.coalesce("n_dest", F.lit(0).cast("long")))
    return client.ranked(rows, F.desc("n_dest")).select("id", "name", "n_dest", "rank")


@query("target_rank", "SELECT s.id, name, trains, row_number() OVER (ORDER BY trains IS NULL, trains, s.id % 13 DESC, lower(name), s.id)::INT AS rank FROM tt_stations s LEFT JOIN (SELECT dest AS id, trains FROM v_hits WHERE origin = 1) USING (id) WHERE s.id <> 1", **_hits)
def target_rank(spark, sf):
    return client.target_ranks(tt.stations(spark, sf).withColumn("n_dest", F.col("id") % 13), reach_journeys(spark, sf), 1)


@query("booking_target", """SELECT o_orderkey AS req, ok AS matched, CASE WHEN ok THEN 'https://results.example?origin=loc%3A' || (o_custkey % 50 * 7) || '&destination=loc%3A' || (o_orderkey % 50 * 7) || '&outwardDate=' || strftime(d, '%Y-%m-%d') || 'T06%3A00%3A00&passengers%5B%5D=1968-01-01' ELSE 'https://home.example' END AS url
  FROM (SELECT *, o_orderdate::DATE AS d, o_custkey % 50 % 3 <> 0 AND o_orderkey % 50 % 3 <> 0 AND o_orderkey % 4 <> 0 AND o_orderdate::DATE >= DATE '1997-12-31' AS ok FROM orders)""")
def booking_target(spark, sf):
    rows = tt.table(spark, sf, "orders").select(F.col("o_orderkey").alias("req"), (F.col("o_custkey") % 50).alias("from_id"), (F.col("o_orderkey") % 50).alias("to_id"), F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    ids = spark.range(50).filter("id % 3 <> 0").select("id", (F.col("id") * 7).cast("string").alias("code"))
    return views.booking_links(rows, ids, F.lit("1998-01-01").cast("date"), "https://home.example", "https://results.example")


# what readers derive

@query("journey_summaries", "SELECT origin, dest, trains, (duration // 60) || ' h' || CASE WHEN duration % 60 <> 0 THEN ' ' || (duration % 60) || ' min' ELSE '' END || ' · ' || CASE WHEN trains = 1 THEN 'nonstop' ELSE trains || ' trains' END AS summary FROM o_journeys")
def journey_summaries(spark, sf):
    return reach_journeys(spark, sf).select("origin", "dest", "trains", client.journey_summary(F.col("duration"), F.col("trains")).alias("summary"))


@query("date_labels", "SELECT o_orderkey, CASE d - DATE '1998-06-01' WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' ELSE strftime(d, '%a %-d %b') END AS label FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def date_labels(spark, sf):
    return tt.table(spark, sf, "orders").select("o_orderkey", client.date_label(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")).alias("label"))


@query("frequency_labels", """SELECT c_custkey, CASE WHEN c_custkey % 9 = 8 THEN (c_custkey % 4) || '× per day' WHEN trips = 0 THEN service WHEN dd = 7 AND rate IS NOT NULL THEN CASE WHEN rate = floor(rate) THEN floor(rate)::BIGINT::VARCHAR ELSE rate::VARCHAR END || ' direct trains per day · ' || service ELSE 'about ' || coalesce(weekly, 0) || ' direct trains per week · ' || service END AS label, CASE WHEN kind = 'limited' AND c_custkey % 9 <> 8 THEN 'infrequent' ELSE 'frequent' END AS class
  FROM (SELECT *, CASE kind WHEN 'coverage_limited' THEN 'limited feed coverage · route found on ' || days || '/7 covered dates' WHEN 'year_round' THEN 'available on every sampled date' ELSE CASE WHEN days > 0 THEN 'limited service · found on ' || days || '/7 selected dates' ELSE 'not running in the selected service week' END END AS service FROM f_rows)""",
    f_rows="SELECT c_custkey, c_custkey % 8 AS days, c_custkey % 5 AS trips, 3 + c_custkey % 5 AS dd, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 / 2 END AS rate, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 6 END AS weekly, ['coverage_limited', 'year_round', 'limited'][c_custkey % 3 + 1] AS kind FROM customer")
def frequency_labels(spark, sf):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("coverage_limited"), F.lit("year_round"), F.lit("limited")), (k % 3 + 1).cast("int"))
    f = F.struct((k % 8).alias("available_days"), F.lit(7).alias("sample_days"), (k % 5).alias("direct_trips"), (3 + k % 5).alias("direct_days"), F.when(k % 7 > 0, k % 7 / 2).alias("direct_per_active_day"), F.when(k % 6 > 0, k % 6).alias("weekly_direct_estimate"), kind.alias("availability"))
    rows = tt.table(spark, sf, "customer").select("c_custkey", F.when(k % 9 != 8, f).alias("f"))
    return rows.select("c_custkey", client.frequency_label(F.col("f"), k % 4).alias("label"), client.frequency_class(F.col("f.availability")).alias("class"))


@query("initial_trains", "SELECT c_custkey, CASE WHEN c_custkey % 6 BETWEEN 1 AND 3 THEN c_custkey % 6 WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END::INT AS trains FROM customer")
def initial_trains(spark, sf):
    k = F.col("c_custkey")
    rows = tt.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("?lang=en&trains="), (k % 6).cast("string"), F.lit("&trains=1")).alias("search"), F.when(k % 3 == 1, "www.two.example").otherwise("any.example").alias("host"))
    return rows.select("c_custkey", client.initial_trains(F.col("search"), F.col("host"), {"one.example": 1, "two.example": 2}).alias("trains"))


_groups = dict(z_groups="SELECT city, city_ord, id FROM (SELECT 'A' || (id % 4) AS city, id % 4 AS city_ord, id FROM tt_stations UNION ALL SELECT 'B' || (id % 6), 4 + id % 6, id FROM tt_stations WHERE id % 5 = 0 UNION ALL SELECT 'Lone', 99, 7)", z_size="SELECT city, count(*) AS n FROM z_groups GROUP BY ALL")


def _overlapping(spark, sf):
    s = tt.stations(spark, sf).select("id")
    one = s.select(F.concat(F.lit("A"), (F.col("id") % 4).cast("string")).alias("city"), (F.col("id") % 4).alias("city_ord"), "id")
    two = s.filter("id % 5 = 0").select(F.concat(F.lit("B"), (F.col("id") % 6).cast("string")).alias("city"), (4 + F.col("id") % 6).alias("city_ord"), "id")
    rows = one.unionByName(two).unionByName(spark.createDataFrame([("Lone", 99, 7)], "city string, city_ord long, id long"))
    return rows.groupBy("city", "city_ord").agg(F.sort_array(F.collect_list("id")).alias("ids"))


@query("popup_cities", "SELECT id, min_by(city, city_ord) AS city FROM z_groups JOIN z_size USING (city) WHERE n >= 2 GROUP BY id", **_groups)
def popup_cities(spark, sf):
    return client.popup_cities(_overlapping(spark, sf))


@query("city_lookup", "SELECT id, max_by(city, city_ord) AS city FROM z_groups GROUP BY id", **_groups)
def city_lookup(spark, sf):
    return client.city_lookup(_overlapping(spark, sf))


@query("city_options", "SELECT city, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT split_part(name, ' ', 1) AS city, stop_ord AS id FROM tt_raw_stops WHERE feed = 0) WHERE contains(lower(strip_accents(city)), 'ro') OR contains(lower(strip_accents(city)), 'co') OR city = 'Köln' GROUP BY city")
def city_options(spark, sf):
    g = tt.raw_stops(spark, sf).filter("feed = 0").groupBy(F.split_part("name", F.lit(" "), F.lit(1)).alias("city")).agg(F.sort_array(F.collect_set("stop_ord")).alias("ids"))
    return client.city_options(g, " Co ", {"Köln": ["Cologne"], "Praha": ["Prague"]}).select("city", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("swapped_selection", "SELECT DISTINCT s.id + 1 AS origin, CASE WHEN j.dest IS NOT NULL THEN s.id END AS dest FROM tt_stations s LEFT JOIN o_journeys j ON j.origin = s.id + 1 AND j.dest = s.id")
def swapped_selection(spark, sf):
    return client.swapped(reach_journeys(spark, sf), tt.stations(spark, sf).select(F.col("id").alias("origin"), (F.col("id") + 1).alias("dest")))


@query("overlap_choices", "SELECT id, CASE WHEN id % 3 = 0 THEN 'dest' ELSE 'origin' END AS pick, name, id % 17 AS n_dest, row_number() OVER (ORDER BY id % 17 DESC, lower(name), id)::INT AS rank FROM tt_stations WHERE id % 3 = 0 OR id % 10 = 0 OR id % 2 = 0")
def overlap_choices(spark, sf):
    s = tt.stations(spark, sf)
    layer = lambda name, rule: s.filter(rule).select(F.lit(name).alias("layer"), "id")
    hits = layer("all-stations", "id % 2 = 0").unionByName(layer("reach-dots", "id % 3 = 0")).unionByName(layer("capital-stars", "id % 10 = 0")).unionByName(layer("water", "id % 7 = 0"))
    return client.overlap_choices(hits, s.withColumn("n_dest", F.col("id") % 17))


@query("served_stations", "SELECT id, n IS NOT NULL AS has_reach FROM tt_stations LEFT JOIN v_n USING (id)", **_hits)
def served_stations(spark, sf):
    return client.with_reach(tt.stations(spark, sf), reach_journeys(spark, sf).select("origin")).select("id", "has_reach")


@query("transfer_points", "SELECT origin, dest, trains, leg, lon, lat FROM (SELECT *, max(leg) OVER (PARTITION BY origin, dest, trains) AS n FROM o_legs) JOIN tt_stations ON id = alight WHERE leg < n AND id % 9 <> 0")
def transfer_points(spark, sf):
    return client.transfer_points(_legs(spark, sf), tt.stations(spark, sf).filter("id % 9 <> 0"))


_shown = dict(
    s_shown="SELECT origin, dest, trains, duration, CASE WHEN duration < 180 THEN 0 WHEN duration < 360 THEN 1 WHEN duration < 600 THEN 2 ELSE 3 END AS bucket, (origin + dest) % 3 = 0 AS rare FROM (SELECT *, row_number() OVER (PARTITION BY origin, dest ORDER BY duration, trains) AS rn FROM o_journeys WHERE trains <= 2) WHERE rn = 1 AND duration <= 480",
    s_known="SELECT * FROM tt_stations WHERE id % 9 <> 0",
    s_stops="SELECT l.origin, l.dest, l.trains, leg, idx, station, lon, lat, duration, bucket, rare FROM o_legs l JOIN s_shown s ON s.origin = l.origin AND s.dest = l.dest AND s.trains = l.trains JOIN tt_slice c ON c.trip_id = l.trip_id AND idx BETWEEN board_idx AND alight_idx JOIN s_known ON id = station",
    s_hops="SELECT * FROM (SELECT *, lead(station) OVER (PARTITION BY origin, dest, trains, leg ORDER BY idx) AS b FROM s_stops) WHERE b IS NOT NULL",
)


def _shown_rows(journeys):
    kind = F.when((F.col("origin") + F.col("dest")) % 3 == 0, "limited").otherwise("year_round")
    return views.shown(journeys, 2, 480).withColumn("availability", kind)


def _known(spark, sf):
    return tt.stations(spark, sf).filter("id % 9 <> 0")


def _shown_legs(spark, sf):
    """(legs, shown, calls): the journeys that are shown, and their legs, of one search."""
    calls, labels, journeys = _search(spark, sf)
    shown = written(_shown_rows(journeys), "shown")
    chosen = journeys.join(shown.select("origin", "dest", "trains"), ["origin", "dest", "trains"], "left_semi")
    return reach.settled(reach.legs(labels, chosen), "legs"), shown, calls


@query("destination_points", "SELECT origin, dest AS id, name, lon, lat, duration, trains, bucket, (origin * dest % 7)::INT AS direct_per_day, CASE WHEN rare THEN 'infrequent' ELSE 'frequent' END AS frequency_class, id % 50 AS n_routes FROM s_shown JOIN s_known ON id = dest", **_shown)
def destination_points(spark, sf):
    j = written(reach_journeys(spark, sf), "journeys")
    facts = _shown_rows(j).select("origin", "dest", (F.col("origin") * F.col("dest") % 7).cast("int").alias("direct_per_day"), "availability")
    return client.destination_points(j, tt.stations(spark, sf).filter("id % 9 <> 0").withColumn("n_routes", F.col("id") % 50), 2, 480, facts)


@query("shared_segments", "SELECT origin, least(station::VARCHAR, b::VARCHAR) || '|' || greatest(station::VARCHAR, b::VARCHAR) AS hop, min(duration) AS duration, min(bucket) AS bucket, min(trains) AS trains, CASE WHEN bool_or(NOT rare) THEN 'frequent' ELSE 'infrequent' END AS frequency_class, min_by(station, (dest, leg, idx)) AS a, min_by(b, (dest, leg, idx)) AS b FROM s_hops GROUP BY ALL", **_shown)
def shared_segments(spark, sf):
    legs, shown, calls = _shown_legs(spark, sf)
    return client.shared_segments(client.hops_of_legs(legs, calls, _known(spark, sf)), shown).select("origin", "hop", "duration", "bucket", "trains", "frequency_class", "a", "b")


@query("journey_lines", "SELECT origin, dest, trains, min(bucket) AS bucket, count(*) - count(DISTINCT leg) + 1 AS n_points, round(sum(lon) - sum(CASE WHEN again THEN lon ELSE 0 END), 6) AS lon_sum FROM (SELECT *, leg > 1 AND row_number() OVER (PARTITION BY origin, dest, trains, leg ORDER BY idx) = 1 AND leg > min(leg) OVER (PARTITION BY origin, dest, trains) AS again FROM s_stops) GROUP BY origin, dest, trains HAVING count(*) - count(DISTINCT leg) + 1 >= 2", **_shown)
def journey_lines(spark, sf):
    legs, shown, calls = _shown_legs(spark, sf)
    lines = client.journey_lines(client.leg_stops(legs, calls, _known(spark, sf)), shown)
    return lines.select("origin", "dest", "trains", "bucket", F.size("line").cast("long").alias("n_points"), F.round(F.aggregate("line", F.lit(0.0), lambda a, x: a + x[0]), 6).alias("lon_sum"))


_km = "sqrt(pow((lon - lag(lon) OVER w) * 111.32 * cos(radians((lat + lag(lat) OVER w) / 2)), 2) + pow((lat - lag(lat) OVER w) * 111.32, 2))"
_turn = "degrees(atan2(({1}.lon - {0}.lon) * cos(radians(({0}.lat + {1}.lat) / 2)), {1}.lat - {0}.lat))"
_ride = _shown | dict(
    k_steps=f"SELECT origin, dest, leg, lon, lat, row_number() OVER w AS i, coalesce({_km}, 0) AS step FROM s_stops WINDOW w AS (PARTITION BY origin, dest, leg ORDER BY idx)",
    k_way="SELECT *, sum(step) OVER (PARTITION BY origin, dest, leg ORDER BY i ROWS UNBOUNDED PRECEDING) AS km, count(*) OVER (PARTITION BY origin, dest, leg) AS n FROM k_steps",
    k_legs="SELECT origin, dest, leg, n, km AS total, sum(km) OVER (PARTITION BY origin, dest) AS whole, CASE WHEN lead(leg) OVER (PARTITION BY origin, dest ORDER BY leg) IS NULL THEN 1000 ELSE 500 END AS rest FROM k_way WHERE i = n AND n >= 2",
    k_phases="SELECT *, 7000 * total / whole AS move, coalesce(sum(7000 * total / whole + rest) OVER (PARTITION BY origin, dest ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k_legs WHERE whole > 0",
    k_times="SELECT origin, dest, ms, ms % max(start + move + rest) AS t FROM k_phases, (VALUES (0.25), (2250.25), (5100.25), (7300.25), (9000.25)) v(ms) GROUP BY origin, dest, ms",
    k_now="SELECT p.*, ms, t, t < start + move AS moving, pow((t - start) / move, 2) * (3 - 2 * (t - start) / move) * total AS gone FROM k_phases p JOIN k_times u ON u.origin = p.origin AND u.dest = p.dest AND t >= start AND t < start + move + rest",
    k_asked="SELECT origin, dest, ms, leg, d, greatest(0, least(total, gone + d)) AS gone FROM k_now, (VALUES (-0.35), (0.0), (0.35)) v(d) WHERE moving",
    # the first point that isn't before the place asked for, from the second on
    k_ends="SELECT a.origin, a.dest, ms, a.leg, d, a.gone, min(i) AS i FROM k_asked a JOIN k_way w ON w.origin = a.origin AND w.dest = a.dest AND w.leg = a.leg AND i >= 2 AND (km >= a.gone OR i = n) GROUP BY ALL",
    k_places="SELECT e.origin, e.dest, ms, d, x.lon + (y.lon - x.lon) * coalesce((e.gone - x.km) / nullif(y.km - x.km, 0), 0) AS lon, x.lat + (y.lat - x.lat) * coalesce((e.gone - x.km) / nullif(y.km - x.km, 0), 0) AS lat FROM k_ends e JOIN k_way x ON x.origin = e.origin AND x.dest = e.dest AND x.leg = e.leg AND x.i = e.i - 1 JOIN k_way y ON y.origin = e.origin AND y.dest = e.dest AND y.leg = e.leg AND y.i = e.i",
)


@query("journey_ride", f"""SELECT origin, dest, ms::DOUBLE AS ms, round(h.lon, 6) AS lon, round(h.lat, 6) AS lat, round({_turn.format('b', 'f')}, 4) AS bearing, true AS moving FROM k_places h JOIN k_places b USING (origin, dest, ms) JOIN k_places f USING (origin, dest, ms) WHERE h.d = 0 AND b.d < 0 AND f.d > 0
  UNION ALL SELECT p.origin, p.dest, ms::DOUBLE, round(y.lon, 6), round(y.lat, 6), round({_turn.format('x', 'y')}, 4), false FROM k_now p JOIN k_way x ON x.origin = p.origin AND x.dest = p.dest AND x.leg = p.leg AND x.i = p.n - 1 JOIN k_way y ON y.origin = p.origin AND y.dest = p.dest AND y.leg = p.leg AND y.i = p.n WHERE NOT moving""", **_ride)
def journey_ride(spark, sf):
    """Where a rider of each shown journey is at five moments; a leg's way leads straight from stop to stop."""
    key = ["origin", "dest", "leg"]
    legs, _, calls = _shown_legs(spark, sf)
    stops = client.leg_stops(legs, calls, _known(spark, sf))
    path = F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))  # the stops of a leg
    paths = stops.groupBy(*key).agg(path.alias("path")).select(F.struct("origin", "dest").alias("journey"), "leg", "path")
    phases = written(client.ride_phases(paths), "phases")
    times = phases.select("journey").distinct().select("journey", F.explode(F.array(*[F.lit(t) for t in (0.25, 2250.25, 5100.25, 7300.25, 9000.25)])).alias("ms"))
    at = client.ride_at(phases, times)
    return at.select("journey.origin", "journey.dest", "ms", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("bearing", 4).alias("bearing"), "moving")


_r = "sqrt(s_suppkey % 90)"


@query("dot_sizes", f"SELECT s_suppkey, round(CASE WHEN {_r} < 2 THEN 2 + 0.6 * {_r} / 2 WHEN {_r} < 4 THEN 2.6 + 1.9 * ({_r} - 2) / 2 WHEN {_r} < sqrt(74) THEN 4.5 + 4.5 * ({_r} - 4) / (sqrt(74) - 4) ELSE 9 END, 6) AS size, round(CASE WHEN z < 4 THEN f(150) WHEN z < 5.5 THEN f(150) + (f(50) - f(150)) * (z - 4) / 1.5 WHEN z < 7 THEN f(50) + (f(10) - f(50)) * (z - 5.5) / 1.5 WHEN z < 9 THEN f(10) + (0.7 - f(10)) * (z - 7) / 2 ELSE 0.7 END, 6) AS opacity FROM (SELECT s_suppkey, s_suppkey % 12 / 1.2 AS z, s_suppkey * 7 % 200 AS n FROM supplier)".replace("f(150)", "(CASE WHEN n >= 150 THEN 0.7 ELSE 0 END)").replace("f(50)", "(CASE WHEN n >= 50 THEN 0.7 ELSE 0 END)").replace("f(10)", "(CASE WHEN n >= 10 THEN 0.7 ELSE 0 END)"))
def dot_sizes(spark, sf):
    k = F.col("s_suppkey")
    return tt.table(spark, sf, "supplier").select("s_suppkey", F.round(client.dot_size(k % 90), 6).alias("size"), F.round(client.dot_opacity(k * 7 % 200, k % 12 / 1.2), 6).alias("opacity"))


@query("events_hourly_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly_tumbling(spark, sf):
    return ev.hourly(tt.table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query(
    "published_horizon",
    """SELECT service, start, until, n_seen, CASE WHEN until >= now - INTERVAL 2 HOUR THEN 'open' WHEN n_seen > 0 THEN 'present' ELSE 'absent' END AS verdict FROM (SELECT w.service, w.start, w.until, count(DISTINCT s.ts) AS n_seen FROM z_windows w LEFT JOIN z_rows s ON s.service = w.service AND s.kind = 'seen' AND s.ts BETWEEN w.start AND w.until GROUP BY ALL), (SELECT max(ts) AS now FROM z_rows WHERE kind <> 'other')""",
    z_rows="SELECT user_id AS service, CASE event_type WHEN 'signup' THEN 'publish' WHEN 'view' THEN 'seen' ELSE 'other' END AS kind, date_trunc('millisecond', ts) AS ts, date_trunc('millisecond', ts + to_minutes(30 + event_id % 7 * 600)) AS until FROM events",
    z_windows="SELECT DISTINCT service, ts AS start, until FROM z_rows WHERE kind = 'publish'",
)
def published_horizon(spark, sf):
    """Each signup publishes a window in which its user is expected, views are sightings."""
    kind = F.when(F.col("event_type") == "signup", "publish").when(F.col("event_type") == "view", "seen").otherwise("other")
    until = F.col("ts") + F.make_dt_interval(mins=(30 + F.col("event_id") % 7 * 600).cast("int"))
    rows = tt.table(spark, sf, "events").select(F.col("user_id").alias("service"), kind.alias("kind"), "ts", until.alias("until"))
    return horizon.verdicts(rows, 7200)
