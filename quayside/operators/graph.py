"""From feed archives to a graph: filters, labels, times and stops of each feed, one registry of stations, joined trips by day.

Everything is keyed by feed until stations are merged, so equal ids of two feeds never meet."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.text import code_of
from quayside.operators import calendar, feeds, resolve
from quayside.sources import gtfs, netex, sinks
from quayside.sources.scratch import written

#: The day under which services stand that run on none of the sampled days.
EXTRA = "extra"


@dataclass(frozen=True)
class Feed:
    """What configuration says of a feed; its place among others is its precedence."""

    country: str | None
    route_allow: list[str]
    format: str = "gtfs"
    trip_allow: list[str] | None = None
    stop_id_allow: list[str] | None = None
    stop_id_brand: dict[str, str] | None = None
    code_pattern: str | None = None


def configured(conf: dict) -> dict[str, Feed]:
    """Feeds of a configuration's table, in its order."""
    return {n: Feed(c.get("country"), c["route_allow"], c.get("format", "gtfs"), c.get("trip_allow"), c.get("stop_id_allow"), c.get("stop_id_brand"), c.get("uic_regex")) for n, c in conf.get("feeds", {}).items()}


def scan(spark: SparkSession, paths: str | list[str], conf: dict[str, Feed]) -> dict[str, DataFrame]:
    """The members of the configured feeds' archives, each written once."""
    known = F.col("feed").isin([n for n, f in conf.items() if f.format == "gtfs"])
    return {m: written(gtfs.member(spark, paths, m).filter(known), f"member-{m}") for m in gtfs.MEMBERS}


def running(members: dict[str, DataFrame], days: list[datetime.date]) -> tuple[DataFrame, DataFrame]:
    """(feed, day, service_id) of the sampled days and, as day EXTRA, of services that run on none; and validity (day, feed, covered,
    sampled): whether a feed's published window holds a day. Feeds without a window hold all days; days outside have no services."""
    spark = members["trips"].sparkSession
    cal, exc = written(gtfs.calendar(members["calendar"]), "calendar"), written(gtfs.calendar_dates(members["calendar_dates"]), "exceptions")
    asked = spark.createDataFrame([(d,) for d in days], "date date")
    names = members["trips"].select("feed").distinct()
    window = written(names.join(calendar.window(cal, exc), "feed", "left"), "windows")
    covered = F.col("first_day").isNull() | F.col("date").between(F.col("first_day"), F.col("last_day"))
    valid = window.join(F.broadcast(asked), F.lit(True)).select("feed", "date", covered.alias("covered"))  # feeds by sampled days
    active = written(calendar.active(cal, exc, asked).join(valid.filter("covered"), ["feed", "date"], "left_semi"), "active")
    # a feed without a covered day has no sample to be absent from
    sampled = valid.filter("covered").select("feed").distinct()
    absent = calendar.absent(cal, exc, active).join(sampled, "feed", "left_semi")
    services = active.select("feed", F.col("date").cast("string").alias("day"), "service_id").unionByName(absent.select("feed", F.lit(EXTRA).alias("day"), "service_id"))
    return written(services, "services"), valid.select(F.col("date").cast("string").alias("day"), "feed", "covered", F.col("covered").alias("sampled"))


def body(members: dict[str, DataFrame], conf: dict[str, Feed], services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trips, calls) of all feeds, of the services that run on any day: trips of allowed routes, names and stops under their
    label; calls with their time on the reference clock and the topmost parent of their stop.

    trips: feed, trip_id, service_id, train, trip_ord; calls: feed, trip_id, idx, raw_id, stop_id, arr, dep."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    routes = feeds.allowed_routes(members["routes"].select("feed", "route_id", "row_order", text("route_short_name").alias("short_name"), text("route_long_name").alias("long_name")), {n: f.route_allow for n, f in conf.items()})
    some = services.select("feed", "service_id").distinct()
    trips = members["trips"].join(routes, ["feed", "route_id"]).join(some, ["feed", "service_id"], "left_semi")
    trips = feeds.allowed_trips(trips.withColumn("short_name", text("trip_short_name")), {n: f.trip_allow for n, f in conf.items()})
    trips = trips.groupBy("feed", "trip_id").agg(F.max_by(F.struct("service_id", "label", text("trip_headsign").alias("headsign")), "row_order").alias("m")).select("feed", "trip_id", "m.*")
    trips = written(trips, "trips")
    times = members["stop_times"].join(trips.select("feed", "trip_id"), ["feed", "trip_id"], "left_semi")
    timed = feeds.timed(times.select("feed", "trip_id", "row_order", F.col("stop_sequence").cast("int").alias("seq"), F.col("stop_id").alias("raw_id"), F.col("arrival_time").alias("arrival"), F.col("departure_time").alias("departure")))
    shift = F.coalesce("shift", F.lit(0))
    timed = timed.join(F.broadcast(feeds.feed_shifts(members["agency"])), "feed", "left").withColumns({"arr": F.col("arr") + shift, "dep": F.col("dep") + shift}).drop("shift")  # a row for each feed
    calls = timed.withColumn("idx", F.row_number().over(W.partitionBy("feed", "trip_id").orderBy("seq", "row_order")))
    calls = written(calls.select("feed", "trip_id", "idx", "raw_id", "arr", "dep", "row_order"), "calls")
    # patterns of stops are of ids before parents are followed
    allow = {n: f.stop_id_allow or (list(f.stop_id_brand) if f.stop_id_brand else None) for n, f in conf.items()}
    raw = calls.select("feed", "trip_id", "idx", F.col("raw_id").alias("stop_id"))
    kept = trips.join(feeds.stop_allowed_trips(raw, allow), ["feed", "trip_id"], "left_semi")
    branded = [feeds.brands(raw.filter(F.col("feed") == n), list(f.stop_id_brand.items())) for n, f in conf.items() if f.stop_id_brand]
    if branded:
        kept = kept.join(reduce(DataFrame.unionByName, branded), ["feed", "trip_id"], "left")
        kept = kept.withColumn("label", F.when(F.col("brand").isNotNull(), feeds.branded_label(F.col("brand"), F.col("headsign"), F.col("label"))).otherwise(F.col("label")))
    order = calls.groupBy("feed", "trip_id").agg(F.min("row_order").alias("trip_ord"))
    kept = kept.join(order, ["feed", "trip_id"]).select("feed", "trip_id", "service_id", F.col("label").alias("train"), "trip_ord")
    parents = feeds.topmost(_stops(members).select("feed", "stop_id", F.col("parent_station").alias("parent")))
    calls = calls.join(parents.withColumnRenamed("stop_id", "raw_id"), ["feed", "raw_id"], "left").withColumn("stop_id", F.coalesce("station", "raw_id"))
    return written(kept, "kept-trips"), written(calls.join(kept.select("feed", "trip_id"), ["feed", "trip_id"], "left_semi").select("feed", "trip_id", "idx", "raw_id", "stop_id", "arr", "dep"), "kept-calls")


def _stops(members: DataFrame) -> DataFrame:
    """Stops of all feeds; of rows with one id the last counts, at the place of the first."""
    g = members["stops"].groupBy("feed", "stop_id").agg(F.max_by(F.struct("stop_name", "stop_lat", "stop_lon", "parent_station"), "row_order").alias("m"), F.min("row_order").alias("row_order"))
    return g.select("feed", "stop_id", "row_order", "m.*")


def by_day(trips: DataFrame, calls: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """trips and calls of each day on which their service runs."""
    daily = written(trips.join(services, ["feed", "service_id"]), "daily-trips")
    return daily, calls.join(daily.select("feed", "trip_id", "day"), ["feed", "trip_id"])


def used_stops(members: dict[str, DataFrame], daily_calls: DataFrame, day_order: dict[str, int]) -> DataFrame:
    """feed, day_ord, row_order, stop_id, name, lat, lon: stops of each day that calls use, under the shortest of their own and
    their used children's names that day; a blank or zero position is none."""
    stops = _stops(members)
    used = daily_calls.select("feed", "day", "raw_id", "stop_id").distinct()
    own = used.select("feed", "day", "stop_id").distinct().join(stops, ["feed", "stop_id"])
    child = used.join(stops.select("feed", F.col("stop_id").alias("raw_id"), "stop_name"), ["feed", "raw_id"]).select("feed", "day", F.col("stop_id").alias("station"), F.col("stop_name").alias("name"))
    names = feeds.display_names(child.unionByName(own.select("feed", "day", F.col("stop_id").alias("station"), F.col("stop_name").alias("name"))))
    lat, lon = feeds.stub_coordinates(F.col("stop_lat"), F.col("stop_lon"))
    place = F.create_map(*[F.lit(x) for kv in day_order.items() for x in kv])
    return own.join(names.withColumnRenamed("station", "stop_id"), ["feed", "day", "stop_id"], "left").select("feed", place[F.col("day")].alias("day_ord"), "row_order", "stop_id", F.coalesce("name", "stop_name").alias("name"), lat.alias("lat"), lon.alias("lon"))


def publication_days(spark: SparkSession, paths: dict[str, str], conf: dict[str, Feed], days: list[datetime.date]) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(trips, calls, stops) by day of XML publications {feed: path}, in the form of by_day and used_stops; None without any."""
    out = []
    for feed, path in paths.items():
        found = written(netex.journeys(spark, path, conf[feed].route_allow).withColumn("feed", F.lit(feed)), "journeys")
        bits = netex.day_bits(netex.elements(spark, path, "UicOperatingPeriod"), netex.elements(spark, path, "DayTypeAssignment")).withColumn("feed", F.lit(feed))
        daily = reduce(DataFrame.unionByName, [netex.on_day(found, bits, F.lit(d)).withColumns({"day": F.lit(str(d)), "day_ord": F.lit(k)}) for k, d in enumerate(days)])
        daily = written(daily, "publication-days")
        calls = daily.select("feed", "day", "day_ord", "trip_id", F.explode("calls").alias("c")).select("feed", "day", "day_ord", "trip_id", "c.idx", "c.stop_id", "c.arr", "c.dep")
        places = netex.stops(netex.elements(spark, path, "StopPlace"), netex.elements(spark, path, "ScheduledStopPoint")).drop("feed")
        at = places.withColumn("row_order", F.lit(0).cast("long"))
        stops = calls.select("feed", "day_ord", "stop_id").distinct().join(at, "stop_id").select("feed", "day_ord", "row_order", "stop_id", "name", "lat", "lon")
        trips = daily.select("feed", "trip_id", "train", F.col("row_order").alias("trip_ord"), "day")
        out.append((trips, calls.select("feed", "day", "trip_id", "idx", "stop_id", "arr", "dep"), stops))
    return tuple(reduce(DataFrame.unionByName, x) for x in zip(*out, strict=True)) if out else None


@dataclass
class Graph:
    """stations: id, name, country, lat, lon. trips: day, trip_id, train, feeds. calls: day, trip_id, idx, station, arr, dep.
    issues: kind, detail. audit: of countries. validity: day, feed, covered, sampled. unmapped: feed, stop_id, n_calls."""

    stations: DataFrame
    trips: DataFrame
    calls: DataFrame
    issues: DataFrame
    audit: DataFrame | None
    validity: DataFrame
    unmapped: DataFrame


def build(spark: SparkSession, archives: str | list[str] | None, conf: dict[str, Feed], days: list[datetime.date], aliases: dict[str, str] | None = None, names: dict[str, str] | None = None, edges: DataFrame | None = None, overrides: DataFrame | None = None, publications: dict[str, str] | None = None) -> Graph:
    """The graph of all feeds over the sampled days. Raises feeds.InvalidGraph if stations lie at zero or trips go back in time."""
    feed_order = {n: k for k, n in enumerate(conf)}
    day_order = {str(d): k for k, d in enumerate(days)} | {EXTRA: len(days)}
    parts = []
    validity = spark.createDataFrame([], "day string, feed string, covered boolean, sampled boolean")
    if archives:
        members = scan(spark, archives, conf)
        services, validity = running(members, days)
        trips, calls = by_day(*body(members, conf, services), services)
        parts.append((trips.select("feed", "trip_id", "train", "trip_ord", "day"), calls.select("feed", "day", "trip_id", "idx", "stop_id", "arr", "dep"), used_stops(members, calls, day_order)))
    if found := publication_days(spark, publications or {}, conf, days):
        parts.append(found)
    trips, calls, stops = (written(reduce(DataFrame.unionByName, x), "all-days") for x in zip(*parts, strict=True))
    # one registry: feeds in their order, a feed's stops by the first day and the file
    place = F.create_map(*[F.lit(x) for kv in feed_order.items() for x in kv])
    code = F.lit(None).cast("string")
    for n, f in conf.items():
        if f.code_pattern:
            code = F.when(F.col("feed") == n, code_of(F.col("stop_id"), f.code_pattern)).otherwise(code)
    country = F.create_map(*[F.lit(x) for n, f in conf.items() for x in (n, f.country or "")])
    once = feeds.first_seen(stops).withColumn("feed_ord", place[F.col("feed")])
    rank = F.row_number().over(W.partitionBy("feed_ord").orderBy("day_ord", "row_order", "stop_id"))
    once = once.select((F.col("feed_ord").cast("long") * (1 << 40) + rank).alias("ord"), "feed", "stop_id", "name", code.alias("code"), F.nullif(country[F.col("feed")], F.lit("")).alias("country"), "lat", "lon")
    once = written(once, "registry")
    stations, mapping, issues = resolve.merge_stations(once, resolve.Aliases(aliases or {}), feed_order)
    mapping, audit = written(mapping, "mapping"), None
    if edges is not None:
        none = spark.createDataFrame([], "ord int, o_name string, o_lat double, o_lon double, country string")
        stations, audit = resolve.assign_countries(stations, edges, overrides if overrides is not None else none)
    stations, more = resolve.renamed(stations, names or {}, mapping, once)
    stations = written(stations.drop("ord"), "stations")
    lost = feeds.unmapped(calls, mapping)
    calls = written(feeds.remapped(calls, mapping), "remapped")
    trips = written(trips.join(calls.select("feed", "day", "trip_id").distinct(), ["feed", "day", "trip_id"], "left_semi"), "trips")
    # trips of all days as numbers, in the order of days, feeds and files
    own = F.row_number().over(W.partitionBy("day", "feed").orderBy("trip_ord", "trip_id"))
    number = (F.create_map(*[F.lit(x) for kv in day_order.items() for x in kv])[F.col("day")].cast("long") * 1024 + place[F.col("feed")]) * (1 << 40) + own
    ids = written(trips.withColumn("n", number), "numbers")
    numbered = calls.join(ids.select("feed", "day", "trip_id", F.col("n").alias("num")), ["feed", "day", "trip_id"]).select(F.col("num").alias("trip_id"), "idx", "station", "arr", "dep", "day")
    numbered = written(numbered, "numbered")
    labels = ids.select(F.col("n").alias("trip_id"), F.concat_ws("|", "train", "day").alias("train"))
    joined = resolve.join_through(labels.filter(F.col("train").rlike("(?U)\\d.*\\|")), numbered)
    members_of = written(joined.unionByName(ids.select(F.col("n").alias("head")).join(joined.select(F.explode("members").alias("head")), "head", "left_anti").select("head", F.array("head").alias("members"))), "joined")
    out = resolve.through_calls(members_of, numbered)
    names_of = resolve.through_trips(members_of, ids.select(F.col("n").alias("trip_id"), "train", "feed"))
    real = members_of.select("head", F.posexplode("members").alias("pos", "n")).join(ids.select("n", "trip_id"), "n").groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "trip_id"))), lambda x: x["trip_id"]), "+").alias("trip_id"))  # the members of one service
    day_of = ids.select(F.col("n").alias("head"), "day", F.col("n").alias("trip_ord"))
    trips = written(names_of.drop("trip_id").join(real, "head").join(day_of, "head").select("day", "head", "trip_id", "train", "feeds", "trip_ord"), "graph-trips")
    calls = written(out.join(trips.select("head", "day", "trip_id", "trip_ord"), "head").select("day", "trip_id", "trip_ord", "idx", "station", "arr", "dep"), "graph-calls")
    feeds.validated(stations, calls.filter(F.col("day") != EXTRA))
    twins = resolve.duplicates(stations.withColumn("ord", F.col("id")))
    doubled = twins.select(F.lit("unmerged_duplicate").alias("kind"), F.concat_ws(" / ", "ord", "other").alias("detail"))
    return Graph(stations, trips.drop("head"), calls, issues.unionByName(more).unionByName(doubled), audit, validity, lost)


def write(graph: Graph, path: str) -> None:
    """The graph under path: calls and trips by day, and its small tables."""
    sinks.write_graph(graph.calls, f"{path}/calls")
    graph.trips.write.mode("overwrite").partitionBy("day").parquet(f"{path}/trips")
    for name in ("stations", "issues", "validity"):
        sinks.write_small(getattr(graph, name), f"{path}/{name}")
