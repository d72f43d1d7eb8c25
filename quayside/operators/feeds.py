"""From raw feed tables to a timetable: filters, labels, times, stops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.text import minutes_of
from quayside.sources.scratch import written


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; classes follow Unicode."""
    return reduce(lambda a, b: a | b, [text.rlike(f"(?U){p}") for p in patterns], F.lit(False))


def by_feed(rules: dict[str, list[str] | None], text: Column, otherwise: bool) -> Column:
    """Whether text matches any pattern of its row's feed; feeds without patterns give `otherwise`."""
    out = F.lit(otherwise)
    for feed, patterns in rules.items():  # configuration
        if patterns is not None:
            out = F.when(F.col("feed") == feed, any_match(text, patterns)).otherwise(out)
    return out


def _feed(*frames: DataFrame) -> list[str]:
    """The feed as a key where all frames have it: ids are a feed's own."""
    return ["feed"] if all("feed" in f.columns for f in frames) else []


def allowed_routes(routes: DataFrame, patterns: list[str] | dict[str, list[str] | None]) -> DataFrame:
    """Routes whose short or long name matches; the last row of a route_id that passes wins; label is short, else long.
    Patterns are for all rows or, by feed, for its rows."""
    short, long = F.coalesce("short_name", F.lit("")), F.coalesce("long_name", F.lit(""))
    hit = (lambda c: by_feed(patterns, c, False)) if isinstance(patterns, dict) else (lambda c: any_match(c, patterns))
    kept = routes.filter(hit(short) | hit(long)).withColumn("label", F.when(short != "", short).otherwise(long))
    key = [*_feed(routes), "route_id"]
    return kept.groupBy(*key).agg(F.max(F.struct("row_order", "label")).alias("m")).select(*key, "m.label")


def allowed_trips(trips: DataFrame, patterns: dict[str, list[str] | None]) -> DataFrame:
    """Trips (feed, short_name, label): of feeds with patterns those whose short name matches, under that name."""
    short = F.coalesce("short_name", F.lit(""))
    strict = F.col("feed").isin([f for f, p in patterns.items() if p is not None])
    return trips.filter(by_feed(patterns, short, True)).withColumn("label", F.when(strict, short).otherwise(F.col("label")))


def stop_allowed_trips(calls: DataFrame, patterns: dict[str, list[str] | None]) -> DataFrame:
    """feed, trip_id of trips with any call at a matching stop id; all trips of feeds without patterns."""
    return calls.groupBy("feed", "trip_id").agg(F.bool_or(by_feed(patterns, F.col("stop_id"), True)).alias("ok")).filter("ok").select("feed", "trip_id")


def brands(calls: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """trip_id, brand: of the first call that matches any pattern, the first pattern of the table; trips without one go."""
    first = F.coalesce(*[F.when(F.col("stop_id").rlike(f"(?U){p}"), F.struct(F.lit(k).alias("k"), F.lit(b).alias("brand"))) for k, (p, b) in enumerate(table)])
    key = [*_feed(calls), "trip_id"]
    return calls.withColumn("b", first).filter("b is not null").groupBy(*key).agg(F.min(F.struct("idx", "b")).alias("m")).select(*key, F.col("m.b.brand").alias("brand"))


def branded_label(brand: Column, headsign: Column, label: Column) -> Column:
    return F.when(F.coalesce(headsign, F.lit("")) == "", label).otherwise(F.concat_ws(" ", brand, headsign))


def timed(calls: DataFrame) -> DataFrame:
    """Minutes of arrival and departure; one stands for the other, rows with neither go."""
    a, d = F.nullif(F.trim("arrival"), F.lit("")), F.nullif(F.trim("departure"), F.lit(""))
    return calls.withColumns({"arr": minutes_of(F.coalesce(a, d)), "dep": minutes_of(F.coalesce(d, a))}).filter(a.isNotNull() | d.isNotNull()).drop("arrival", "departure")


def zones() -> list[str]:
    """Names of time zones that the JVM knows."""
    from pyspark.sql import SparkSession

    return sorted(SparkSession.getActiveSession().sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def zone_shift(zone: Column, reference: str = "Europe/Berlin", year: int = 2026) -> Column:
    """Minutes to add to a feed's clock to be on the reference clock; the winter probe wins where summer differs; 0 for a null, blank or unknown zone."""
    noon = F.lit(f"{year}-01-15 12:00:00").cast("timestamp_ntz")
    known = F.when(zone.isin(zones()), zone)
    there = F.convert_timezone(F.coalesce(known, F.lit(reference)), F.lit(reference), noon)
    return F.coalesce(F.timestamp_diff("MINUTE", noon, there).cast("int"), F.lit(0))


def feed_shifts(agencies: DataFrame) -> DataFrame:
    """feed, shift: by the zone of each feed's first agency row."""
    first = agencies.groupBy("feed").agg(F.min_by("agency_timezone", "row_order").alias("zone"))
    return first.select("feed", zone_shift(F.col("zone")).alias("shift"))


def topmost(stops: DataFrame) -> DataFrame:
    """stop_id, station: parents followed to the top, however far; an unknown parent keeps the child, and in a circle the
    walk ends at the last stop before it would come back to one it has seen.

    Pointers are doubled, so a chain of n takes log n rounds; rows that this leaves open lead to circles and are walked."""
    key = _feed(stops)
    known = stops.select(*key, F.col("stop_id").alias("up")).distinct()
    parents = stops.select(*key, F.col("stop_id").alias("at"), F.nullif("parent", F.lit("")).alias("up")).join(known, [*key, "up"], "left_semi").select(*key, "at", "up")
    parents = written(parents.dropDuplicates([*key, "at"]), "parents")
    own = stops.select(*key, "stop_id").distinct()
    # `at` of each stop, and whether that has a parent of its own
    rows = own.join(parents.withColumnRenamed("at", "stop_id"), [*key, "stop_id"], "left").select(*key, "stop_id", F.coalesce("up", "stop_id").alias("at"))
    has = parents.select(*key, "at", F.lit(True).alias("open"))
    rows = written(rows.join(has, [*key, "at"], "left").select(*key, "stop_id", "at", F.coalesce("open", F.lit(False)).alias("open")), "topmost")
    left = rows.filter("open").count()
    while left:
        ahead = rows.select(*key, F.col("stop_id").alias("at"), F.col("at").alias("to"), F.col("open").alias("on"))
        moved = rows.filter("open").join(ahead, [*key, "at"]).select(*key, "stop_id", F.col("to").alias("at"), F.col("on").alias("open"))
        rows = written(rows.filter("not open").unionByName(moved), "topmost")
        now = rows.filter("open").count()
        if now == left:  # in a chain the deepest stops of each length come out every round
            break
        left = now
    done = rows.filter("not open").select(*key, "stop_id", F.col("at").alias("station"))
    if not left:
        return done
    walk = rows.filter("open").select(*key, "stop_id", F.col("stop_id").alias("at"), F.array("stop_id").alias("path"), F.lit(False).alias("over"))
    while True:
        step = walk.filter("not over").join(parents, [*key, "at"])
        again = F.array_contains("path", F.col("up"))
        step = step.select(*key, "stop_id", F.when(again, F.col("at")).otherwise(F.col("up")).alias("at"), F.when(again, F.col("path")).otherwise(F.array_append("path", F.col("up"))).alias("path"), again.alias("over"))
        walk = written(walk.filter("over").unionByName(step), "circles")
        if walk.filter("not over").isEmpty():
            return done.unionByName(walk.select(*key, "stop_id", F.col("at").alias("station")))


def display_names(names: DataFrame) -> DataFrame:
    """station, name: the shortest, then least, of its own and its used children's names."""
    key = [*_feed(names), *(c for c in ("day",) if c in names.columns), "station"]
    return names.filter("name is not null and name <> ''").groupBy(*key).agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("m")).select(*key, "m.name")


def remapped(calls: DataFrame, mapping: DataFrame) -> DataFrame:
    """Calls at canonical stations; unmapped calls go, then trips of fewer than two calls; idx counts anew."""
    key = [*_feed(calls, mapping), "stop_id"]
    trip = [*_feed(calls), *(c for c in ("day",) if c in calls.columns), "trip_id"]
    rows = calls.join(mapping, key)
    kept = rows.withColumns({"idx": F.row_number().over(W.partitionBy(*trip).orderBy("idx")), "n": F.count("*").over(W.partitionBy(*trip))})
    return kept.filter("n >= 2").select(*trip, "idx", "station", "arr", "dep")


def unmapped(calls: DataFrame, mapping: DataFrame) -> DataFrame:
    """What remapped leaves out: stops without a station with their calls, by feed."""
    key = [*_feed(calls, mapping), "stop_id"]
    return calls.join(mapping, key, "left_anti").groupBy(*key).agg(F.count("*").alias("n_calls"))


def backward_trips(calls: DataFrame) -> DataFrame:
    """Trips that arrive somewhere before they left the call before: one row each."""
    trip = [*_feed(calls), *(c for c in ("day",) if c in calls.columns), "trip_id"]
    before = F.lag("dep").over(W.partitionBy(*trip).orderBy("idx"))
    return calls.withColumn("before", before).filter("arr < before").groupBy(*trip).agg(F.min("idx").alias("first_idx"))


def near_zero(stations: DataFrame) -> DataFrame:
    """Stations at (0, 0), which is no place but a missing position."""
    return stations.filter((F.abs("lat") < 0.01) & (F.abs("lon") < 0.01))


class InvalidGraph(ValueError):
    """Problems that must not be published."""


def problems(stations: DataFrame, calls: DataFrame) -> DataFrame:
    """kind, id of stations near zero and of trips that go back in time."""
    late = backward_trips(calls)
    return near_zero(stations).select(F.lit("near zero").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(late.select(F.lit("times go back").alias("kind"), F.col("trip_id").cast("string").alias("id")))


def validated(stations: DataFrame, calls: DataFrame) -> None:
    """Raise InvalidGraph, naming some, if there are problems."""
    if found := problems(stations, calls).orderBy("kind", "id").limit(20).collect():
        raise InvalidGraph("; ".join(f"{r.kind}: {r.id}" for r in found))


def first_seen(stops: DataFrame) -> DataFrame:
    """Stops of all days once: rows (feed, day_ord, row_order, stop_id, ...) of the first day, with their order in the feed."""
    once = W.partitionBy("feed", "stop_id").orderBy("day_ord", "row_order")
    return stops.withColumn("nth", F.row_number().over(once)).filter("nth = 1").drop("nth")


def stub_coordinates(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Blank and (0, 0) coordinates as null."""
    a, b = F.trim(lat).try_cast("double"), F.trim(lon).try_cast("double")
    stub = a.isNull() | b.isNull() | ((a == 0) & (b == 0))
    return F.when(~stub, a), F.when(~stub, b)
