"""What a reader of reach documents derives: classes and labels, lines and points to draw, choices, the ride along a journey.

Positions are (lon, lat) pairs, as maps take them. Journeys and legs come as rows, not as nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.geo import bearing, path_km
from quayside.functions.text import bare, search_name
from quayside.operators.order import numbered
from quayside.operators.views import bucket, hop_key, shown

#: Fixed values of the ride: milliseconds of a whole way, of a change and of the rest at its end; kilometres to look ahead.
TRAVERSE_MS, CHANGE_MS, REST_MS, LOOK_KM = 7000.0, 500.0, 1000.0, 0.35


# classes and labels


def frequency_class(availability: Column) -> Column:
    """infrequent for limited service, else frequent, also where nothing is known."""
    return F.when(availability == "limited", "infrequent").otherwise("frequent")


def frequency_label(f: Column, direct_per_day: Column) -> Column:
    """What is said of a frequency (a struct, or null)."""
    of = F.concat(f["available_days"].cast("string"), F.lit("/"), f["sample_days"].cast("string"))
    service = (
        F.when(f["availability"] == "coverage_limited", F.concat(F.lit("limited feed coverage · route found on "), of, F.lit(" covered dates")))
        .when(f["availability"] == "year_round", "available on every sampled date")
        .when(f["available_days"] > 0, F.concat(F.lit("limited service · found on "), of, F.lit(" selected dates")))
        .otherwise("not running in the selected service week")
    )
    rate = f["direct_per_active_day"]
    # whole numbers are written without a fraction
    number = F.when(rate == F.floor(rate), F.floor(rate).cast("string")).otherwise(rate.cast("string"))
    daily = F.concat(number, F.lit(" direct trains per day · "), service)
    weekly = F.concat(F.lit("about "), F.coalesce(f["weekly_direct_estimate"], F.lit(0)).cast("string"), F.lit(" direct trains per week · "), service)
    known = F.when(F.coalesce(f["direct_trips"], F.lit(0)) == 0, service).when((f["direct_days"] == f["sample_days"]) & rate.isNotNull(), daily).otherwise(weekly)
    return F.when(f.isNull(), F.concat(direct_per_day.cast("string"), F.lit("× per day"))).otherwise(known)


def journey_summary(minutes: Column, trains: Column) -> Column:
    """Hours, minutes where there are any, and changes; null without a journey."""
    rest = F.when(minutes % 60 != 0, F.concat(F.lit(" "), (minutes % 60).cast("string"), F.lit(" min"))).otherwise("")
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"), rest, F.lit(" · "), F.when(trains == 1, "nonstop").otherwise(F.concat(trains.cast("string"), F.lit(" trains"))))


def date_label(day: Column, today: Column) -> Column:
    """Today, Tomorrow, else a short date."""
    days = F.datediff(day, today)
    return F.when(days == 0, "Today").when(days == 1, "Tomorrow").otherwise(F.date_format(day, "EEE d MMM"))


def shift_date(day: Column, days: Column | int) -> Column:
    return F.date_add(day, days)


def initial_trains(search: Column, host: Column, hosts: dict[str, int]) -> Column:
    """Most trains at first: the query's first `trains` of 1 to 3, else the host's, else 1. hosts is configuration."""
    asked = F.regexp_extract(F.concat(F.lit("&"), F.regexp_replace(search, "^\\?", "")), "^.*?&trains=([^&]*)", 1)
    bare_host = F.regexp_replace(host, "^www\\.", "")
    by_host = F.lit(1)
    for name, n in hosts.items():
        by_host = F.when(bare_host == name, n).otherwise(by_host)
    return F.when(asked.isin("1", "2", "3"), asked.cast("int")).otherwise(by_host)


def tier_or_below(histograms: Column, trains: Column) -> Column:
    """The histogram of a number of trains, or the next lower tier that there is; null if none."""
    at = lambda t: F.when(trains >= t, F.try_element_at(histograms, F.lit(str(t))))
    return F.coalesce(at(3), at(2), at(1))


def dayparts(histogram: Column) -> Column:
    """[(day, weekday, morning, afternoon, evening)] by day of a {day: bins}; null if it is empty or any day hasn't 24 counts of zero or more."""
    whole = F.size(histogram) > 0
    right = F.forall(F.map_values(histogram), lambda b: b.isNotNull() & (F.size(b) == 24) & F.forall(b, lambda n: n.isNotNull() & (n >= 0)))
    part = lambda b, start, n: F.aggregate(F.slice(b, start + 1, n), F.lit(0).cast("long"), lambda x, y: x + y)
    one = lambda e: F.struct(e["key"].alias("day"), F.date_format(F.to_date(e["key"]), "EEE").alias("weekday"), part(e["value"], 0, 12).alias("morning"), part(e["value"], 12, 6).alias("afternoon"), part(e["value"], 18, 6).alias("evening"))
    return F.when(whole & right, F.transform(F.array_sort(F.map_entries(histogram)), one))


# stations and cities


def with_reach(stations: DataFrame, documents: DataFrame) -> DataFrame:
    """stations with has_reach: whether a document of that origin is there to be served. documents: origin."""
    there = documents.select(F.col("origin").cast("string").alias("o")).distinct().withColumn("has_reach", F.lit(True))
    return stations.drop("has_reach").join(there, F.col("id").cast("string") == F.col("o"), "left").withColumn("has_reach", F.coalesce("has_reach", F.lit(False))).drop("o")


def popup_cities(groups: DataFrame) -> DataFrame:
    """id, city: of the cities (city, city_ord, ids) with two members or more, the first that holds a station."""
    return groups.filter(F.size("ids") >= 2).select("city", "city_ord", F.explode("ids").alias("id")).groupBy("id").agg(F.min_by("city", "city_ord").alias("city"))


def city_lookup(groups: DataFrame) -> DataFrame:
    """id, city: the last city that holds a station, of whatever size."""
    return groups.select("city", "city_ord", F.explode("ids").alias("id")).groupBy("id").agg(F.max_by("city", "city_ord").alias("city"))


def city_options(groups: DataFrame, query: str, exonyms: dict[str, Sequence[str]]) -> DataFrame:
    """city, ids of cities whose name or other name holds a query of two letters or more, by name."""
    q = bare(query.strip()).lower()
    others = [c for c, names in exonyms.items() if any(q in bare(n).lower() for n in names)]
    hit = F.contains(search_name(F.col("city")), F.lit(q)) | F.col("city").isin(others)
    return groups.filter(hit if len(q) >= 2 else F.lit(False)).select("city", "ids").orderBy(F.collate("city", "UNICODE_CI_AI"), "city")


def swapped(journeys: DataFrame, selected: DataFrame) -> DataFrame:
    """origin, dest after each selection (origin, dest) changes sides: the old origin stays as destination only if the new origin reaches it."""
    there = journeys.select(F.col("origin").alias("new_origin"), F.col("dest").alias("new_dest")).distinct()
    back = selected.select(F.col("dest").alias("new_origin"), F.col("origin").alias("new_dest"))
    met = back.join(there.withColumn("there", F.lit(True)), ["new_origin", "new_dest"], "left")
    return met.select(F.col("new_origin").alias("origin"), F.when(F.col("there"), F.col("new_dest")).alias("dest"))


#: Layers of a map in the order in which a click takes them, and what it picks.
LAYERS = {"reach-dots": "dest", "capital-stars": "origin", "all-stations": "origin"}


def overlap_choices(hits: DataFrame, stations: DataFrame) -> DataFrame:
    """id, pick, name, n_dest, rank of the stations hit (layer, id): each once, as its first layer says; most destinations first, then by name."""
    place = F.coalesce(*[F.when(F.col("layer") == layer, k) for k, layer in enumerate(LAYERS)])
    pick = F.element_at(F.array(*[F.lit(p) for p in LAYERS.values()]), F.col("place") + 1)
    best = hits.withColumn("place", place).filter("place is not null").groupBy("id").agg(F.min("place").alias("place")).withColumn("pick", pick)
    rows = best.join(stations.select("id", "name", F.coalesce("n_dest", F.lit(0)).alias("n_dest")), "id")
    return ranked(rows, F.desc("n_dest")).select("id", "pick", "name", "n_dest", "rank")


def ranked(stations: DataFrame, *first: Column) -> DataFrame:
    """stations with their rank by what comes first, then by name without case and marks, then by id."""
    order = [*first, F.collate("name", "UNICODE_CI_AI"), F.col("id")]
    return numbered(stations, order, "rank").withColumn("rank", F.col("rank").cast("int"))


def fewest_trains(journeys: DataFrame, most_trains: int | None = None, most_minutes: int | None = None) -> DataFrame:
    """origin, dest, trains: fewest trains of each destination, within limits if there are any."""
    within = F.lit(True)
    if most_trains is not None:
        within &= F.col("trains") <= most_trains
    if most_minutes is not None:
        within &= F.col("duration") <= most_minutes
    return journeys.filter(within).groupBy("origin", "dest").agg(F.min("trains").alias("trains"))


def target_ranks(stations: DataFrame, journeys: DataFrame, origin: int) -> DataFrame:
    """id, name, trains, rank of all stations but the origin: those it reaches first, by fewest trains, then most destinations."""
    own = fewest_trains(journeys.filter(F.col("origin") == origin)).select(F.col("dest").alias("id"), "trains")
    rows = stations.filter(F.col("id") != origin).join(own, "id", "left")
    return ranked(rows, F.col("trains").isNull().asc(), F.col("trains").asc(), F.desc("n_dest")).select("id", "name", "trains", "rank")


# lines and points


def transfer_points(legs: DataFrame, stations: DataFrame) -> DataFrame:
    """origin, dest, trains, leg, lon, lat: where a journey's train legs change; all legs' ends but the last, unknown stations left out."""
    last = F.max("leg").over(W.partitionBy("origin", "dest", "trains"))
    at = stations.select(F.col("id").alias("alight"), "lon", "lat")
    return legs.withColumn("last", last).filter("leg < last").join(at, "alight").select("origin", "dest", "trains", "leg", "lon", "lat")


def destination_points(journeys: DataFrame, stations: DataFrame, most_trains: int, most_minutes: int, facts: DataFrame | None = None) -> DataFrame:
    """A point for each destination shown: origin, id, name, lon, lat, duration, trains, bucket, n_routes, and of facts (origin,
    dest, direct_per_day, availability) the rate and class. Destinations that are no known station are left out."""
    rows = shown(journeys, most_trains, most_minutes)
    if facts is not None:
        rows = rows.join(facts.select("origin", "dest", "direct_per_day", frequency_class(F.col("availability")).alias("frequency_class")), ["origin", "dest"], "left")
    else:
        rows = rows.withColumns({"direct_per_day": F.lit(0), "frequency_class": F.lit("frequent")})
    at = stations.select(F.col("id").alias("dest"), "name", "lon", "lat", F.coalesce("n_routes", F.lit(0)).alias("n_routes"))
    return rows.join(at, "dest").select("origin", F.col("dest").alias("id"), "name", "lon", "lat", "duration", "trains", "bucket", "direct_per_day", "frequency_class", "n_routes")


def leg_stops(legs: DataFrame, calls: DataFrame, stations: DataFrame) -> DataFrame:
    """origin, dest, trains, leg, idx, station, lon, lat: all stops of each leg; unknown stations are left out, so that hops bridge them."""
    known = calls.select("trip_id", "idx", "station").join(stations.select(F.col("id").alias("station"), "lon", "lat"), "station")  # before they are multiplied by legs
    rows = legs.select("origin", "dest", "trains", "leg", "trip_id", "board_idx", "alight_idx").join(known, "trip_id")
    return rows.filter("idx between board_idx and alight_idx").select("origin", "dest", "trains", "leg", "idx", "station", "lon", "lat")


def hops_of_legs(legs: DataFrame, calls: DataFrame, stations: DataFrame) -> DataFrame:
    """The rows of leg_hops(leg_stops(...)): what follows a call among its trip's known stations is found by trip, not by leg."""
    known = calls.select("trip_id", "idx", "station").join(stations.select(F.col("id").alias("station"), "lon", "lat"), "station")
    w = W.partitionBy("trip_id").orderBy("idx")
    ahead = {"next": F.lead("idx").over(w), "b": F.lead("station").over(w), "b_lon": F.lead("lon").over(w), "b_lat": F.lead("lat").over(w)}
    rows = legs.select("origin", "dest", "trains", "leg", "trip_id", "board_idx", "alight_idx").join(known.withColumns(ahead).filter("b is not null"), "trip_id")
    return rows.filter("idx >= board_idx and next <= alight_idx").select("origin", "dest", "trains", "leg", "idx", F.col("station").alias("a"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), "b", "b_lon", "b_lat")


def leg_hops(stops: DataFrame) -> DataFrame:
    """The hops of leg_stops: origin, dest, trains, leg, idx, a, b and their positions."""
    w = W.partitionBy("origin", "dest", "trains", "leg").orderBy("idx")
    ahead = {"b": F.lead("station").over(w), "b_lon": F.lead("lon").over(w), "b_lat": F.lead("lat").over(w)}
    return stops.withColumns(ahead).filter("b is not null").select("origin", "dest", "trains", "leg", "idx", F.col("station").alias("a"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), "b", "b_lon", "b_lat")


def hop_points(a: Column, b: Column, curve: Column, a_at: Column, b_at: Column) -> Column:
    """Points of a hop in the direction of travel: its curve, which leads from the lesser id, or a straight line without one."""
    own = F.when(a.cast("string") < b.cast("string"), curve).otherwise(F.reverse(curve))
    return F.when(F.size(curve) >= 2, own).otherwise(F.array(a_at, b_at))


def shared_segments(hops: DataFrame, shown_rows: DataFrame) -> DataFrame:
    """hop, duration, bucket, trains, frequency_class and ends of each segment that shown journeys use, once: the fastest and the
    most direct journey through it, frequent if any is; its ends are those of the first journey.

    shown_rows: origin, dest, trains, duration, and availability if it is known. Journeys come in the order of dest."""
    rows = hops.join(shown_rows.withColumnRenamed("trains", "j_trains"), ["origin", "dest"]).filter("trains = j_trains")
    kind = frequency_class(F.col("availability")) if "availability" in shown_rows.columns else F.lit("frequent")
    ends = F.struct(*[F.col(c) for c in ("a", "a_lon", "a_lat", "b", "b_lon", "b_lat")])
    g = rows.groupBy("origin", hop_key(F.col("a"), F.col("b")).alias("hop")).agg(F.min("duration").alias("duration"), F.min("trains").alias("trains"), F.bool_or(kind == "frequent").alias("any"), F.min_by(ends, F.struct("dest", "leg", "idx")).alias("ends"))
    return g.select("origin", "hop", "duration", bucket(F.col("duration")).alias("bucket"), "trains", F.when(F.col("any"), "frequent").otherwise("infrequent").alias("frequency_class"), "ends.*")


def journey_lines(stops: DataFrame, shown_rows: DataFrame) -> DataFrame:
    """origin, dest, trains, bucket, line: the way of each shown journey as one line of [lon, lat], where legs meet once."""
    rows = stops.join(shown_rows.select("origin", "dest", F.col("trains").alias("j_trains"), "bucket"), ["origin", "dest"]).filter("trains = j_trains")
    held = F.array_sort(F.collect_list(F.struct("leg", "idx", "lon", "lat"))).alias("p")  # the stops of one journey
    lines = rows.groupBy("origin", "dest", "trains", "bucket").agg(held)
    joined = F.filter(F.col("p"), lambda x, k: (k == 0) | (x["leg"] == F.element_at("p", F.greatest(k, F.lit(1)))["leg"]))
    return lines.select("origin", "dest", "trains", "bucket", F.transform(joined, lambda x: F.array(x["lon"], x["lat"])).alias("line")).filter(F.size("line") >= 2)


def feature_collection(rows: DataFrame, geometry: str, coordinates: Column, key: Column, properties: Sequence[str]) -> DataFrame:
    """A row (value) with a feature collection of rows as JSON: for one reader's view, which is bounded by the network."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(key.cast("string").alias("id"), *properties).alias("properties"))
    held = rows.select(key.alias("sort_key"), feature.alias("f")).agg(F.array_sort(F.collect_list(F.struct("sort_key", F.to_json("f").alias("f")))).alias("fs"))
    return held.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("]}")).alias("value"))


# dots


def interpolated(x: Column, stops: Sequence[tuple[float, float | Column]]) -> Column:
    """Straight between stops (input, output), level beyond the ends."""
    out = F.lit(stops[-1][1]) if not isinstance(stops[-1][1], Column) else stops[-1][1]
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        low = y0 if isinstance(y0, Column) else F.lit(float(y0))
        high = y1 if isinstance(y1, Column) else F.lit(float(y1))
        out = F.when(x < x1, low + (high - low) * (F.greatest(x, F.lit(x0)) - x0) / (x1 - x0)).otherwise(out)
    return out


#: Size by the square root of the routes of a station, and least destinations to be seen by zoom.
HUB = 74**0.5
DOT_SIZES, REACH_SIZES, STAR_SIZES = ((0.0, 2.0), (2.0, 2.6), (4.0, 4.5), (HUB, 9.0)), ((0.0, 4.5), (HUB, 9.0)), ((0.0, 0.55), (HUB, 1.05))
SEEN_FROM, SEEN = ((4.0, 150), (5.5, 50), (7.0, 10), (9.0, 0)), 0.7


def dot_size(n_routes: Column, sizes: Sequence[tuple[float, float]] = DOT_SIZES) -> Column:
    return interpolated(F.sqrt(F.greatest(n_routes, F.lit(0))), sizes)


def dot_opacity(n_dest: Column, zoom: Column) -> Column:
    """Small stations fade in as the map closes in."""
    return interpolated(zoom, [(z, F.when(n_dest >= n, SEEN).otherwise(0.0) if n else F.lit(SEEN)) for z, n in SEEN_FROM])


# the ride along a journey


def ride_phases(legs: DataFrame) -> DataFrame:
    """journey, pos, kind (move or dwell), start_ms, end_ms, path, km, total_km, lon, lat, bearing of legs (journey, leg, path).

    path is an array of structs (lon, lat); each leg takes time by its length, then stands at its end. Legs of fewer than
    two points, and journeys without length, have no phases."""
    steps = F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: path_km(F.element_at("path", i - 1)["lat"], F.element_at("path", i - 1)["lon"], F.element_at("path", i)["lat"], F.element_at("path", i)["lon"]))
    rows = legs.filter(F.size("path") >= 2).withColumn("steps", steps)
    km = F.transform(F.sequence(F.lit(0), F.size("steps")), lambda i: F.aggregate(F.slice("steps", 1, i), F.lit(0.0), lambda x, y: x + y))
    rows = rows.withColumn("km", km).withColumn("total_km", F.element_at("km", -1))
    whole = W.partitionBy("journey")
    order = whole.orderBy("leg")
    rows = rows.withColumns({"all_km": F.sum("total_km").over(whole), "last": F.lead("leg").over(order).isNull()}).filter("all_km > 0")
    rows = rows.withColumns({"move": TRAVERSE_MS * F.col("total_km") / F.col("all_km"), "dwell": F.when(F.col("last"), REST_MS).otherwise(CHANGE_MS)})
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("move") + F.col("dwell")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    end, near = F.element_at("path", -1), F.element_at("path", -2)
    none = F.lit(None).cast("double")
    move = F.struct(F.lit("move").alias("kind"), F.col("start").alias("start_ms"), (F.col("start") + F.col("move")).alias("end_ms"), F.col("path"), F.col("km"), F.col("total_km"), none.alias("lon"), none.alias("lat"), none.alias("bearing"))
    dwell = F.struct(F.lit("dwell").alias("kind"), (F.col("start") + F.col("move")).alias("start_ms"), (F.col("start") + F.col("move") + F.col("dwell")).alias("end_ms"), F.lit(None).cast(legs.schema["path"].dataType).alias("path"), F.lit(None).cast("array<double>").alias("km"), none.alias("total_km"), end["lon"].alias("lon"), end["lat"].alias("lat"), bearing(near["lat"], near["lon"], end["lat"], end["lon"]).alias("bearing"))
    return rows.select("journey", "leg", F.posexplode(F.array(move, dwell)).alias("part", "p")).select("journey", (F.row_number().over(W.partitionBy("journey").orderBy("leg", "part")) - 1).alias("pos"), "p.*")


def segment_at(km: Column, at: Column) -> Column:
    """Number of the point that ends the segment in which `at` kilometres lie, from 2."""
    before = F.size(F.filter(F.slice(km, 2, F.greatest(F.size(km) - 2, F.lit(0))), lambda x: x < at))
    return before + 2


def position_at(path: Column, km: Column, at: Column) -> Column:
    """(lon, lat) at some kilometres of a way, held within its ends."""
    at = F.least(F.greatest(at, F.lit(0.0)), F.element_at(km, -1))
    i = segment_at(km, at)
    a, b = F.element_at(path, i - 1), F.element_at(path, i)
    length = F.element_at(km, i) - F.element_at(km, i - 1)
    share = F.when(length == 0, 0.0).otherwise(F.try_divide(at - F.element_at(km, i - 1), length))
    return F.struct((a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"))


def eased(share: Column) -> Column:
    """Slow at both ends."""
    return share * share * (3 - 2 * share)


def ride_at(phases: DataFrame, times: DataFrame) -> DataFrame:
    """journey, ms, lon, lat, bearing, moving at times (journey, ms) of an endless loop over the phases."""
    total = phases.groupBy("journey").agg(F.max("end_ms").alias("total"))
    at = times.join(total, "journey").withColumn("t", F.pmod(F.col("ms").cast("double"), F.col("total")))
    hit = at.join(phases, "journey").filter("t >= start_ms and t < end_ms")
    km = eased((F.col("t") - F.col("start_ms")) / (F.col("end_ms") - F.col("start_ms"))) * F.col("total_km")
    hit = hit.withColumn("at_km", km)
    place = lambda d: position_at(F.col("path"), F.col("km"), F.col("at_km") + d)
    hit = hit.withColumns({"here": place(0.0), "back": place(-LOOK_KM), "front": place(LOOK_KM), "i": segment_at(F.col("km"), F.col("at_km"))})
    ahead = bearing(F.col("back.lat"), F.col("back.lon"), F.col("front.lat"), F.col("front.lon"))
    a, b = F.element_at("path", F.col("i") - 1), F.element_at("path", F.col("i"))
    still = (F.col("back.lat") == F.col("front.lat")) & (F.col("back.lon") == F.col("front.lon"))
    heading = F.when(still, bearing(a["lat"], a["lon"], b["lat"], b["lon"])).otherwise(ahead)
    moving = F.col("kind") == "move"
    return hit.select("journey", "ms", F.when(moving, F.col("here.lon")).otherwise(F.col("lon")).alias("lon"), F.when(moving, F.col("here.lat")).otherwise(F.col("lat")).alias("lat"), F.when(moving, heading).otherwise(F.col("bearing")).alias("bearing"), moving.alias("moving"))


def smoothed_bearing(before: Column, target: Column, ms: Column, tau: float = 140.0) -> Column:
    """A heading that turns towards the target along the shorter arc; the target itself where nothing came before."""
    to, was = F.pmod(target, F.lit(360.0)), F.pmod(before, F.lit(360.0))
    arc = F.pmod(to - was + 180.0, F.lit(360.0)) - 180.0
    return F.when(before.isNull(), to).otherwise(F.pmod(was + arc * (1 - F.exp(-ms / tau)), F.lit(360.0)))
