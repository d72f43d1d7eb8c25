"""Derivations for readers of the results: shown destinations, segments, search, cities, booking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.geo import path_km
from quayside.functions.text import bare, search_name


def shown(journeys: DataFrame, most_trains: int, most_minutes: int) -> DataFrame:
    """The best journey of each destination within the limits, with its time bucket."""
    best = journeys.filter(F.col("trains") <= most_trains).groupBy("origin", "dest").agg(F.min(F.struct("duration", "trains")).alias("m")).select("origin", "dest", "m.duration", "m.trains").filter(F.col("duration") <= most_minutes)
    return best.withColumn("bucket", bucket(F.col("duration")))


def bucket(minutes: Column) -> Column:
    return F.when(minutes < 180, 0).when(minutes < 360, 1).when(minutes < 600, 2).otherwise(3)


def hops(calls: DataFrame) -> DataFrame:
    """trip_id, a, b, minutes of consecutive calls; a call whose station is unknown was filtered before, so that hops bridge it."""
    w = W.partitionBy("trip_id").orderBy("idx")
    return calls.select("trip_id", "idx", F.col("station").alias("a"), F.lead("station").over(w).alias("b"), (F.lead("arr").over(w) - F.col("dep")).alias("minutes")).filter("b is not null")


def hop_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a.cast("string"), b.cast("string")), F.greatest(a.cast("string"), b.cast("string")))


def segments(hop_rows: DataFrame) -> DataFrame:
    """hop, minutes, n, first_trip: hops of either direction as one."""
    return hop_rows.filter("a <> b").groupBy(hop_key(F.col("a"), F.col("b")).alias("hop")).agg(F.min("minutes").alias("minutes"), F.count("*").alias("n"), F.min("trip_id").alias("first_trip"))


def hop_weights(hop_rows: DataFrame) -> DataFrame:
    """a, b, w: how often each hop is travelled; hops of no length are left out."""
    return hop_rows.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))


def curves(hop_rows: DataFrame, stations: DataFrame) -> DataFrame:
    """hop, points: each hop as a curve that leaves its stations along one tangent, that of the weightiest way through."""
    at = stations.select("id", "lat", "lon")
    weights = hop_rows.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("w"))
    p = weights.join(at.toDF("a", "lat1", "lon1"), "a").join(at.toDF("b", "lat2", "lon2"), "b")
    km = path_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    scale = F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2))
    p = p.withColumn("km", km).filter("km > 0").withColumns({"dx": (F.col("lon2") - F.col("lon1")) * 111.32 * scale / F.col("km"), "dy": (F.col("lat2") - F.col("lat1")) * 111.32 / F.col("km"), "hop": hop_key(F.col("a"), F.col("b"))})
    incident = p.select(F.col("a").alias("id"), "hop", "dx", "dy", "w").unionByName(p.select(F.col("b").alias("id"), "hop", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), "w"))
    u, v = incident.alias("u"), incident.alias("v")
    score = (F.col("u.w") + F.col("v.w")) * (1 - (F.col("u.dx") * F.col("v.dx") + F.col("u.dy") * F.col("v.dy"))) / 2
    pairs = u.join(v, (F.col("u.id") == F.col("v.id")) & (F.col("u.hop") < F.col("v.hop"))).select(F.col("u.id").alias("id"), score.alias("s"), F.col("u.hop").alias("h1"), F.col("v.hop").alias("h2"), (F.col("u.dx") - F.col("v.dx")).alias("tx"), (F.col("u.dy") - F.col("v.dy")).alias("ty"), F.col("u.dx").alias("ux"), F.col("u.dy").alias("uy"))
    best = pairs.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("s"), "h1", "h2", "tx", "ty", "ux", "uy")).alias("m"))
    length = F.hypot("m.tx", "m.ty")
    best = best.select("id", F.when(length == 0, F.col("m.ux")).otherwise(F.col("m.tx") / length).alias("tx"), F.when(length == 0, F.col("m.uy")).otherwise(F.col("m.ty") / length).alias("ty"))
    single = incident.groupBy("id").agg(F.min(F.struct("hop", "dx", "dy")).alias("f")).join(best, "id", "left").select("id", F.coalesce("tx", "f.dx").alias("tx"), F.coalesce("ty", "f.dy").alias("ty"))
    h = p.join(single.toDF("a", "ax", "ay"), "a").join(single.toDF("b", "bx", "by"), "b")
    along = lambda x, y: F.when(F.col(x) * F.col("dx") + F.col(y) * F.col("dy") < 0, -1).otherwise(1)
    d = F.least(0.35 * F.col("km"), 0.4 * F.col("km"), F.lit(30.0))
    h = h.withColumns({"sa": along("ax", "ay") * d, "sb": along("bx", "by") * d, "n": F.least(F.lit(40), F.greatest(F.lit(8), F.floor(F.col("km") / 12 + 0.5)))})
    lon = lambda base, lat, t, s, sign: F.col(base) + sign * F.col(t) * F.col(s) / (111.32 * F.cos(F.radians(F.col(lat))))
    lat = lambda base, t, s, sign: F.col(base) + sign * F.col(t) * F.col(s) / 111.32
    h = h.withColumns({"c1x": lon("lon1", "lat1", "ax", "sa", 1), "c1y": lat("lat1", "ay", "sa", 1), "c2x": lon("lon2", "lat2", "bx", "sb", -1), "c2y": lat("lat2", "by", "sb", -1)})

    def point(i: Column) -> Column:
        t = i / (F.col("n") - 1)
        s = 1 - t
        mix = lambda p0, p1, p2, p3: s * s * s * F.col(p0) + 3 * s * s * t * F.col(p1) + 3 * s * t * t * F.col(p2) + t * t * t * F.col(p3)
        ends = lambda p0, p3, m: F.when(i == 0, F.col(p0)).when(i == F.col("n") - 1, F.col(p3)).otherwise(m)
        return F.struct(ends("lon1", "lon2", mix("lon1", "c1x", "c2x", "lon2")).alias("lon"), ends("lat1", "lat2", mix("lat1", "c1y", "c2y", "lat2")).alias("lat"))

    return h.select("hop", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), point).alias("points"))


def along_paths(calls: DataFrame, stations: DataFrame) -> DataFrame:
    """trip_id, idx, km: way travelled at each call."""
    at = calls.join(stations.select(F.col("id").alias("station"), "lat", "lon"), "station")
    w = W.partitionBy("trip_id").orderBy("idx")
    step = path_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return at.withColumn("step", F.coalesce(step, F.lit(0.0))).select("trip_id", "idx", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("km"))


def query_variants(query: str, exonyms: list[tuple[str, str]]) -> list[str]:
    """The folded query and, from 3 letters on, its translations: of names that it begins, and of names that begin it."""
    q = bare(query).lower()
    out = [q]
    if len(q) >= 3:
        out += [native if name.startswith(q) else q.replace(name, native, 1) for name, native in exonyms if name.startswith(q) or q.startswith(name)]
    return list(dict.fromkeys(out))


def search(stations: DataFrame, query: str, exonyms: list[tuple[str, str]], limit: int = 10, reach: DataFrame | None = None) -> DataFrame:
    """Top stations (id, name, is_capital, n_dest) for a query: prefix before substring, capitals, reach, short names; only those of reach (id) if it is given."""
    rows = stations.join(reach.select("id"), "id", "left_semi") if reach is not None else stations
    rows = rows.withColumn("norm", search_name(F.col("name")))
    some = lambda f: reduce(lambda a, b: a | b, [f(F.col("norm"), F.lit(v)) for v in query_variants(query, exonyms)])
    tier = F.when(some(F.startswith), 0).when(some(F.contains), 1)
    return rows.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.when(F.col("is_capital"), 0).otherwise(1), F.desc("n_dest"), F.length("norm"), "id").limit(limit).select("id", "name", "tier", "n_dest")


def cities(groups: DataFrame, stations: DataFrame) -> DataFrame:
    """city, ids: members by exact name, in order; groups of one station go. groups: city, city_ord, member, pos."""
    hit = groups.join(stations.select(F.col("name").alias("member"), "id"), "member")
    g = hit.groupBy("city", "city_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("m")).filter(F.size("m") >= 2)  # a city's stations
    return g.select("city", "city_ord", F.transform("m", lambda x: x["id"]).alias("ids"))


def transfer_checks(transfers: DataFrame, groups: DataFrame, stations: DataFrame) -> DataFrame:
    """city, a, b, minutes, mode, reason: null for a valid transfer, else the first rule it breaks."""
    members = groups.groupBy("city").agg(F.collect_set("member").alias("members"))
    names = stations.groupBy("name").agg(F.count("*").alias("n"))
    rows = transfers.join(members, "city", "left").join(names.toDF("a", "na"), "a", "left").join(names.toDF("b", "nb"), "b", "left")
    has = lambda c: F.coalesce(F.array_contains("members", F.col(c)), F.lit(False))
    reason = F.when(F.col("minutes").isNull() | (F.col("minutes") <= 0), "minutes").when(~F.col("mode").isin("walk", "metro", "tram", "bus", "rail", "ferry", "taxi"), "mode").when(~has("a") | ~has("b"), "not in city").when(F.coalesce("na", F.lit(0)) != 1, "ambiguous").when(F.coalesce("nb", F.lit(0)) != 1, "ambiguous")
    return rows.select("city", "a", "b", "minutes", "mode", reason.alias("reason"))


def coverage(stations: DataFrame, feeds: DataFrame) -> DataFrame:
    """country, covered of all countries with a station: whether a feed is of the country, or it is only reached."""
    there = feeds.select("country").distinct().withColumn("covered", F.lit(True))
    return stations.select("country").distinct().join(there, "country", "left").select("country", F.coalesce("covered", F.lit(False)).alias("covered"))


def city_union(reaches: DataFrame) -> DataFrame:
    """The best row of a city's origins for each destination, with all its columns: fewest trains, then least time, then the
    first origin; a row without a journey (trains is null) loses to any with one. Rows (reach_ord, origin, dest, trains, duration, ...)."""
    rank = F.struct(F.col("trains").isNull(), "trains", "duration", "reach_ord", "origin")
    whole = F.struct(*[c for c in reaches.columns if c not in ("dest", "reach_ord")])
    return reaches.groupBy("dest").agg(F.min_by(whole, rank).alias("m")).select("dest", "m.*")


def destination_options(stations: DataFrame, journeys: DataFrame, same_city: DataFrame, origin: int, query: str, most_minutes: int, limit: int = 12) -> DataFrame:
    """id, name, grp: options for a query of two letters or more; by least trains within the time, then local transit, then what can't be reached."""
    own = journeys.filter(F.col("origin") == origin)
    best = own.groupBy(F.col("dest").alias("id")).agg(F.min(F.when(F.col("duration") <= most_minutes, F.col("trains"))).alias("t"), F.count("*").alias("any"))
    rows = stations.filter((F.col("id") != origin) & F.contains(search_name(F.col("name")), search_name(F.lit(query))) & (F.length(F.lit(query)) >= 2)).join(best, "id", "left").join(same_city.select("id", F.lit(True).alias("local")), "id", "left")
    grp = F.when(F.col("t").isNotNull(), F.col("t")).when(F.col("any").isNull() & F.col("local"), 4).otherwise(5)
    return rows.select("id", "name", grp.alias("grp")).orderBy("grp", "name", "id").limit(limit)


def booking_links(rows: DataFrame, ids: DataFrame, today: Column, home: str, results: str) -> DataFrame:
    """req, matched, url: a filled search where both stations are known and the day isn't past by more than one."""
    r = rows.join(ids.toDF("from_id", "o"), "from_id", "left").join(ids.toDF("to_id", "d"), "to_id", "left")
    day = F.try_to_date("day", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.col("day").try_cast("date")
    ok = F.coalesce(F.col("o").isNotNull() & F.col("d").isNotNull() & (day >= F.date_sub(today, 1)), F.lit(False))
    url = F.concat(F.lit(results), F.lit("?origin="), F.url_encode(F.concat(F.lit("loc:"), F.col("o"))), F.lit("&destination="), F.url_encode(F.concat(F.lit("loc:"), F.col("d"))), F.lit("&outwardDate="), F.url_encode(F.concat(day.cast("string"), F.lit("T06:00:00"))))
    # a passenger of thirty years
    url = F.concat(url, F.lit("&passengers%5B%5D="), (F.year(today) - 30).cast("string"), F.lit("-01-01"))
    return r.select("req", ok.alias("matched"), F.when(ok, url).otherwise(home).alias("url"))
