"""Stations across feeds, split trips, places in polygons, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.geo import flat_m, great_circle_m, grid_km
from quayside.functions.text import booking_name, code_of, merge_name, merged_text
from quayside.sources.scratch import written

NEAR_M = 500
CELL = 0.1
#: Degrees of latitude of a metre, a little more than it takes.
DEGREES = 1 / 111_000


def places(stops: DataFrame) -> DataFrame:
    """norm, lat, lon, rep (the first stop) and n: stops (ord, name, lat, lon) of equal folded name and position."""
    named = stops.filter("lat is not null and lon is not null").select("ord", merge_name(F.col("name")).alias("norm"), "lat", "lon")
    return named.groupBy("norm", "lat", "lon").agg(F.min("ord").alias("rep"), F.count("*").alias("n"))


def place_members(stops: DataFrame) -> DataFrame:
    """ord and rep of every stop with a position."""
    named = stops.withColumn("norm", merge_name(F.col("name")))
    return named.join(places(stops).drop("n"), ["norm", "lat", "lon"]).select("ord", "rep")


def proximity_pairs(found: DataFrame, most_m: float = NEAR_M) -> DataFrame:
    """a, b, n_a, n_b: places of equal name less than most_m apart, by their first stops, the earlier first, and the numbers of their stops.

    Joined on name and a cell of about most_m, so a place meets only what is near it, however many places bear its name."""
    d = most_m * DEGREES
    wide = lambda lat: F.lit(d) / F.greatest(F.lit(0.05), F.cos(F.radians(F.abs(lat) + 2 * d)))
    band = F.floor(F.col("lat") / d)
    width = lambda y: wide(F.greatest(F.abs(y * d), F.abs((y + 1) * d)))
    own = found.withColumn("y", band).withColumn("x", F.floor(F.col("lon") / width(F.col("y"))))
    reach = found.withColumn("y", F.explode(F.array(*[band + k for k in (-1, 0, 1)]))).withColumn("w", wide(F.col("lat")))
    cells = F.array_distinct(F.transform(F.array(-F.col("w"), F.lit(0.0), F.col("w")), lambda k: F.floor((F.col("lon") + k) / width(F.col("y")))))
    reach = reach.withColumn("x", F.explode(F.sequence(F.array_min(cells), F.array_max(cells))))
    a, b = own.alias("a"), reach.alias("b")
    near = flat_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) < most_m
    met = a.join(b, (F.col("a.norm") == F.col("b.norm")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x") == F.col("b.x"))).filter(near & (F.col("a.rep") < F.col("b.rep")))
    return met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


#: Stops of a place that meet the stops of another at once, and pairs of stops that a task gives on average at most.
BLOCK, PAIRS = 1_000, 5_000_000


def stop_pairs(stops: DataFrame, most_m: float = NEAR_M) -> DataFrame:
    """a, b: all stops of equal name less than most_m apart, the earlier first, those of one place included.

    Found by places, so that distances are taken once for each pair of places. A place's stops lie in blocks of about BLOCK,
    and pairs of blocks are dealt out before they become pairs of stops, so that neither a place nor a task holds very many."""
    found = written(places(stops), "places")
    near = proximity_pairs(found, most_m)
    near = written(near.unionByName(found.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))), "near")
    block = F.pmod(F.xxhash64("ord"), F.ceil(F.col("n") / BLOCK)).alias("block")
    blocks = place_members(stops).join(found.select("rep", "n"), "rep").groupBy("rep", block).agg(F.collect_list("ord").alias("stops"))
    blocks = written(blocks, "blocks")
    side = lambda c: blocks.select(F.col("rep").alias(c), F.col("block").alias(f"block_{c}"), F.col("stops").alias(f"of_{c}"))
    n = near.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0))).first()[0]
    n = max(-(-n // PAIRS), int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # blocks of one place meet once
    met = near.join(side("a"), "a").join(side("b"), "b").filter("a <> b or block_a <= block_b").repartition(n, "a", "b", "block_a", "block_b")
    own = met.withColumn("one", (F.col("a") == F.col("b")) & (F.col("block_a") == F.col("block_b"))).select("one", F.explode("of_a").alias("x"), "of_b")
    both = own.select("one", "x", F.explode("of_b").alias("y")).filter("not one or x < y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def merge_one_hop(stops: DataFrame) -> DataFrame:
    """ord, canonical: the first stop of equal name within reach, or itself."""
    found = written(places(stops), "places")
    first = proximity_pairs(found).groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("first"))
    near = stops.select("ord").join(place_members(stops), "ord", "left").join(first, "rep", "left")
    return near.select("ord", F.coalesce("first", "rep", "ord").alias("canonical"))


def first_independent(pairs: DataFrame) -> DataFrame:
    """node, canonical: for pairs (a, b), a before b, the first node that b may join, of those nodes that join none.

    A node joins the first of its earlier neighbours that joins none itself. In each round nodes without an undecided earlier neighbour are settled
    and their later neighbours are known to join; nodes in no pair join none. Chains of which each waits for the one before take as many rounds."""
    pairs = written(pairs.select("a", "b"), "near")
    alive, joined = pairs, pairs.select(F.col("b").alias("node")).limit(0)
    while not alive.isEmpty():
        settled = alive.select(F.col("a").alias("node")).distinct().join(alive.select(F.col("b").alias("node")), "node", "left_anti")
        joins = written(alive.join(settled.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "joins")
        joined = joined.unionByName(joins)
        rest = alive
        for c in ("a", "b"):
            rest = rest.join(joins.withColumnRenamed("node", c), c, "left_anti")
        # what is settled has no pair left: its later neighbours join, and it has no earlier one
        alive = written(rest.select("a", "b"), "near")
    makers = pairs.join(joined.withColumnRenamed("node", "a"), "a", "left_anti")
    return makers.join(joined.withColumnRenamed("node", "b"), "b", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("canonical"))


def connected(links: DataFrame) -> DataFrame:
    """node, group: the least node reached over links (a, b). Labels pass over links and then point at their label's label, so a chain of n takes log n rounds."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = written(labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l")), "labels")
        ahead = step.select(F.col("u").alias("l"), F.col("l").alias("further"))
        step = written(step.join(ahead, "l").select("u", "old", F.least("l", "further").alias("l")), "labels")
        labels = step.select("u", "l")
        if step.filter("old <> l").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("group"))


class Aliases:
    """Hand-written identities of stops: {key: target}.

    A key is "feed:stop id" or "feed@name"; a target is a station's id, or "feed@name" of another stop, perhaps with
    "~lat,lon" near which it must be. This is configuration: it is small and read on the driver."""

    def __init__(self, entries: dict[str, str]):
        self.entries = dict(entries)
        self.by_name = {n[:2]: t for k, t in self.entries.items() if (n := self.named(k))}

    @staticmethod
    def named(text: str) -> tuple[str, str, tuple[float, float] | None] | None:
        """(feed, folded name, position) of a text "feed@name~lat,lon"; None for ids."""
        feed, sign, rest = text.partition("@")
        name, _, near = rest.partition("~")
        if not (sign and feed and rest) or ":" in feed:
            return None
        return feed, merged_text(name), tuple(float(x) for x in near.split(",")) if near else None

    def of(self, feed: str, stop_id: str, norm: str) -> str | None:
        own = self.entries.get(f"{feed}:{stop_id}")
        return own if own is not None else self.by_name.get((feed, norm))


#: Metres around a target's position in which its stop must be.
HINT_M = 2000
_FOLDED = "ord long, canonical string, first_ord long, target string, hits array<string>"


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    import math

    x = math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2))
    return 6_371_000.0 * math.hypot(x, math.radians(b[0] - a[0]))


def fold_block(rows: list[tuple], aliases: Aliases, feed_order: dict[str, int]) -> list[tuple]:
    """Stations of one block: rows (ord, feed, stop_id, norm, code, lat, lon) in any order.

    Gives (ord, canonical id, ord of the stop that made the station, alias target that was a name, ids it met)."""
    places: dict[str, tuple[int, float, float]] = {}  # of stations
    named: dict[str, list[str]] = {}
    by_code: dict[str, str] = {}
    landed: dict[tuple[str, str], list[str]] = {}
    out = []
    for ord_, feed, stop_id, norm, code, lat, lon in sorted(rows):
        twin = lambda: next((x for x in named.get(norm, ()) if _metres(places[x][1:], (lat, lon)) < NEAR_M), None)  # noqa: B023, E731
        target, met, said = aliases.of(feed, stop_id, norm), None, None
        station = target
        if target is not None and (ref := Aliases.named(target)):
            met = [x for x in landed.get(ref[:2], ()) if ref[2] is None or _metres(ref[2], places[x][1:]) < HINT_M]
            station, said = met[0] if met else None, target
        if station is not None and station not in places and station.startswith("x:"):
            # an id of a feed that is read whole and didn't have it is stale
            owner = station[2:].partition(":")[0]
            if owner in feed_order and feed_order[owner] < feed_order[feed]:
                station = twin() or station
        if station is None and code is not None:
            if code in by_code or code in places:
                station = by_code.get(code, code)
            elif near := twin():
                station = by_code[code] = near
            else:
                station = code
        if station is None:
            station = twin() or f"x:{feed}:{stop_id}"
        if station not in places:
            places[station] = (ord_, lat, lon)
            named.setdefault(norm, []).append(station)
        at = landed.setdefault((feed, norm), [])
        if station not in at:
            at.append(station)
        out.append((ord_, station, places[station][0], said, met))
    return out


def merge_stations(stops: DataFrame, aliases: Aliases, feed_order: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stations, mapping, issues) of stops (ord, feed, stop_id, name, code, country, lat, lon) of all feeds, in the order of ord.

    A stop with a position joins, in this order: its alias's station; that of its code; the first station of equal name
    less than NEAR_M away; else it makes a station, whose name, place and country are its own. Only makers' places count, so
    a chain of near stops isn't one station. A stop without a position joins its alias's station if there is one, else the
    station of its name if just one has it, else none: it never makes a station and isn't in mapping.

    stations: id, name, country, lat, lon, ord; mapping: feed, stop_id, station; issues: kind, detail. Stops are decided
    in rounds of joins (see _free_stations). Decisions never leave a block of stops that may see each other: equal names within
    reach, codes, and what aliases name; only blocks that aliases, which are configuration, touch are folded in order, each in one task."""
    spark = stops.sparkSession
    rows = written(stops.withColumn("norm", merge_name(F.col("name"))), "stops")
    real = rows.filter("lat is not null and lon is not null")
    if aliases.entries:
        blocks = written(connected(_block_links(real, aliases)), "blocks")
        named = blocks.join(_alias_tokens(real, aliases).select(F.col("ord").alias("node")), "node", "left_semi").select("group").distinct()
        apart = blocks.join(named, "group", "left_semi").select(F.col("node").alias("ord"), "group")
        folded = _free_stations(real.join(apart.select("ord"), "ord", "left_anti")).unionByName(real.join(apart, "ord").groupBy("group").applyInPandas(_folding(aliases, feed_order), _FOLDED))
    else:
        folded = _free_stations(real)
    folded = written(folded, "folded")
    makers = folded.groupBy("canonical").agg(F.min("first_ord").alias("ord"))
    stations = written(makers.join(real.select("ord", "name", "country", "lat", "lon"), "ord").select(F.col("canonical").alias("id"), "name", "country", "lat", "lon", "ord"), "stations")
    mapping = folded.join(real.select("ord", "feed", "stop_id"), "ord").select("feed", "stop_id", F.col("canonical").alias("station"), "ord")
    # stops without a position
    stubs = rows.filter("lat is null or lon is null").select("ord", "feed", "stop_id", "norm")
    lone = stations.groupBy(merge_name(F.col("name")).alias("norm")).agg(F.count("*").alias("n"), F.min("id").alias("by_name")).filter("n = 1")
    wanted, stub_issues = _stub_targets(spark, stubs, aliases, folded.join(real.select("ord", "feed", "norm"), "ord"), stations)
    found = stubs.join(wanted, "ord", "left").join(lone, "norm", "left").select("feed", "stop_id", F.coalesce("by_alias", "by_name").alias("station")).filter("station is not null")
    # what aliases say of no stop, or of several
    text = F.concat(F.lit("alias target '"), F.col("target"), F.lit("' (for "), F.col("feed"), F.lit(":"), F.col("stop_id"), F.lit(")"))
    told = folded.filter("target is not null").join(real.select("ord", "feed", "stop_id"), "ord").select("ord", "feed", "stop_id", "target", "hits").unionByName(stub_issues)
    issues = told.filter(F.size("hits") != 1).select(F.lit("alias").alias("kind"), F.when(F.size("hits") == 0, F.concat(text, F.lit(" matches no stop"))).otherwise(F.concat(text, F.lit(" is ambiguous: "), F.array_join("hits", ", "))).alias("detail")).distinct()
    keys = spark.createDataFrame([(k, *n[:2]) for k in aliases.entries if (n := Aliases.named(k))], "key string, feed string, norm string")
    by_id = [k for k in aliases.entries if not Aliases.named(k)]
    used = rows.filter(~F.concat_ws(":", "feed", "stop_id").isin(by_id)).select("feed", "norm").distinct() if by_id else rows.select("feed", "norm").distinct()
    unused = keys.join(used, ["feed", "norm"], "left_anti").select(F.lit("alias").alias("kind"), F.concat(F.lit("alias key '"), F.col("key"), F.lit("' matches no stop")).alias("detail"))
    return stations, mapping.select("feed", "stop_id", "station").unionByName(found), issues.unionByName(unused)


def _block_links(real: DataFrame, aliases: Aliases) -> DataFrame:
    """(a, b) of stops that may see each other: each stop and the first with which it shares a token."""
    reach = NEAR_M / 111_000  # degrees of latitude, a little more than NEAR_M
    wide = F.lit(reach) / F.greatest(F.lit(0.05), F.cos(F.radians(F.abs("lat") + reach)))
    cells = lambda c, d: F.array_distinct(F.array(F.floor((F.col(c) - d) / CELL), F.floor((F.col(c) + d) / CELL)))
    near = real.select("ord", "norm", F.explode(cells("lat", F.lit(reach))).alias("y"), "lat", "lon").select("ord", "norm", "y", F.explode(cells("lon", wide)).alias("x"))
    token = lambda kind, *c: F.concat_ws("|", F.lit(kind), *c)
    tokens = near.select("ord", token("n", "norm", F.col("y").cast("string"), F.col("x").cast("string")).alias("token"))
    tokens = tokens.unionByName(real.filter("code is not null").select("ord", token("i", "code").alias("token")))
    tokens = written(tokens.unionByName(_alias_tokens(real, aliases)), "tokens")
    return tokens.join(tokens.groupBy("token").agg(F.min("ord").alias("a")), "token").select("a", F.col("ord").alias("b")).distinct()


def _alias_tokens(real: DataFrame, aliases: Aliases) -> DataFrame:
    """(ord, token) of stops that aliases name, and of stops that their targets name."""
    token = lambda kind, *c: F.concat_ws("|", F.lit(kind), *c)
    names = {n[:2] for t in aliases.entries.values() if (n := Aliases.named(t))}
    ids = {t for t in aliases.entries.values() if not Aliases.named(t)}
    conf = []  # what stops of a key see
    for key, target in aliases.entries.items():
        ref, own = Aliases.named(target), Aliases.named(key)
        seen = "|".join(("r", *ref[:2])) if ref else f"i|{target}"
        conf.append((*(own[:2] if own else (None, None)), None if own else key, seen))
    conf = F.broadcast(real.sparkSession.createDataFrame(conf, "k_feed string, k_norm string, k_id string, token string"))  # configuration
    hit = ((F.col("k_feed") == F.col("feed")) & (F.col("k_norm") == F.col("norm"))) | (F.col("k_id") == F.concat_ws(":", "feed", "stop_id"))
    tokens = real.join(conf, hit).select("ord", "token")
    if names:
        tokens = tokens.unionByName(real.withColumn("token", token("r", "feed", "norm")).filter(F.col("token").isin(["|".join(("r", *n)) for n in names])).select("ord", "token"))
    if ids:
        known = F.concat_ws(":", F.lit("x"), "feed", "stop_id")
        tokens = tokens.unionByName(real.withColumn("id", known).filter(F.col("id").isin(sorted(ids))).select("ord", token("i", "id").alias("token")))
        # a target may be a code
        tokens = tokens.unionByName(real.filter(F.col("code").isin(sorted(ids))).select("ord", token("i", "code").alias("token")))
    return tokens


def _folding(aliases: Aliases, feed_order: dict[str, int]):
    def fold(frame):
        import pandas as pd

        cells = [tuple(None if v is None or v != v else v for v in r) for r in frame[["ord", "feed", "stop_id", "norm", "code", "lat", "lon"]].itertuples(index=False)]
        return pd.DataFrame(fold_block(cells, aliases, feed_order), columns=["ord", "canonical", "first_ord", "target", "hits"])

    return fold


def _free_stations(real: DataFrame) -> DataFrame:
    """ord, canonical, first_ord, target, hits of stops that no alias names.

    The first stop of each code decides for all of it, and the first of each place (name and position) for the place, since later ones see
    what it saw first. What is left are pairs of places, of which each joins the first station within reach or makes one."""
    first = real.filter("code is not null").groupBy("code").agg(F.min("ord").alias("head"))
    heads = written(real.join(first, "code", "left").withColumn("head", F.coalesce("head", "ord")).select("ord", "head", "feed", "stop_id", "norm", "code", "lat", "lon"), "heads")
    free = heads.filter("ord = head")
    found = written(free.groupBy("norm", "lat", "lon").agg(F.min("ord").alias("rep"), F.count("*").alias("n")), "places")
    joins = written(first_independent(proximity_pairs(found)), "joins")
    at = free.join(found.drop("n"), ["norm", "lat", "lon"]).join(joins.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("ord").alias("head"), F.coalesce("canonical", "rep").alias("maker"))
    ids = free.select(F.col("ord").alias("maker"), F.coalesce("code", F.concat_ws(":", F.lit("x"), "feed", "stop_id")).alias("canonical"))
    return heads.select("ord", "head").join(at, "head").join(ids, "maker").select("ord", "canonical", F.col("maker").alias("first_ord"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("array<string>").alias("hits"))


def _stub_targets(spark, stubs: DataFrame, aliases: Aliases, landed: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, by_alias) of stops without a position whose alias names a station, and what their targets by name met."""
    told = "ord long, feed string, stop_id string, target string, hits array<string>"
    conf = []
    for key, target in aliases.entries.items():
        own, ref = Aliases.named(key), Aliases.named(target)
        conf.append((*(own[:2] if own else (None, None)), None if own else key, target, *(ref[:2] if ref else (None, None)), *((ref[2] or (None, None)) if ref else (None, None))))
    if not conf:
        return spark.createDataFrame([], "ord long, by_alias string"), spark.createDataFrame([], told)
    conf = F.broadcast(spark.createDataFrame(conf, "k_feed string, k_norm string, k_id string, target string, r_feed string, r_norm string, r_lat double, r_lon double"))  # configuration
    by_id = F.col("k_id") == F.concat_ws(":", "feed", "stop_id")
    hit = by_id | ((F.col("k_feed") == F.col("feed")) & (F.col("k_norm") == F.col("norm")))
    # an entry for the stop's id comes before one for its name
    mine = stubs.join(conf, hit).groupBy("ord", "feed", "stop_id").agg(F.min(F.struct(F.col("k_id").isNull(), "target", "r_feed", "r_norm", "r_lat", "r_lon")).alias("m")).select("ord", "feed", "stop_id", "m.target", "m.r_feed", "m.r_norm", "m.r_lat", "m.r_lon")
    plain = mine.filter("r_feed is null").join(stations.select(F.col("id").alias("target")), "target").select("ord", F.col("target").alias("by_alias"))
    first = landed.groupBy(F.col("feed").alias("r_feed"), F.col("norm").alias("r_norm"), F.col("canonical").alias("id")).agg(F.min("ord").alias("at")).join(stations.select("id", "lat", "lon"), "id")
    near = F.col("id").isNotNull() & (F.col("r_lat").isNull() | (flat_m(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon")) < HINT_M))
    # stations of one name in one feed
    met = mine.filter("r_feed is not null").join(first, ["r_feed", "r_norm"], "left").groupBy("ord", "feed", "stop_id", "target").agg(F.array_sort(F.collect_list(F.when(near, F.struct("at", "id")))).alias("h"))
    met = met.withColumn("hits", F.transform("h", lambda x: x["id"])).drop("h")
    return plain.unionByName(met.filter(F.size("hits") > 0).select("ord", F.col("hits")[0].alias("by_alias"))), met


def merge_in_order(stops: DataFrame, code_pattern: str = "[0-9]{7}", registry: Column | None = None) -> DataFrame:
    """ord, canonical: for stops (ord, stop_id, name, lat, lon) without aliases, the ord of the stop that made the station it joins. Registries, where given, are merged each on its own."""
    own = lambda c: c if registry is None else F.concat_ws("|", registry.cast("string"), c)
    code = code_of(F.col("stop_id"), code_pattern)
    rows = stops.filter("lat is not null and lon is not null").select("ord", F.lit("").alias("feed"), F.col("ord").cast("string").alias("stop_id"), own(merge_name(F.col("name"))).alias("norm"), F.when(code.isNotNull(), own(code)).alias("code"), "lat", "lon")
    return _free_stations(rows).select("ord", F.col("first_ord").alias("canonical"))


def renamed(stations: DataFrame, names: dict[str, str], mapping: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, issues): stations under the names that configuration gives them. Keys are ids, or "feed@name~lat,lon" of a
    stop; of several stations that a key meets the first is renamed, and a key that meets none is reported.

    stops: ord, feed, stop_id, name."""
    spark = stations.sparkSession
    conf = [(k, n, *((*ref[:2], *(ref[2] or (None, None))) if (ref := Aliases.named(k)) else (None, None, None, None)), i) for i, (k, n) in enumerate(names.items())]
    conf = F.broadcast(spark.createDataFrame(conf, "key string, new string, r_feed string, r_norm string, r_lat double, r_lon double, pos int"))  # configuration
    landed = mapping.join(stops.select("ord", "feed", "stop_id", merge_name(F.col("name")).alias("norm")), ["feed", "stop_id"]).groupBy("feed", "norm", "station").agg(F.min("ord").alias("at"))
    ids = stations.select("id", "lat", "lon")
    by_id = conf.filter("r_feed is null").join(ids, F.col("key") == F.col("id")).select("key", "new", "pos", "id", F.lit(0).cast("long").alias("at"))
    by_name = conf.join(landed, (F.col("r_feed") == F.col("feed")) & (F.col("r_norm") == F.col("norm"))).join(ids, F.col("station") == F.col("id"))
    by_name = by_name.filter(F.col("r_lat").isNull() | (flat_m(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon")) < HINT_M)).select("key", "new", "pos", "id", "at")
    met = written(by_id.unionByName(by_name).groupBy("key", "new", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("h")), "renamed")  # stations of one name
    given = met.groupBy(F.col("h")[0]["id"].alias("id")).agg(F.max_by("new", "pos").alias("new"))
    stale = F.lit("stale_override")
    detail = F.concat(F.lit("name of '"), F.col("key"), F.lit("' is ambiguous: "), F.array_join(F.transform("h", lambda x: x["id"]), ", "))
    issues = met.filter(F.size("h") > 1).select(stale.alias("kind"), detail.alias("detail")).unionByName(conf.join(met.select("key"), "key", "left_anti").select(stale.alias("kind"), F.concat(F.lit("name of '"), F.col("key"), F.lit("' matches no station")).alias("detail")))
    return stations.join(F.broadcast(given), "id", "left").withColumn("name", F.coalesce("new", "name")).drop("new"), issues  # configuration


def through_candidates(trips: DataFrame, ends: DataFrame, calls: DataFrame, most_gap: int = 60) -> DataFrame:
    """a, b, gap, ambiguous: trips of one numbered label that may be one service. A ends where B begins, B leaves within
    most_gap, and they share no other station. A pair is ambiguous if an equal gap offers a or b another partner."""
    own = trips.filter(F.col("train").rlike("(?U)\\d")).join(ends, "trip_id").filter("n >= 2")
    a = own.select(F.col("trip_id").alias("a"), "train", F.col("last_station").alias("at"), F.col("last_arr").alias("arr"))
    b = own.select(F.col("trip_id").alias("b"), "train", F.col("first_station").alias("at"), F.col("first_dep").alias("dep"))
    pairs = a.join(b, ["train", "at"]).filter("a <> b").withColumn("gap", F.col("dep") - F.col("arr")).filter(F.col("gap").between(0, most_gap))
    sets = calls.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "station"))), lambda x: x["station"]).alias("s"))
    pairs = pairs.join(sets.select(F.col("trip_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("trip_id").alias("b"), F.col("s").alias("sb")), "b")
    return _unclear(pairs.filter(_apart("sa", "sb")).select("a", "b", "train", "gap"))


def _apart(a: str, b: str) -> Column:
    """Whether the stations before a's last and after b's first have none in common."""
    return ~F.arrays_overlap(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(2), F.size(b) - 1))


def _unclear(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, train, gap) with ambiguous: whether an equal gap offers a or b another partner."""
    twice = (F.count("*").over(W.partitionBy("gap", "a")) > 1) | (F.count("*").over(W.partitionBy("gap", "b")) > 1)
    return pairs.select("a", "b", "train", "gap", twice.alias("ambiguous"))


def through_ends(calls: DataFrame) -> DataFrame:
    first, last = F.min(F.struct("idx", "station", "dep")), F.max(F.struct("idx", "station", "arr"))
    return calls.groupBy("trip_id").agg(F.count("*").alias("n"), first.alias("f"), last.alias("l")).select("trip_id", "n", F.col("f.station").alias("first_station"), F.col("f.dep").alias("first_dep"), F.col("l.station").alias("last_station"), F.col("l.arr").alias("last_arr"))


def locally_least(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (gap, a, b) that are taken if pairs are gone through in order and each end serves once.

    In each round all pairs are taken that are first at both their ends, which no earlier pair can prevent; pairs that
    share an end with them go. Rounds are as many as the longest chain of pairs of which each waits for the next."""
    chosen, alive = None, pairs.select("gap", "a", "b")
    while True:
        ends = alive.select(F.explode(F.array("a", "b")).alias("node"), F.struct("gap", "a", "b").alias("p"))
        first = ends.groupBy("node").agg(F.min("p").alias("p"))
        taken = written(first.groupBy("p").count().filter("count = 2").select("p.a", "p.b"), "taken")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        node = taken.select(F.explode(F.array("a", "b")).alias("node"))
        rest = alive.join(node.withColumnRenamed("node", "a"), "a", "left_anti").join(node.withColumnRenamed("node", "b"), "b", "left_anti")
        alive = written(rest.select("gap", "a", "b"), "alive")
        if alive.isEmpty():
            return chosen


def through_passes(trips: DataFrame, calls: DataFrame, passes: int = 5, most_gap: int = 60) -> tuple[DataFrame, DataFrame]:
    """(services, left): train and members of every service, and train and n, pairs that a pass left for being ambiguous.

    Each pass joins pairs by gap, then trips' order, a trip once; passes go on while any pair joins. Only trips that are in
    some candidate are kept with their stations: a service's later candidates begin where its last trip ends, so they were candidates of that trip."""
    ends = through_ends(calls)
    own = written(trips.filter(F.col("train").rlike("(?U)\\d")).select("trip_id", "train").join(ends.filter("n >= 2"), "trip_id"), "through")
    pairs = written(through_candidates(trips, ends, calls, most_gap), "through-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("trip_id")).distinct()
    stations = calls.join(nodes, "trip_id", "left_semi").groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "station"))), lambda x: x["station"]).alias("stations"))
    live = own.join(stations, "trip_id").select(F.col("trip_id").alias("id"), "train", F.array("trip_id").alias("members"), "stations", "first_station", "first_dep", "last_station", "last_arr")
    live, left = written(live, "through-live"), []
    for k in range(passes):
        left.append(pairs.filter("ambiguous").select("train"))
        clear = pairs.filter("not ambiguous")
        if clear.isEmpty():
            break
        chosen = written(locally_least(clear), "through-chosen")
        x, y = live.alias("x"), live.alias("y")
        after = x.join(chosen.select(F.col("b").alias("id")), "id", "left_anti").alias("x").join(chosen.alias("c"), F.col("x.id") == F.col("c.a"), "left").join(y, F.col("c.b") == F.col("y.id"), "left")
        more = lambda own, other: F.when(F.col("c.b").isNull(), own).otherwise(F.concat(own, other))
        live = written(
            after.select(
                "x.id", "x.train",
                more(F.col("x.members"), F.col("y.members")).alias("members"),
                more(F.col("x.stations"), F.slice("y.stations", F.lit(2), F.greatest(F.size("y.stations") - 1, F.lit(0)))).alias("stations"),
                "x.first_station", "x.first_dep",
                F.coalesce("y.last_station", "x.last_station").alias("last_station"), F.coalesce("y.last_arr", "x.last_arr").alias("last_arr"),
            ), "through-live")
        if k + 1 < passes:
            a, b = live.alias("a"), live.alias("b")
            met = a.join(b, (F.col("a.train") == F.col("b.train")) & (F.col("a.last_station") == F.col("b.first_station")) & (F.col("a.id") != F.col("b.id")))
            met = met.withColumn("gap", F.col("b.first_dep") - F.col("a.last_arr")).filter(F.col("gap").between(0, most_gap))
            pairs = written(_unclear(met.filter(_apart("a.stations", "b.stations")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "a.train", "gap")), "through-pairs")
    alone = own.join(nodes, "trip_id", "left_anti").select("train", F.array("trip_id").alias("members"))
    said = left[0]
    for more_left in left[1:]:
        said = said.unionByName(more_left)
    return written(live.select("train", "members").unionByName(alone), "services"), said.groupBy("train").agg(F.count("*").alias("n"))


def join_through(trips: DataFrame, calls: DataFrame, passes: int = 5, most_gap: int = 60) -> DataFrame:
    """head, members: joined trips in order of travel, trips that join none alone."""
    return through_passes(trips, calls, passes, most_gap)[0].select(F.col("members")[0].alias("head"), "members")


def ambiguous_labels(trips: DataFrame, calls: DataFrame, passes: int = 5, most_gap: int = 60, top: int = 5) -> DataFrame:
    """train, n: labels with the most pairs that were left for being ambiguous. A pair that stays is counted in each pass."""
    return through_passes(trips, calls, passes, most_gap)[1].orderBy(F.desc("n"), "train").limit(top)


def through_calls(services: DataFrame, calls: DataFrame) -> DataFrame:
    """head, idx, station, arr, dep of joined trips: where one trip hands over to the next, arrival is the first's and departure the second's."""
    m = services.select("head", F.size("members").alias("n"), F.posexplode("members").alias("pos", "trip_id"))
    rows = calls.join(m, "trip_id").withColumn("last", F.max("idx").over(W.partitionBy("trip_id")) == F.col("idx"))
    order = W.partitionBy("head").orderBy("pos", "idx")
    rows = rows.withColumns({"next_dep": F.lead("dep").over(order), "first": F.min("idx").over(W.partitionBy("trip_id")) == F.col("idx")})
    ends = F.col("last") & (F.col("pos") < F.col("n") - 1)
    rows = rows.filter(~(F.col("first") & (F.col("pos") > 0))).withColumn("dep", F.when(ends, F.col("next_dep")).otherwise(F.col("dep")))
    return rows.select("head", F.row_number().over(order).alias("idx"), "station", "arr", "dep")


def through_trips(services: DataFrame, trips: DataFrame) -> DataFrame:
    """head, trip_id (the members' ids joined by +), train (the first's) and feeds (each once, in order of travel) of joined trips."""
    m = services.select("head", F.posexplode("members").alias("pos", "id")).join(trips.select(F.col("trip_id").alias("id"), "train", "feed"), "id")
    held = F.array_sort(F.collect_list(F.struct("pos", "id", "train", "feed"))).alias("m")  # the members of one service
    return m.groupBy("head").agg(held).select("head", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), "+").alias("trip_id"), F.col("m")[0]["train"].alias("train"), F.array_distinct(F.transform("m", lambda x: x["feed"])).alias("feeds"))


#: Degrees of latitude of a slab.
SLAB = 0.25


def crossed_rings(points: DataFrame, edges: DataFrame, ring: list[str], same: list[str] | None = None) -> DataFrame:
    """id of points (id, lon, lat) and ring of those rings that hold them, by the half-open rule. edges: the columns ring, x1, y1, x2, y2.

    Edges are cut into slabs of latitude; a point meets only the edges of its slab (and of equal columns same), and the parity of those
    to its right is an aggregate, so that neither a ring nor what a point meets is held in one row."""
    slab = lambda c: F.floor(c / SLAB)
    sides = edges.filter("y1 <> y2").withColumn("slab", F.explode(F.sequence(slab(F.least("y1", "y2")), slab(F.greatest("y1", "y2")))))
    p, e = points.withColumn("slab", slab(F.col("lat"))).alias("p"), sides.alias("e")
    on = F.col("p.slab") == F.col("e.slab")
    for c in same or []:
        on = on & (F.col(f"p.{c}") == F.col(f"e.{c}"))
    lat, lon = F.col("p.lat"), F.col("p.lon")
    x = (F.col("e.x2") - F.col("e.x1")) * (lat - F.col("e.y1")) / (F.col("e.y2") - F.col("e.y1")) + F.col("e.x1")
    met = p.join(e, on & ((F.col("e.y1") > lat) != (F.col("e.y2") > lat)) & (lon < x))
    return met.groupBy(F.col("p.id").alias("id"), *[F.col(f"e.{c}").alias(c) for c in ring]).agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def in_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """id, iso: the first polygon whose exterior holds a point and none of whose holes does. edges: iso, ord, ring (0 is
    the exterior), x1, y1, x2, y2. Crossings are counted for each ring, by the half-open rule."""
    inside = crossed_rings(points.select("id", "lon", "lat"), edges, ["iso", "ord", "ring"])
    held = inside.groupBy("id", "iso", "ord").agg(F.max("ring").alias("hole")).filter("hole = 0")
    return held.groupBy("id").agg(F.min(F.struct("ord", "iso")).alias("m")).select("id", "m.iso")


def nearest_override(overrides: DataFrame, stations: DataFrame, most_m: float = NEAR_M) -> DataFrame:
    """ord, id, n: the nearest station within most_m of each override, and how many are within. Joined on grid cells."""
    own = overrides.withColumns({"cy": F.floor(F.col("o_lat") / CELL), "cx": F.floor(F.col("o_lon") / CELL)})
    wide = own.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    d = great_circle_m(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon"))
    placed = stations.withColumns({"cy": F.floor(F.col("lat") / CELL), "cx": F.floor(F.col("lon") / CELL)})
    near = placed.join(wide, ["cy", "cx"]).withColumn("d", d).filter(F.col("d") <= most_m)
    return near.groupBy("ord").agg(F.min(F.struct("d", "id")).alias("m"), F.count("*").alias("n")).select("ord", "m.id", "n")


def assign_countries(stations: DataFrame, edges: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, audit): countries by override, else by polygon, else as the feed says; and a row (kind, subject, old, new) for
    each change, each station in no polygon, and each override that met no station or several.

    stations: id, name, country, lat, lon; overrides: ord, o_name, o_lat, o_lon, country. Of overrides of one station the last counts."""
    met = written(nearest_override(overrides.drop("country"), stations), "overrides")
    said = met.join(overrides.select("ord", "o_name", F.col("country").alias("o_country")), "ord")
    forced = said.groupBy("id").agg(F.max_by("o_country", "ord").alias("o_country"))
    both = stations.join(forced, "id", "left").join(in_polygons(stations, edges), "id", "left")
    both = written(both.withColumn("new", F.coalesce("o_country", "iso", "country")), "countries")
    audit = both.filter("o_country is not null or not (new <=> country)").select(F.lit("changed").alias("kind"), F.col("id").cast("string").alias("subject"), F.col("country").alias("old"), "new")
    audit = audit.unionByName(both.filter("o_country is null and iso is null").select(F.lit("no polygon").alias("kind"), F.col("id").cast("string").alias("subject"), F.col("country").alias("old"), F.col("country").alias("new")))
    audit = audit.unionByName(overrides.join(met, "ord", "left_anti").select(F.lit("unused override").alias("kind"), F.col("o_name").alias("subject"), F.lit(None).cast("string").alias("old"), F.col("country").alias("new")))
    audit = audit.unionByName(said.filter("n > 1").select(F.lit("ambiguous override").alias("kind"), F.col("o_name").alias("subject"), F.col("id").cast("string").alias("old"), F.col("o_country").alias("new")))
    return both.withColumn("country", F.col("new")).select(*stations.columns), audit


def is_border(name: Column) -> Column:
    """Whether a station is a point on a border, which no catalogue sells."""
    return F.contains(name, F.lit("(Gr)"))


def match_catalogue(stations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """id, candidate, how: by equal name within 5 km, else a name that holds the other (4 letters or more), else the nearest within 0.5 km. Points on borders match nothing.

    What decides is the folded name and the position, so places meet places, and a place of the catalogue stands with its least id:
    copies on either side are never paired."""
    c = catalogue.select(F.col("id").alias("candidate"), booking_name(F.col("name")).alias("cn"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    c = c.groupBy("cn", "c_lat", "c_lon").agg(F.min("candidate").alias("candidate")).withColumns({"y": F.floor(F.col("c_lat") / CELL), "x": F.floor(F.col("c_lon") / CELL)})
    own = stations.filter(~is_border(F.col("name"))).select("id", booking_name(F.col("name")).alias("sn"), "lat", "lon")
    s = own.groupBy("sn", "lat", "lon").agg(F.count("*").alias("n")).withColumn("y", F.explode(F.sequence(F.floor(F.col("lat") / CELL) - 1, F.floor(F.col("lat") / CELL) + 1))).withColumn("x", F.explode(F.sequence(F.floor(F.col("lon") / CELL) - 2, F.floor(F.col("lon") / CELL) + 2)))
    near = s.join(c, ["y", "x"]).withColumn("km", grid_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).filter("km <= 5")
    holds = (F.length("sn") >= 4) & (F.length("cn") >= 4) & (F.contains("sn", "cn") | F.contains("cn", "sn"))
    how = F.when(F.col("sn") == F.col("cn"), 1).when(holds, 2).when(F.col("km") <= 0.5, 3)
    best = near.withColumn("how", how).filter("how is not null").groupBy("sn", "lat", "lon").agg(F.min(F.struct("how", "km", "candidate")).alias("m"))
    return own.join(best, ["sn", "lat", "lon"]).groupBy("id").agg(F.min("m").alias("m")).select("id", "m.candidate", "m.how")


def match_counts(stations: DataFrame, matches: DataFrame) -> DataFrame:
    """kind, n: stations matched by name, by place alone, and left out as points on borders."""
    kinds = stations.join(matches.select("id", "how"), "id", "left").select(F.when(is_border(F.col("name")), "border").when(F.col("how") <= 2, "name").when(F.col("how") == 3, "coord").alias("kind"))
    return kinds.filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def duplicates(stations: DataFrame) -> DataFrame:
    """ord, other: stations that look like one and weren't merged. Those of one place stand with its first, and pairs of places by their first."""
    found = written(places(stations), "places")
    same = place_members(stations).filter("ord <> rep").select(F.col("rep").alias("ord"), F.col("ord").alias("other"))
    return same.unionByName(proximity_pairs(found).select(F.col("a").alias("ord"), F.col("b").alias("other")))
