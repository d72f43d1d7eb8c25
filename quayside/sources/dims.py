"""Configuration as small tables: feeds, cities, footpaths, capitals, names; polygons; a booking catalogue.

Configuration files are read through Spark's readers, so they may lie in any store, and parsed on the
driver: they are written by hand and their size doesn't follow the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("walk", "metro", "tram", "bus", "rail", "ferry", "taxi")

_FEED = "feed string, ord int, url string, country string, license string, format string, route_allow array<string>, trip_allow array<string>, stop_id_allow array<string>, stop_id_brand array<struct<pattern: string, brand: string>>, uic_regex string"


def toml(spark: SparkSession, path: str) -> dict:
    """The content of one configuration file."""
    import tomllib

    return tomllib.loads(spark.read.text(path, wholetext=True).first().value)


def feeds(spark: SparkSession, conf: dict) -> DataFrame:
    """A row for each feed, in the file's order, which is the order of precedence. Brands keep their order too."""
    rows = []
    for k, (name, c) in enumerate(conf.get("feeds", {}).items()):
        if lacking := [x for x in ("url", "country", "license", "route_allow") if x not in c]:
            raise ValueError(f"feed {name} lacks {', '.join(lacking)}")
        kind, brand = c.get("format", "gtfs"), c.get("stop_id_brand")
        if kind not in ("gtfs", "netex"):
            raise ValueError(f"feed {name} has the unknown format {kind}")
        if c.get("stop_id_allow") and brand:
            raise ValueError(f"feed {name} filters stop ids in two ways")
        rows.append((name, k, c["url"], c["country"], c["license"], kind, c["route_allow"], c.get("trip_allow"), c.get("stop_id_allow"), None if brand is None else list(brand.items()), c.get("uic_regex")))
    return spark.createDataFrame(rows, _FEED)


def pairs(spark: SparkSession, conf: dict, table: str) -> DataFrame:
    """key, value of a table of texts, such as aliases or names."""
    return spark.createDataFrame(list(conf.get(table, {}).items()), "key string, value string")


def country_overrides(spark: SparkSession, conf: dict) -> DataFrame:
    """ord, o_name, o_lat, o_lon, country."""
    return spark.createDataFrame([(k, o["name"], float(o["lat"]), float(o["lon"]), o["country"]) for k, o in enumerate(conf.get("override", []))], "ord int, o_name string, o_lat double, o_lon double, country string")


def cities(spark: SparkSession, conf: dict, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(city, ord, id) of cities with two stations or more, and issues (city, member, issue). Members are matched by exact name."""
    rows = [(city, k, m) for city, members in conf.get("cities", {}).items() for k, m in enumerate(members)]
    named = F.broadcast(spark.createDataFrame(rows, "city string, ord int, member string"))
    found = stations.select(F.col("name").alias("member"), "id").join(named, "member")
    large = found.groupBy("city").agg(F.count("*").alias("n"))
    lone = large.filter("n < 2").select("city", F.lit(None).cast("string").alias("member"), F.lit("fewer than two stations").alias("issue"))
    unknown = named.join(found.select("member").distinct(), "member", "left_anti").select("city", "member", F.lit("no station").alias("issue"))
    return found.join(large.filter("n >= 2"), "city").select("city", "ord", "id"), unknown.unionByName(lone)


def _fault(city: str, entry, groups: dict) -> str | None:
    if not isinstance(entry, list) or len(entry) != 4 or not all(isinstance(x, str) for x in entry[:3]) or type(entry[3]) is not int or entry[3] <= 0:
        return "no transfer"
    if entry[2] not in MODES:
        return "unknown mode"
    return None if {entry[0], entry[1]} <= set(groups.get(city, ())) else "not in one city"


def footpaths(spark: SparkSession, conf: dict, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, minutes, mode, ord) of transfers between two stations that each have one exact name, and issues (city, ord, issue)."""
    good, bad = [], []
    for ord_, (city, entry) in enumerate((c, e) for c, entries in conf.get("transfers", {}).items() for e in entries):
        fault = _fault(city, entry, conf.get("cities", {}))
        if fault:
            bad.append((city, ord_, fault))
        else:
            good.append((city, ord_, *entry))
    asked = spark.createDataFrame(good, "city string, ord int, a string, b string, mode string, minutes int")
    ends = asked.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    by_name = stations.join(F.broadcast(ends), "name").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    side = lambda c: by_name.select(F.col("name").alias(c), F.col("n").alias(f"n_{c}"), F.col("id").alias(f"id_{c}"))
    met = asked.join(side("a"), "a", "left").join(side("b"), "b", "left")
    issue = F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), "no station").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "ambiguous station")
    faults = spark.createDataFrame(bad, "city string, ord int, issue string").unionByName(met.filter(issue.isNotNull()).select("city", "ord", issue.alias("issue")))
    return met.filter(issue.isNull()).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "minutes", "mode", F.col("ord").cast("long").alias("ord")), faults


def capitals(spark: SparkSession, conf: dict, stations: DataFrame) -> DataFrame:
    """country, name, id (null: no station of that country has the name; of several the greatest)."""
    asked = spark.createDataFrame([(c.upper(), n) for c, n in conf.get("capitals", {}).items()], "country string, name string")
    found = stations.select("country", "name", "id").join(F.broadcast(asked), ["country", "name"]).groupBy("country", "name").agg(F.max("id").alias("id"))
    return asked.join(found, ["country", "name"], "left")


def polygon_edges(spark: SparkSession, path: str) -> DataFrame:
    """iso, ord (of the polygon), ring (0 is the exterior), x1, y1, x2, y2 of a feature collection; features without a code go."""
    ring = "array<array<double>>"
    # the depth of coordinates depends on the kind of geometry, so they are parsed apart
    rows = spark.read.schema("features array<struct<properties: struct<ISO_A2_EH: string, ISO_A2: string>, geometry: struct<type: string, coordinates: string>>>").json(path, multiLine=True)
    f = rows.select(F.posexplode("features").alias("nth", "f")).select("nth", F.coalesce(F.nullif("f.properties.ISO_A2_EH", F.lit("")), F.nullif("f.properties.ISO_A2", F.lit(""))).alias("iso"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one, many = F.array(F.from_json("c", f"array<{ring}>")), F.from_json("c", f"array<array<{ring}>>")
    polys = f.filter("iso <> '-99'").select("nth", "iso", F.posexplode(F.when(F.col("type") == "Polygon", one).otherwise(many)).alias("poly", "p"))
    rings = polys.select("iso", (F.col("nth") * 1_000_000 + F.col("poly")).alias("ord"), F.posexplode("p").alias("ring", "r"))
    edge = F.explode(F.zip_with("r", F.concat(F.slice("r", F.lit(2), F.size("r")), F.slice("r", 1, 1)), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))))
    return rings.select("iso", "ord", "ring", edge.alias("e")).select("iso", "ord", "ring", "e.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """id, name, lat, lon of a booking catalogue's rows that can be suggested and have a position; none at all if one of them has a position that is no number."""
    rows = spark.read.csv(path, sep=";", header=True, quote='"', escape='"', multiLine=True)
    if not {"id", "name", "latitude", "longitude", "is_suggestable"} <= set(rows.columns):
        return spark.createDataFrame([], "id string, name string, lat double, lon double")
    kept = rows.filter("is_suggestable = 't' and latitude <> '' and longitude <> ''").select("id", "name", F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"))
    return kept if kept.filter("lat is null or lon is null").isEmpty() else kept.limit(0)
