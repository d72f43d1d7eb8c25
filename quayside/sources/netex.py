"""Timetable publications in XML, through Spark's XML source: one scan for each kind of element.

Files may be gzip (ending .gz) or plain. Rows carry feed, the file's name up to its first dot; row_order
follows the document. Plain files are split among tasks, packed ones are one task each.

Cases: a missing kind of element gives no rows; missing texts are empty; of several assignments of a day
type the last counts; journeys need two timed calls at known stops and an allowed line; a time that stands
for the other is moved by the other's day offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.text import minutes_of
from quayside.operators.calendar import runs
from quayside.operators.feeds import any_match

_REF = "STRUCT<_ref: STRING>"
_AT = "STRUCT<Latitude: STRING, Longitude: STRING>"
_ELEMENTS = {
    "Line": "_id STRING, ShortName STRING, Name STRING",
    "UicOperatingPeriod": "_id STRING, FromDate STRING, ToDate STRING, ValidDayBits STRING",
    "DayTypeAssignment": f"DayTypeRef {_REF}, OperatingPeriodRef {_REF}",
    "StopPlace": f"_id STRING, Name STRING, Centroid STRUCT<Location: {_AT}>",
    "ScheduledStopPoint": f"_id STRING, Name STRING, Location {_AT}, StopPlaceRef {_REF}",
    "ServiceJourneyPattern": f"_id STRING, LineRef {_REF}, RouteView STRUCT<LineRef: {_REF}>, pointsInSequence STRUCT<StopPointInJourneyPattern: ARRAY<STRUCT<_id: STRING, ScheduledStopPointRef: {_REF}>>>",
    "ServiceJourney": f"_id STRING, Name STRING, dayTypes STRUCT<DayTypeRef: ARRAY<{_REF}>>, ServiceJourneyPatternRef {_REF}, passingTimes STRUCT<TimetabledPassingTime: ARRAY<STRUCT<StopPointInJourneyPatternRef: {_REF}, ArrivalTime: STRING, ArrivalDayOffset: STRING, DepartureTime: STRING, DepartureDayOffset: STRING>>>",
}
#: Positions that a publication states wrongly.
POSITIONS = {"IT::ScheduledStopPoint:otherTRENITALIA:830009988": (40.931758, 14.331131)}


def elements(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    """feed, row_order and the content of all elements of one kind."""
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(_ELEMENTS[tag]).load(paths)
    return rows.select(F.element_at(F.split("_metadata.file_name", r"\."), 1).alias("feed"), F.monotonically_increasing_id().alias("row_order"), *rows.columns)


def _text(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row, in document order, of each key."""
    others = [c for c in rows.columns if c not in keys]
    held = F.struct("row_order", *[c for c in others if c != "row_order"])
    return rows.groupBy(*keys).agg(F.max_by(held, "row_order").alias("m")).select(*keys, "m.*")


def window(periods: DataFrame) -> DataFrame:
    """first_day, last_day over all operating periods."""
    d = periods.select(F.explode(F.array(*[F.to_date(F.substring(F.trim(c), 1, 10)) for c in ("FromDate", "ToDate")])).alias("d"))
    return d.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))


def day_bits(periods: DataFrame, assignments: DataFrame) -> DataFrame:
    """feed, daytype, start, bits: the period that the last assignment of a day type names."""
    p = _last(periods.select("feed", "row_order", F.col("_id").alias("period"), F.to_date(F.substring(F.trim("FromDate"), 1, 10)).alias("start"), _text("ValidDayBits").alias("bits")), "feed", "period").drop("row_order")
    a = _last(assignments.select("feed", "row_order", F.col("DayTypeRef._ref").alias("daytype"), F.col("OperatingPeriodRef._ref").alias("period")), "feed", "daytype").drop("row_order")
    return a.join(p, ["feed", "period"]).select("feed", "daytype", "start", "bits")


def _position(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit("")).cast("double")


def stops(places: DataFrame, points: DataFrame) -> DataFrame:
    """feed, stop_id, name, lat, lon: stop places, and stop points that name no place; a point replaces a place of its id."""
    by_place = places.select("feed", F.lit(0).alias("kind"), "row_order", F.col("_id").alias("stop_id"), _text("Name").alias("name"), _position("Centroid.Location.Latitude").alias("lat"), _position("Centroid.Location.Longitude").alias("lon"))
    lat, lon = _position("Location.Latitude"), _position("Location.Longitude")
    for stop, (y, x) in POSITIONS.items():
        lat, lon = F.when(F.col("_id") == stop, y).otherwise(lat), F.when(F.col("_id") == stop, x).otherwise(lon)
    own = points.filter(F.coalesce("StopPlaceRef._ref", F.lit("")) == "")
    by_point = own.select("feed", F.lit(1).alias("kind"), "row_order", F.col("_id").alias("stop_id"), _text("Name").alias("name"), lat.alias("lat"), lon.alias("lon"))
    best = by_place.unionByName(by_point).groupBy("feed", "stop_id").agg(F.max_by(F.struct("name", "lat", "lon"), F.struct("kind", "row_order")).alias("m"))
    return best.select("feed", "stop_id", "m.*")


def journeys(spark: SparkSession, paths: str | list[str], patterns: list[str]) -> DataFrame:
    """feed, row_order, trip_id, train, daytypes and calls (an array of idx, stop_id, arr, dep) of journeys of allowed lines."""
    lines = _last(elements(spark, paths, "Line").select("feed", "row_order", F.col("_id").alias("line"), _text("ShortName").alias("short"), _text("Name").alias("long")), "feed", "line")
    lines = lines.filter(any_match(F.col("short"), patterns) | any_match(F.col("long"), patterns)).select("feed", "line", "short")
    ways = _last(elements(spark, paths, "ServiceJourneyPattern").select("feed", "row_order", F.col("_id").alias("way"), F.coalesce("LineRef._ref", "RouteView.LineRef._ref").alias("line"), F.col("pointsInSequence.StopPointInJourneyPattern").alias("seq")), "feed", "way").drop("row_order")
    ways = ways.join(lines, ["feed", "line"])
    scheduled = elements(spark, paths, "ScheduledStopPoint")
    known = stops(elements(spark, paths, "StopPlace"), scheduled).select("feed", "stop_id")
    target = _last(scheduled.select("feed", "row_order", F.col("_id").alias("point"), F.coalesce(F.nullif("StopPlaceRef._ref", F.lit("")), "_id").alias("stop_id")), "feed", "point").drop("row_order")
    places = ways.select("feed", "way", F.explode("seq").alias("s")).select("feed", "way", F.col("s._id").alias("at"), F.col("s.ScheduledStopPointRef._ref").alias("point"))
    places = places.join(target.join(known, ["feed", "stop_id"]), ["feed", "point"]).select("feed", "way", "at", "stop_id").dropDuplicates(["feed", "way", "at"])
    found = elements(spark, paths, "ServiceJourney").select("feed", "row_order", F.col("_id").alias("trip_id"), _text("Name").alias("name"), F.col("ServiceJourneyPatternRef._ref").alias("way"), F.coalesce(F.col("dayTypes.DayTypeRef._ref"), F.array().cast("array<string>")).alias("daytypes"), F.col("passingTimes.TimetabledPassingTime").alias("times"))
    found = found.join(ways.select("feed", "way", "short"), ["feed", "way"])
    arrival, departure = F.nullif(F.trim("t.ArrivalTime"), F.lit("")), F.nullif(F.trim("t.DepartureTime"), F.lit(""))
    plus = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")).cast("int"), F.lit(0)) * 1440
    timed = found.select("feed", "row_order", "way", F.posexplode("times").alias("pos", "t")).filter(arrival.isNotNull() | departure.isNotNull())
    timed = timed.select("feed", "row_order", "way", "pos", F.col("t.StopPointInJourneyPatternRef._ref").alias("at"), (minutes_of(F.coalesce(arrival, departure)) + plus("t.ArrivalDayOffset")).alias("arr"), (minutes_of(F.coalesce(departure, arrival)) + plus("t.DepartureDayOffset")).alias("dep"))
    # the calls of one journey are few
    calls = timed.join(places, ["feed", "way", "at"]).groupBy("feed", "row_order").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_id", "arr", "dep"))).alias("c")).filter(F.size("c") >= 2)
    numbered = F.transform("c", lambda x, k: F.struct((k + 1).alias("idx"), x["stop_id"].alias("stop_id"), x["arr"].alias("arr"), x["dep"].alias("dep")))
    return found.join(calls, ["feed", "row_order"]).select("feed", "row_order", "trip_id", F.trim(F.concat_ws(" ", "short", "name")).alias("train"), "daytypes", numbered.alias("calls"))


def on_day(rows: DataFrame, bits: DataFrame, day: Column) -> DataFrame:
    """Journeys of which any day type runs on a day."""
    going = bits.filter(runs(F.col("bits"), F.col("start"), day)).select("feed", "daytype")
    named = rows.select("feed", "row_order", F.explode("daytypes").alias("daytype")).join(going, ["feed", "daytype"]).select("feed", "row_order").distinct()
    return rows.join(named, ["feed", "row_order"], "left_semi")
