"""What the engine leaves: the graph by day, a JSON document for each origin, small tables; plain and packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.scratch import written


def write_graph(calls: DataFrame, path: str) -> None:
    """Calls (with a column day) as Parquet, a folder for each day; days that aren't in calls stay as they are."""
    calls.repartition("day", F.pmod(F.xxhash64("trip_id"), F.lit(32))).sortWithinPartitions("day", "trip_id", "idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_graph(spark: SparkSession, path: str, legacy_day: str = "legacy") -> DataFrame:
    """Calls of all days; a graph that isn't parted by day, or a null day, gets the day `legacy_day`."""
    rows = spark.read.parquet(path)
    return rows.withColumn("day", F.coalesce(F.col("day").cast("string"), F.lit(legacy_day)) if "day" in rows.columns else F.lit(legacy_day))


def transfer_leg(mode: Column, minutes: Column, a: Column, b: Column) -> Column:
    """A leg on foot or by local transport, in the form of reach documents."""
    return F.struct(F.lit("transfer").alias("type"), mode.alias("mode"), minutes.alias("minutes"), a.alias("from_id"), b.alias("to_id"))


def nonzero(histograms: Column) -> Column:
    """A map of tiers without those that hold only zeros; null if none is left, so that JSON omits it."""
    left = F.map_filter(histograms, lambda k, days: F.exists(F.map_values(days), lambda hours: F.exists(hours, lambda n: n != 0)))
    return F.when(F.size(left) > 0, left)


def reach_documents(destinations: DataFrame, computed_at: str, sample_date: str) -> DataFrame:
    """origin and value, a JSON document, of destinations (origin, id, and what else is known of each).

    An origin has at most one destination for each station, so its document is bounded by the network; origins
    without destinations have no row, and null fields are left out."""
    inner = F.struct("id", *[c for c in destinations.columns if c not in ("origin", "id")])
    body = F.struct(F.col("origin").cast("string").alias("origin"), F.lit(computed_at).alias("computed_at"), F.lit(sample_date).alias("sample_date"), "destinations")
    rows = destinations.groupBy("origin").agg(F.array_sort(F.collect_list(inner), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("destinations"))
    return rows.select("origin", F.to_json(body).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """documents (origin, value) as one text file for each origin under path/plain, and packed under path/gzip.

    Both are replaced as a whole, so documents of origins that are gone don't stay; they are computed once."""
    held = written(documents, "documents")
    for name, packing in (("plain", "none"), ("gzip", "gzip")):
        held.repartition("origin").write.mode("overwrite").option("compression", packing).partitionBy("origin").text(f"{path}/{name}")


def write_small(rows: DataFrame, path: str) -> None:
    """A table of configuration size (stations, issues, cities) as one JSON file, plain and packed."""
    for name, packing in (("plain", "none"), ("gzip", "gzip")):
        rows.coalesce(1).write.mode("overwrite").option("compression", packing).json(f"{path}/{name}")
