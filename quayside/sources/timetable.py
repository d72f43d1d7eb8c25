"""A deterministic timetable as a projection of the star-schema tables, so that every operator has rows at any scale."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = ("IC", "ICE", "RJX", "EC", "TGV", "RE")
CITIES = ("München", "Zürich", "Łódź", "Köln", "Praha")
ENDINGS = ("", " Hbf", " Hauptbahnhof")
MODES = ("walk", "metro", "tram", "bus", "rail", "ferry", "taxi")
SLICE = ("1998-06-01", "1998-07-01")
#: Lines that a task sorts at once, however large the table is.
LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def orders_in(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter((F.col("o_orderdate") >= F.lit(start).cast("timestamp")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp"))) if start else o


def trips(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """trip_id, service_day, train, feed, service_id: orders that have a line."""
    o = orders_in(spark, sf_dir, start, end).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    key = F.col("o_orderkey")
    train = F.concat(_pick(LABELS, key % 6), F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.month("o_orderdate").cast("string"))))
    return o.join(c, "o_custkey").join(n, "c_nationkey").select(key.alias("trip_id"), F.to_date("o_orderdate").alias("service_day"), train.alias("train"), F.col("r_name").alias("feed"), (F.col("o_custkey") % 150).alias("service_id"))


def _by_order(lines: DataFrame) -> DataFrame:
    """The lines dealt out by order. Spark deals small tables out among its cores; larger ones, of which a core would have
    more than LINES, go into so many parts that a task has no more on average, and Spark doesn't put these together again."""
    spark, n = lines.sparkSession, lines.count()
    if n <= LINES * spark.sparkContext.defaultParallelism:
        return lines.repartition("l_orderkey")
    return lines.repartition(max(-(-n // LINES), int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")


def stop_times(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """trip_id, idx (from 1), station, arr, dep: lines of an order as calls of a trip."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if not start:
        lines = _by_order(lines)  # ahead of what is derived, so that all readers share one exchange of four columns
    else:
        lines = lines.join(orders_in(spark, sf_dir, start, end).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    # lines equal in these are the same call, whatever the further columns by which the SQL numbers them
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    arr = 300 + (F.col("l_orderkey") * 37) % 900 + F.sum(20 + F.col("l_partkey") % 100).over(order.rowsBetween(W.unboundedPreceding, 0))
    calls = lines.select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("idx"), F.col("l_suppkey").alias("station"), arr.alias("arr"))
    return calls.select(F.col("l_orderkey").alias("trip_id"), "idx", "station", "arr", (F.col("arr") + F.col("l_linenumber") % 5).alias("dep"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey").select(k.alias("id"), F.col("s_name").alias("name"), (47 + (k * 7919 % 10000) / 1000.0).alias("lat"), (5 + (k * 104729 % 15000) / 1000.0).alias("lon"), F.col("n_name").alias("country"), (k % 10 == 0).alias("is_capital"))


def footpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, minutes, mode, ord: undirected pairs of neighbouring stations."""
    k = F.col("id")
    return stations(spark, sf_dir).filter(k % 7 == 0).select(k.alias("a"), (k + 1).alias("b"), (15 + k % 30).alias("minutes"), _pick(MODES, k % 7).alias("mode"), k.alias("ord"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(F.expr("p_partkey div 2").alias("service_id"), ((size * 2 + k % 2) % 128).cast("int").alias("days"), F.lit("2024-01-01").cast("date").alias("start_date"), F.lit("2024-01-30").cast("date").alias("end_date"))


def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service_id, date, is_add, ts, row_order: exceptions in file order."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return e.select(F.col("user_id").alias("service_id"), F.to_date("ts").alias("date"), (F.col("event_type") == "signup").alias("is_add"), "ts", F.col("event_id").alias("row_order"))


def raw_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, stop_ord, stop_id, name, lat, lon: one physical station under several names and feeds."""
    s = table(spark, sf_dir, "supplier").select(F.lit(0).cast("long").alias("feed"), F.col("s_suppkey").alias("k"))
    c = table(spark, sf_dir, "customer").select((1 + F.col("c_custkey") % 3).alias("feed"), F.col("c_custkey").alias("k"))
    k = F.col("k")
    name = F.concat(_pick(CITIES, k % 5), F.lit(" "), (k % 40).cast("string"), _pick(ENDINGS, k % 3))
    code = F.concat(F.lit("st:"), (1000000 + k % 300).cast("string"), F.when(k % 4 == 0, "9").otherwise(""))
    return s.unionByName(c).select("feed", k.alias("stop_ord"), code.alias("stop_id"), name.alias("name"), (47 + (k % 40) * 0.05 + (k % 7) * 0.001).alias("lat"), (8 + (k % 40) * 0.05 + (k % 5) * 0.001).alias("lon"))


_LINES = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"
#: The same projections in DuckDB's SQL, in order of dependence.
VIEWS = {
    "tt_trips": "SELECT o_orderkey AS trip_id, o_orderdate::DATE AS service_day, ['IC','ICE','RJX','EC','TGV','RE'][o_orderkey % 6 + 1] || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ' ' || month(o_orderdate) END AS train, r_name AS feed, o_custkey % 150 AS service_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "tt_calls0": f"SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER w AS idx, 300 + (l_orderkey * 37) % 900 + sum(20 + l_partkey % 100) OVER (w ROWS UNBOUNDED PRECEDING) AS arr FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES})",
    "tt_stop_times": "SELECT l_orderkey AS trip_id, idx::INT AS idx, l_suppkey AS station, arr::BIGINT AS arr, (arr + l_linenumber % 5)::BIGINT AS dep FROM tt_calls0",
    "tt_slice": "SELECT s.* FROM tt_stop_times s JOIN orders ON o_orderkey = trip_id WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-07-01'",
    "tt_stations": "SELECT s_suppkey AS id, s_name AS name, 47 + (s_suppkey * 7919 % 10000) / 1000.0 AS lat, 5 + (s_suppkey * 104729 % 15000) / 1000.0 AS lon, n_name AS country, s_suppkey % 10 = 0 AS is_capital FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "tt_footpaths": "SELECT id AS a, id + 1 AS b, 15 + id % 30 AS minutes, ['walk','metro','tram','bus','rail','ferry','taxi'][id % 7 + 1] AS mode, id AS ord FROM tt_stations WHERE id % 7 = 0",
    "tt_calendar": "SELECT p_partkey // 2 AS service_id, ((p_size * 2 + p_partkey % 2) % 128)::INT AS days, DATE '2024-01-01' AS start_date, DATE '2024-01-30' AS end_date FROM part",
    "tt_calendar_dates": "SELECT user_id AS service_id, ts::DATE AS date, event_type = 'signup' AS is_add, ts, event_id AS row_order FROM events WHERE event_type IN ('signup', 'error')",
    "tt_raw_keys": "SELECT 0::BIGINT AS feed, s_suppkey AS k FROM supplier UNION ALL SELECT 1 + c_custkey % 3, c_custkey FROM customer",
    "tt_raw_stops": "SELECT feed, k AS stop_ord, 'st:' || (1000000 + k % 300) || CASE WHEN k % 4 = 0 THEN '9' ELSE '' END AS stop_id, ['München','Zürich','Łódź','Köln','Praha'][k % 5 + 1] || ' ' || (k % 40) || ['',' Hbf',' Hauptbahnhof'][k % 3 + 1] AS name, 47 + (k % 40) * 0.05 + (k % 7) * 0.001 AS lat, 8 + (k % 40) * 0.05 + (k % 5) * 0.001 AS lon FROM tt_raw_keys",
}


def oracle(body: str, **more: str) -> str:
    """body with the views it names put before it, and further ones of the caller."""
    views = VIEWS | more
    used: list[str] = []

    def need(text: str) -> None:
        for name in views:
            if name not in used and re.search(rf"\b{name}\b", text):
                need(views[name].replace(name, "") if name not in views[name] else views[name].replace(name, ""))
                if name not in used:
                    used.append(name)

    need(body)
    recursive = "RECURSIVE " if any(re.search(rf"\b{n}\b", views[n]) for n in used) else ""
    return (f"WITH {recursive}" + ", ".join(f"{n} AS ({views[n]})" for n in used) + " " if used else "") + body
