"""Feed archives: members of zip files as tables, all strings, in file order.

Spark lists the archives; a task opens one where it lies, reads its directory from the end and then only the
bytes of the member asked for, which it inflates as a stream: archives may be of any size (also beyond 4 GB), and
one batch of rows is held. Archives and members are read side by side; a member is one deflated stream, so one
task's work. Write what is used more than once.

Cases: a member in a subfolder counts, the first of its name; a missing or empty member gives no rows; a
missing column or a cell that a short row lacks is null; byte order marks and padding of names and cells
are cut; of columns with one name the last counts; columns that aren't asked for are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.text import minutes_of

#: Columns of the members that the engine uses.
MEMBERS = {
    "agency": ("agency_id", "agency_name", "agency_timezone"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station"),
    "routes": ("route_id", "route_short_name", "route_long_name"),
    "trips": ("route_id", "service_id", "trip_id", "trip_short_name", "trip_headsign"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
}
#: Columns without which a row means nothing: a member that lacks one is an error.
REQUIRED = {
    "stops": ("stop_id",), "routes": ("route_id",), "trips": ("route_id", "service_id", "trip_id"), "stop_times": ("trip_id", "stop_id", "stop_sequence"),
    "calendar": MEMBERS["calendar"], "calendar_dates": MEMBERS["calendar_dates"],
}
BATCH_ROWS = 20_000


def opened(path: str) -> BinaryIO:
    """A file that can be sought in, wherever Arrow's file systems reach it (local, s3, gs, abfs, hdfs)."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file:").removeprefix("//"), "rb")
    there, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return there.open_input_file(name)


def member(spark: SparkSession, paths: str | list[str], name: str, columns: tuple[str, ...] | None = None, opener: Callable[[str], BinaryIO] = opened) -> DataFrame:
    """feed (the archive's name without ending), row_order (from 0) and the columns of one member of all archives.

    opener gives a task a file of a path; another than `opened` is for storage that Arrow doesn't know."""
    columns = columns or MEMBERS[name]
    schema = T.StructType([T.StructField("feed", T.StringType()), T.StructField("row_order", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])
    archives = spark.read.format("binaryFile").load(paths).select("path")  # contents aren't read
    return archives.mapInArrow(_reader(f"{name}.txt", columns, REQUIRED.get(name, ()), opener), schema)


def _reader(file: str, columns: tuple[str, ...], required: tuple[str, ...], opener: Callable[[str], BinaryIO]):
    def read(batches):
        import csv
        import io
        import itertools
        import zipfile

        import pyarrow as pa

        csv.field_size_limit(1 << 30)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                feed = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                with opener(path) as packed, zipfile.ZipFile(packed) as archive:
                    inside = next((n for n in archive.namelist() if n.rsplit("/", 1)[-1] == file), None)
                    if inside is None:
                        continue
                    with io.TextIOWrapper(archive.open(inside), encoding="utf-8-sig", newline="") as lines:
                        rows = csv.reader(lines)
                        at = {h.strip(): k for k, h in enumerate(next(rows, []))}
                        if lacking := [c for c in required if at and c not in at]:
                            raise ValueError(f"{feed}: {file} lacks {', '.join(lacking)}")
                        filled, done = filter(None, rows), 0  # blank lines are no rows
                        while part := list(itertools.islice(filled, BATCH_ROWS)):
                            cells = [[r[k].strip() if k is not None and k < len(r) else None for r in part] for k in map(at.get, columns)]
                            order = range(done, done + len(part))
                            arrays = [pa.array([feed] * len(part), pa.string()), pa.array(order, pa.int64()), *(pa.array(c, pa.string()) for c in cells)]
                            yield pa.RecordBatch.from_arrays(arrays, names=["feed", "row_order", *columns])
                            done += len(part)

    return read


def _day(c: str) -> Column:
    return F.to_date(c, "yyyyMMdd")


def calendar(rows: DataFrame) -> DataFrame:
    """feed, service_id, days (a bit for each weekday, Monday lowest), start_date, end_date of a calendar member."""
    days = sum(((F.col(c) == "1").cast("int") * (1 << k) for k, c in enumerate(MEMBERS["calendar"][1:8])), F.lit(0))
    return rows.select("feed", "service_id", days.alias("days"), _day("start_date").alias("start_date"), _day("end_date").alias("end_date"))


def calendar_dates(rows: DataFrame) -> DataFrame:
    """feed, service_id, date, is_add, ts, row_order of a calendar_dates member; file order decides, so ts is one value."""
    return rows.select("feed", "service_id", _day("date").alias("date"), (F.col("exception_type") == "1").alias("is_add"), F.lit(0).cast("timestamp").alias("ts"), "row_order")


def calls(rows: DataFrame, shift: int | Column = 0) -> DataFrame:
    """feed, trip_id, stop_sequence, stop_id, arr, dep (minutes, shifted) of a stop_times member; one time stands for the other, rows with neither go."""
    a, d = F.nullif("arrival_time", F.lit("")), F.nullif("departure_time", F.lit(""))
    shift = F.lit(shift) if isinstance(shift, int) else shift
    return rows.filter(a.isNotNull() | d.isNotNull()).select("feed", "trip_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), "stop_id", (minutes_of(F.coalesce(a, d)) + shift).alias("arr"), (minutes_of(F.coalesce(d, a)) + shift).alias("dep"))
