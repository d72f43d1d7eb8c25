"""Service calendars: windows, active and absent services, weeks, day bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(*frames: DataFrame) -> list[str]:
    """Service ids are a feed's own where the frames name it."""
    return ["feed", "service_id"] if all("feed" in f.columns for f in frames) else ["service_id"]


def window(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """first_day, last_day over calendar ranges and exception dates, of each feed where it is named; null without rows."""
    feed = _keys(calendar, exceptions)[:-1]
    days = calendar.select(*feed, F.explode(F.array("start_date", "end_date")).alias("d")).unionByName(exceptions.select(*feed, F.col("date").alias("d")))
    return days.groupBy(*feed).agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))


def active(calendar: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """date, service_id (of each feed where it is named) that run: any calendar row, overruled by the last exception of the date in file order."""
    key = ["date", *_keys(calendar, exceptions)]
    bit = F.expr("shiftright(days, weekday(date)) & 1") == 1
    base = calendar.join(F.broadcast(days), (F.col("date") >= F.col("start_date")) & (F.col("date") <= F.col("end_date"))).groupBy(*key).agg(F.max(bit).alias("base"))  # a row for each sampled day
    last = exceptions.join(F.broadcast(days), "date").groupBy(*key).agg(F.max(F.struct("ts", "row_order", "is_add")).alias("m")).select(*key, F.col("m.is_add").alias("exc"))
    return base.join(last, key, "full").filter(F.coalesce("exc", "base", F.lit(False))).select(*key)


def absent(calendar: DataFrame, exceptions: DataFrame, running: DataFrame) -> DataFrame:
    """Services that are named but run on none of the days."""
    key = _keys(calendar, exceptions, running)
    named = calendar.select(*key).unionByName(exceptions.select(*key)).distinct()
    return named.join(running.select(*key).distinct(), key, "left_anti")


def week(anchor: Column, first: Column, last: Column) -> Column:
    """Dates of the anchor's Monday week, moved into [first, last]; a shorter window gives all its days."""
    monday = F.date_sub(anchor, F.weekday(anchor))
    start = F.when(first.isNull(), monday).when(F.datediff(last, first) < 6, first).otherwise(F.least(F.greatest(monday, first), F.date_sub(last, 6)))
    end = F.when(F.datediff(last, first) < 6, last).otherwise(F.date_add(start, 6))
    return F.sequence(start, F.coalesce(end, F.date_add(monday, 6)))


def next_tuesday(day: Column) -> Column:
    """The Tuesday strictly after a day."""
    return F.next_day(day, "TU")


def runs(bits: Column, start: Column, day: Column) -> Column:
    """Whether a day's place in a bitmap of days that begins at start holds a 1."""
    at = F.datediff(day, start)
    return (at >= 0) & (at < F.length(bits)) & (F.substring(bits, at + 1, F.lit(1)) == "1")
