"""Services that are absent from their published window: a verdict only once the window has passed.

A publication says that a service is expected from its time `ts` until `until`; a sighting says that it ran at `ts`. That
nobody has seen a service yet says nothing: only when event time, less the delay that late rows are allowed, has passed
`until`, is the window closed and the service `present` or `absent` in it.

Events: service, kind (publish or seen), ts, until (of publications). Repeated rows count once; publications without an
end or with one before their start, rows without a service or time, and other kinds are left out. As a stream, rows later
than the delay are left out too; for all others batch and stream give the same closed windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "service long, start timestamp, until timestamp, n_seen long, verdict string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _valid(events: DataFrame) -> DataFrame:
    # verdicts are by milliseconds, as watermarks and timers are
    at = lambda c: F.date_trunc("millisecond", F.col(c).cast("timestamp"))
    rows = events.select(F.col("service").cast("long").alias("service"), "kind", at("ts").alias("ts"), at("until").alias("until"))
    return rows.filter("service is not null and ts is not null and (kind = 'seen' or kind = 'publish' and until >= ts)")


def verdicts(events: DataFrame, late_seconds: int) -> DataFrame:
    """service, start, until, n_seen, verdict (present, absent, or open where the window hasn't passed yet).

    Sightings aren't joined with windows: both ends of a window stand among its service's sightings of a day, and a
    running count there, with the counts of the days before, tells how many lie between; so a service with a third of
    all rows is dealt out by days, and the work is linear."""
    rows = _valid(events)
    windows = rows.filter("kind = 'publish'").select("service", F.col("ts").alias("start"), "until").distinct()
    seen = rows.filter("kind = 'seen'").select("service", "ts").distinct()
    none = F.lit(None).cast("timestamp")
    points = seen.select("service", "ts", F.lit(1).alias("place"), F.lit(1).alias("n"), none.alias("start"), none.alias("until"))
    # a window's start stands before sightings of its moment, its end after them
    points = points.unionByName(windows.select("service", F.col("start").alias("ts"), F.lit(0).alias("place"), F.lit(0).alias("n"), "start", "until"))
    points = points.unionByName(windows.select("service", F.col("until").alias("ts"), F.lit(2).alias("place"), F.lit(0).alias("n"), "start", "until")).withColumn("day", F.to_date("ts"))
    before = points.groupBy("service", "day").agg(F.sum("n").alias("n"))
    before = before.select("service", "day", F.coalesce(F.sum("n").over(W.partitionBy("service").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n").over(W.partitionBy("service", "day").orderBy("ts", "place").rowsBetween(W.unboundedPreceding, 0))
    ends = points.withColumn("so_far", inside).filter("place <> 1").join(before, ["service", "day"])
    count = F.sum((F.col("so_far") + F.col("before")) * (F.col("place") - 1))
    counted = ends.groupBy("service", "start", "until").agg(count.alias("n_seen"))
    now = rows.agg(F.max("ts").alias("now"))
    passed = F.col("until") < F.col("now") - F.make_dt_interval(secs=F.lit(late_seconds))
    verdict = F.when(~passed, "open").when(F.col("n_seen") > 0, "present").otherwise("absent")
    return counted.join(F.broadcast(now), F.lit(True)).select("service", "start", "until", "n_seen", verdict.alias("verdict"))  # one row


class Horizon(StatefulProcessor):
    """Open windows and the sightings that an open or a late one may still hold, of one service; a timer closes each window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long, until long", "known boolean")
        self.seen = handle.getMapState("seen", "ts long", "known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for kind, ts, until in zip(part["kind"], _ms(part["ts"]), _ms(part["until"]), strict=True):
                if ts < passed:
                    continue
                if kind == "seen":
                    self.seen.updateValue((ts,), (True,))
                elif not self.windows.containsKey((ts, until)):
                    self.windows.updateValue((ts, until), (True,))
                    self.handle.registerTimer(until + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, passed = expiredTimerInfo.getExpiryTimeInMs() - 1, timerValues.getCurrentWatermarkInMs()
        held = [(k[0], k[1]) for k in self.windows.keys()]
        closed = [w for w in held if w[1] <= due]
        if not closed:
            return
        seen = sorted(k[0] for k in self.seen.keys())
        stamps = pd.Series(seen, dtype="int64")
        n = [int(stamps.searchsorted(b, "right") - stamps.searchsorted(a, "left")) for a, b in closed]
        for w in closed:
            self.windows.removeKey(w)
        still = min([passed, *(w[0] for w in held if w[1] > due)])
        for ts in seen:
            if ts < still:
                self.seen.removeKey((ts,))
        at = lambda k: pd.to_datetime([w[k] for w in closed], unit="ms")
        yield pd.DataFrame({"service": key[0], "start": at(0), "until": at(1), "n_seen": n, "verdict": ["present" if c else "absent" for c in n]})

    def close(self) -> None:
        pass


def _ms(stamps: pd.Series) -> list[int | None]:
    return [None if pd.isna(t) else t.value // 1_000_000 for t in stamps]


def stream(events: DataFrame, late: str) -> DataFrame:
    """Closed windows of a stream of events, each once, as it closes. The session's state store has to be RocksDB (`ROCKS`),
    its time zone UTC, since tasks get local times."""
    rows = _valid(events).withWatermark("ts", late)
    return rows.groupBy("service").transformWithStateInPandas(Horizon(), RESULT, "Append", "EventTime")
