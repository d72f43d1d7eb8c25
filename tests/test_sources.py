"""Feed archives and XML publications, written here and read back."""

import datetime
import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from quayside.operators import calendar
from quayside.sources import gtfs, netex, timetable


@pytest.fixture
def archive(tmp_path):
    def make(name, **members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in members.items():
                z.writestr(member.replace("__", "/") + ".txt", text.encode())
        return f"file://{tmp_path}/{name}"

    return make


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("feed", "row_order").select(*names).collect()]


def test_mark_padding_folder_and_short_rows(spark, archive):
    path = archive("a.zip", feed__stops="﻿stop_id ,stop_name,stop_lat,extra   \r\ns1 ,\"Köln, Hbf\", 50.9,x\r\n\r\ns2  \r\n")
    got = rows(gtfs.member(spark, path, "stops"), "feed", "row_order", "stop_id", "stop_name", "stop_lat", "parent_station")
    assert got == [("a", 0, "s1", "Köln, Hbf", "50.9", None), ("a", 1, "s2", None, None, None)]


def test_several_archives_missing_members_and_empty_ones(spark, archive, tmp_path):
    archive("a.zip", routes="route_id,route_short_name\nr1,IC\n", trips="")
    archive("b.zip", routes="route_id\nr2\n")
    every = f"file://{tmp_path}/*.zip"
    assert rows(gtfs.member(spark, every, "routes"), "feed", "route_id", "route_short_name") == [("a", "r1", "IC"), ("b", "r2", None)]
    assert rows(gtfs.member(spark, every, "trips"), "trip_id") == []
    assert rows(gtfs.member(spark, every, "calendar"), "service_id") == []


def test_lacking_column_is_an_error(spark, archive):
    path = archive("a.zip", trips="route_id,trip_id\nr,t\n")
    with pytest.raises(Exception, match="trips.txt lacks service_id"):
        gtfs.member(spark, path, "trips").collect()


def test_batches_keep_file_order(spark, archive):
    n = 2 * gtfs.BATCH_ROWS + 7
    path = archive("a.zip", stop_times="trip_id,stop_id,stop_sequence\n" + "".join(f"t{k},s,{k}\n" for k in range(n)))
    df = gtfs.member(spark, path, "stop_times")
    assert df.count() == n
    assert df.filter(F.col("row_order").cast("string") != F.col("stop_sequence")).count() == 0


def test_archives_beyond_four_gigabytes_and_odd_names(spark, tmp_path):
    hole = 5 << 30
    for name in ("a b#1%20.zip", "c.zip"):
        with open(tmp_path / name, "wb") as f:
            f.seek(hole if name == "c.zip" else 0)  # nothing is stored before it
            with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("routes.txt", "route_id\nr1\n")
                z.writestr("stops.txt", "stop_id\ns1\ns2\n")
    assert (tmp_path / "c.zip").stat().st_size > hole
    df = gtfs.member(spark, f"file://{tmp_path}/*.zip", "stops")
    assert rows(df, "feed", "stop_id") == [("a b#1%20", "s1"), ("a b#1%20", "s2"), ("c", "s1"), ("c", "s2")]


def test_only_the_member_asked_for_is_read(spark, archive, tmp_path):
    path = archive("a.zip", routes="route_id\nr1\n", stop_times="trip_id,stop_id,stop_sequence\n" + "".join(f"t{k * 7919 % 10007},s{k * k % 10009},{k}\n" for k in range(20_000)))

    def counted(name):
        import io

        class Counted(io.FileIO):
            total = 0

            def read(self, n=-1):
                data = super().read(n)
                Counted.total += len(data)
                if Counted.total > 2_000:
                    raise OSError("more than the directory and a small member was read")
                return data

        return Counted(name.removeprefix("file:").removeprefix("//"))

    assert (tmp_path / "a.zip").stat().st_size > 50_000
    assert rows(gtfs.member(spark, path, "routes", opener=counted), "route_id") == [("r1",)]
    with pytest.raises(Exception, match="more than the directory"):
        gtfs.member(spark, path, "stop_times", opener=counted).count()


def test_times_past_midnight_and_untimed_calls(spark, archive):
    path = archive("a.zip", stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,,25:10:59,a,1\nt,,,b,2\nt,26:00:00,,c,10\n")
    got = {tuple(r) for r in gtfs.calls(gtfs.member(spark, path, "stop_times"), shift=60).collect()}
    assert got == {("a", "t", 1, "a", 1570, 1570), ("a", "t", 10, "c", 1620, 1620)}


def test_calendar_members_feed_the_calendar_operators(spark, archive):
    head = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
    path = archive("a.zip", calendar=head + "s,1,1,0,0,0,0,0,20260701,20260731\nq,0,1,0,0,0,0,0,20260701,20260731\n", calendar_dates="service_id,date,exception_type\ns,20260714,2\nx,20260714,1\nq,20260714,2\nq,20260714,1\n")
    c, e = gtfs.calendar(gtfs.member(spark, path, "calendar")), gtfs.calendar_dates(gtfs.member(spark, path, "calendar_dates"))
    days = spark.createDataFrame([(datetime.date(2026, 7, 14),)], "date date")
    assert {r.service_id for r in calendar.active(c, e, days).collect()} == {"q", "x"}
    assert tuple(calendar.window(c, e).first()) == ("a", datetime.date(2026, 7, 1), datetime.date(2026, 7, 31))


def publication(*parts):
    return f'<?xml version="1.0"?><PublicationDelivery xmlns="http://www.netex.org.uk/netex"><dataObjects>{"".join(parts)}</dataObjects></PublicationDelivery>'


def tag(name, *inner, key=None, ref=None):
    marks = (f' id="{key}"' if key else "") + (f' ref="{ref}"' if ref else "")
    return f"<{name}{marks}>{''.join(inner)}</{name}>"


def position(lat, lon):
    return tag("Location", tag("Longitude", str(lon)), tag("Latitude", str(lat)))


def pattern(key, line, points):
    stops = (tag("StopPointInJourneyPattern", tag("ScheduledStopPointRef", ref=p), key=f"{key}/{k}") for k, p in enumerate(points))
    return tag("ServiceJourneyPattern", tag("LineRef", ref=line), tag("pointsInSequence", *stops), key=key)


def period(key, first, last, bits):
    return tag("UicOperatingPeriod", tag("FromDate", first), tag("ToDate", last), tag("ValidDayBits", bits), key=key)


def assigned(day, period_key):
    return tag("DayTypeAssignment", tag("OperatingPeriodRef", ref=period_key), tag("DayTypeRef", ref=day))


def run(key, name, way, days, times):
    passing = (tag("TimetabledPassingTime", tag("StopPointInJourneyPatternRef", ref=at), *(tag(k, v) for k, v in cells.items())) for at, cells in times)
    return tag("ServiceJourney", tag("Name", name), tag("dayTypes", *(tag("DayTypeRef", ref=d) for d in days)), tag("ServiceJourneyPatternRef", ref=way), tag("passingTimes", *passing), key=key)


STOPS = (
    tag("StopPlace", tag("Name", "Lindau Insel"), tag("Centroid", position(47.54, 9.68)), key="place:lindau"),
    tag("ScheduledStopPoint", tag("Name", "Bregenz"), position(47.5, 9.74), key="point:bregenz"),
    tag("ScheduledStopPoint", tag("Name", "Lindau, track 4"), tag("StopPlaceRef", ref="place:lindau"), key="point:lindau4"),
    tag("ScheduledStopPoint", tag("Name", "Hergatz"), key="point:hergatz"),
)
LINES = (tag("Line", tag("ShortName", "RE"), tag("Name", "Lake express"), key="line:re"), tag("Line", tag("ShortName", ""), tag("Name", "Night coach"), key="line:coach"), tag("Line", tag("ShortName", "IC"), tag("Name", "Intercity"), key="line:ic"))
WAYS = (pattern("lake", "line:re", ["point:bregenz", "point:lindau4", "point:hergatz", "point:unknown"]), pattern("road", "line:coach", ["point:bregenz", "point:hergatz"]), pattern("far", "line:ic", ["point:hergatz", "point:bregenz"]))
NIGHT = [("lake/0", {"DepartureTime": "22:40:59"}), ("lake/1", {}), ("lake/1", {"ArrivalTime": "23:10:00", "DepartureTime": "23:15:00"}), ("lake/3", {"ArrivalTime": "23:59:00"}), ("lake/2", {"ArrivalTime": "00:20:00", "ArrivalDayOffset": "1"})]


@pytest.mark.parametrize("packed", [True, False])
def test_publication(spark, tmp_path, packed):
    days = (period("autumn", "2026-10-05T00:00:00", "2026-10-11T00:00:00", "1000101"), period("none", "2026-10-01", "2026-10-04", "0000"), assigned("weekend", "none"), assigned("weekend", "autumn"), assigned("never", "none"))
    runs = (
        run("night", "3087", "lake", ["weekend"], NIGHT),
        run("idle", "", "lake", ["never"], NIGHT),
        run("coach", "1", "road", ["weekend"], [("road/0", {"DepartureTime": "08:00:00"}), ("road/1", {"ArrivalTime": "09:00:00"})]),
        run("short", "2", "lake", ["weekend"], NIGHT[:2]),
        run("twice", "71", "far", ["never", "weekend"], [("far/0", {"DepartureTime": "06:05:00"}), ("far/1", {"ArrivalTime": "06:50:00"})]),
    )
    text = publication(*STOPS, *LINES, *WAYS, *days, *runs).encode()
    path = tmp_path / ("lake.xml.gz" if packed else "lake.xml")
    path.write_bytes(gzip.compress(text) if packed else text)
    path = f"file://{path}"
    found = netex.journeys(spark, path, ["^RE$", "^Inter"])
    # two timed calls at known stops, on an allowed line
    assert {tuple(r) for r in found.select("trip_id", "train").collect()} == {("night", "RE 3087"), ("idle", "RE"), ("twice", "IC 71")}
    # the time that stands for a missing one is moved by the missing one's offset
    assert [tuple(c) for c in found.filter("trip_id = 'night'").first().calls] == [(1, "point:bregenz", 1360, 1360), (2, "place:lindau", 1390, 1395), (3, "point:hergatz", 1460, 20)]
    periods = netex.elements(spark, path, "UicOperatingPeriod")
    assert tuple(netex.window(periods).first()) == (datetime.date(2026, 10, 1), datetime.date(2026, 10, 11))
    bits = netex.day_bits(periods, netex.elements(spark, path, "DayTypeAssignment"))
    for day, want in ((4, set()), (5, {"night", "twice"}), (6, set()), (9, {"night", "twice"}), (11, {"night", "twice"}), (12, set())):
        assert {r.trip_id for r in netex.on_day(found, bits, F.lit(datetime.date(2026, 10, day))).collect()} == want
    stops = netex.stops(netex.elements(spark, path, "StopPlace"), netex.elements(spark, path, "ScheduledStopPoint"))
    assert {tuple(r) for r in stops.drop("feed").collect()} == {("place:lindau", "Lindau Insel", 47.54, 9.68), ("point:bregenz", "Bregenz", 47.5, 9.74), ("point:hergatz", "Hergatz", None, None)}


def test_lines_of_a_task_stay_few(spark, monkeypatch):
    """Calls of a large table lie in parts of so many lines, which Spark doesn't put together; the calls stay the same."""
    at = "/root/testdata/sf0.001"
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rows(timetable.stop_times(spark, at))
    monkeypatch.setattr(timetable, "LINES", 500, raising=False)
    calls = timetable.stop_times(spark, at)
    each = [r["count"] for r in calls.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(whole) > 5_000 and sum(each) == len(whole) and max(each) <= 1_000
    assert rows(calls) == whole
    monkeypatch.setattr(timetable, "LINES", len(whole))
    assert calls.rdd.getNumPartitions() > timetable.stop_times(spark, at).rdd.getNumPartitions()
