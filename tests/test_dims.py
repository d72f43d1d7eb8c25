"""Configuration tables, polygons and the booking catalogue."""

import json

import pytest

from quayside.operators import resolve
from quayside.sources import dims


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


def test_feeds_keep_order_and_are_validated(spark, tmp_path):
    base = 'url="u"\ncountry="DE"\nlicense="l"\nroute_allow=["^IC"]\n'
    conf = dims.toml(spark, put(tmp_path, "f.toml", f'[feeds.z]\n{base}[feeds.a]\n{base}format="netex"\n[feeds.a.stop_id_brand]\n"B-"="Blue"\n"A-"="Amber"\n'))
    rows = dims.feeds(spark, conf).orderBy("ord").collect()
    assert [(r.feed, r.format) for r in rows] == [("z", "gtfs"), ("a", "netex")]
    assert [tuple(b) for b in rows[1].stop_id_brand] == [("B-", "Blue"), ("A-", "Amber")] and rows[0].stop_id_brand is None
    for change, said in (({"format": "csv"}, "format"), ({"stop_id_allow": ["x"], "stop_id_brand": {"a": "b"}}, "two ways")):
        with pytest.raises(ValueError, match=said):
            dims.feeds(spark, {"feeds": {"z": conf["feeds"]["z"] | change}})
    with pytest.raises(ValueError, match="lacks url"):
        dims.feeds(spark, {"feeds": {"z": {k: v for k, v in conf["feeds"]["z"].items() if k != "url"}}})
    assert dims.feeds(spark, {}).count() == 0


STATIONS = "id string, name string, country string, lat double, lon double"


def test_cities_and_footpaths(spark):
    stations = spark.createDataFrame([("1", "North", "FR", 0.0, 0.0), ("2", "South", "FR", 0.0, 0.0), ("3", "Twin", "FR", 0.0, 0.0), ("4", "Twin", "BE", 0.0, 0.0), ("5", "Alone", "FR", 0.0, 0.0)], STATIONS)
    conf = {"cities": {"P": ["North", "South", "Gone", "Twin"], "Q": ["Alone"]}, "transfers": {"P": [["South", "North", "metro", 20], ["North", "Twin", "bus", 5], ["North", "Gone", "bus", 5], ["North", "South", "rocket", 5], ["North", "South", "bus", True], ["North", "Alone", "bus", 5], ["North"]]}}
    groups, issues = dims.cities(spark, conf, stations)
    assert {(r.city, r.id) for r in groups.collect()} == {("P", "1"), ("P", "2"), ("P", "3"), ("P", "4")}
    assert {tuple(r) for r in issues.collect()} == {("P", "Gone", "no station"), ("Q", None, "fewer than two stations")}
    paths, faults = dims.footpaths(spark, conf, stations)
    assert [tuple(r) for r in paths.collect()] == [("2", "1", 20, "metro", 0)]
    assert {(r.ord, r.issue) for r in faults.collect()} == {(1, "ambiguous station"), (2, "no station"), (3, "unknown mode"), (4, "no transfer"), (5, "not in one city"), (6, "no transfer")}


def test_capitals_need_name_and_country(spark):
    stations = spark.createDataFrame([("1", "Bern", "CH", 0.0, 0.0), ("2", "Paris", "US", 0.0, 0.0)], STATIONS)
    got = {tuple(r) for r in dims.capitals(spark, {"capitals": {"ch": "Bern", "FR": "Paris"}}, stations).collect()}
    assert got == {("CH", "Bern", "1"), ("FR", "Paris", None)}


def test_polygons_with_hole_and_several_parts(spark, tmp_path):
    box = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    feature = lambda kind, coords, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": coords}}
    path = put(tmp_path, "w.geojson", json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [box(0, 0, 10), box(4, 4, 2)], ISO_A2_EH="FR", ISO_A2="-99"), feature("MultiPolygon", [[box(20, 0, 5)], [box(30, 0, 5)]], ISO_A2_EH="", ISO_A2="NO"), feature("Polygon", [box(40, 0, 5)], ISO_A2_EH="-99", ISO_A2="XX")]}, indent=1))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 2.0, 22.0), (4, 2.0, 33.0), (5, 2.0, 42.0)], "id long, lat double, lon double")
    assert {tuple(r) for r in resolve.in_polygons(points, dims.polygon_edges(spark, path)).collect()} == {(1, "FR"), (3, "NO"), (4, "NO")}


def test_catalogue(spark, tmp_path):
    head = "id;name;latitude;longitude;is_suggestable\n"
    good = '1;"Köln; Hbf";50.9;6.9;t\n2;Hidden;x;y;f\n3;Nowhere;;;t\n'
    assert [tuple(r) for r in dims.catalogue(spark, put(tmp_path, "a.csv", head + good)).collect()] == [("1", "Köln; Hbf", 50.9, 6.9)]
    assert dims.catalogue(spark, put(tmp_path, "b.csv", head + good + "4;Bad;north;6.9;t\n")).count() == 0
    assert dims.catalogue(spark, put(tmp_path, "c.csv", "id;name\n1;a\n")).count() == 0
