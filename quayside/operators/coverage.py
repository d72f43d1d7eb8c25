"""Areas of a map by tier, as sets of oriented edges: unions, differences and cuts by a box, without a geometry library.

A region is a bag of directed edges with the region on their left; edges that are there both ways cancel. So the union
of countries that don't overlap is the sum of their edges, border for border; cutting a region by a line cuts its edges
row by row and closes both sides along the line, between each odd crossing and the next. What is left is stitched to
rings by pointer doubling, in rounds of the logarithm of the longest ring. Borders that two countries share must have
the same points on both sides, as in maps that are simplified as a whole; on cutting lines they needn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.operators.resolve import crossed_rings
from quayside.sources.scratch import written

#: The box that covered and reachable countries are shown in (west, south, east, north).
EUROPE = (-25.0, 27.0, 45.0, 72.0)
NO_CODE = "-99"


def oriented(edges: DataFrame) -> DataFrame:
    """edges (iso, ord, ring, x1, y1, x2, y2), turned where needed so that their polygon is on the left: exteriors (ring 0) against the clock, holes with it."""
    area = edges.groupBy("iso", "ord", "ring").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("a2"))
    turn = (F.col("a.a2") < 0) == (F.col("a.ring") == 0)
    both = edges.alias("e").join(area.alias("a"), F.col("e.iso").eqNullSafe(F.col("a.iso")) & (F.col("e.ord") == F.col("a.ord")) & (F.col("e.ring") == F.col("a.ring")))
    pick = lambda own, other: F.when(turn, F.col(f"e.{other}")).otherwise(F.col(f"e.{own}")).alias(own)
    return both.select("e.iso", "e.ord", pick("x1", "x2"), pick("y1", "y2"), pick("x2", "x1"), pick("y2", "y1"))


def cut(edges: DataFrame, axis: str, value: float, keys: list[str]) -> DataFrame:
    """edges (keys, x1, y1, x2, y2) in two parts, closed along the line axis = value; upper: whether an edge bounds the part beyond it.

    Points on the line count as below it, so that each region crosses it an even number of times."""
    along = "y" if axis == "x" else "x"
    p, q, s, t = F.col(f"{axis}1"), F.col(f"{axis}2"), F.col(f"{along}1"), F.col(f"{along}2")
    above = lambda c: c > value
    at = s + (t - s) * ((F.lit(value) - p) / (q - p))
    rows = written(edges.withColumn("at", F.when(above(p) != above(q), at)), "cut")
    point = lambda a, b: (a, b) if axis == "x" else (b, a)

    def edge(start, end, upper):
        (xa, ya), (xb, yb) = point(*start), point(*end)
        return F.struct(xa.alias("x1"), ya.alias("y1"), xb.alias("x2"), yb.alias("y2"), upper.alias("upper"))

    line = F.lit(value)
    parts = F.when(F.col("at").isNull(), F.array(edge((p, s), (q, t), above(p)))).otherwise(F.array(edge((p, s), (line, F.col("at")), above(p)), edge((line, F.col("at")), (q, t), above(q))))
    halves = rows.select(*keys, F.explode(parts).alias("e")).select(*keys, "e.*")
    # inside the region from each odd crossing to the next
    order = W.partitionBy(*keys).orderBy("at")  # crossings of one polygon with one line
    crossings = rows.filter("at is not null").select(*keys, "at").withColumns({"n": F.row_number().over(order), "to": F.lead("at").over(order)}).filter("n % 2 = 1")
    # the part below has the region on the left going up along x = value, and going down along y = value
    low, high = (F.col("at"), F.col("to")) if axis == "x" else (F.col("to"), F.col("at"))
    closing = crossings.select(*keys, F.explode(F.array(edge((line, low), (line, high), F.lit(False)), edge((line, high), (line, low), F.lit(True)))).alias("e")).select(*keys, "e.*")
    return halves.unionByName(closing).filter("x1 <> x2 or y1 <> y2")


def in_box(edges: DataFrame, box: tuple[float, float, float, float], keys: list[str]) -> DataFrame:
    """edges of polygons (keys) in their parts inside and outside a box (column inside)."""
    west, south, east, north = box
    inside, outside = edges, None
    for axis, value, upper in (("x", west, True), ("y", south, True), ("x", east, False), ("y", north, False)):
        parts = cut(inside, axis, value, keys)
        inside = parts.filter(F.col("upper") == upper).drop("upper")
        gone = parts.filter(F.col("upper") != upper).drop("upper")
        outside = gone if outside is None else outside.unionByName(gone)
    return inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))


def dissolved(edges: DataFrame, key: str, lines: tuple[tuple[str, float], ...] = ()) -> DataFrame:
    """Edges of the union of each key's regions: those that are there in both directions cancel; along the given lines, where points needn't match, by stretches."""
    on = F.lit(None).cast("string")
    for axis, value in lines:
        on = F.when((F.col(f"{axis}1") == value) & (F.col(f"{axis}2") == value), F.lit(f"{axis}={value}")).otherwise(on)
    rows = written(edges.select(key, "x1", "y1", "x2", "y2", on.alias("line")), "dissolve")
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    sign = F.when(forward, 1).otherwise(-1)
    net = rows.filter("line is null").select(key, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), sign.alias("n")).groupBy(key, "a", "b").agg(F.sum("n").alias("n")).filter("n <> 0")
    # along a line: how many edges go each way between neighbouring points of it
    ends = rows.filter("line is not null").select(key, "line", F.explode(F.array(F.struct(F.least(a, b).alias("p"), sign.alias("n")), F.struct(F.greatest(a, b).alias("p"), (-sign).alias("n")))).alias("e"))
    steps = ends.groupBy(key, "line", "e.p").agg(F.sum("e.n").alias("n"))
    order = W.partitionBy(key, "line").orderBy("p")  # points on a line of the box
    steps = steps.select(key, F.col("p").alias("a"), F.lead("p").over(order).alias("b"), F.sum("n").over(order).alias("n")).filter("n <> 0")
    start, end = F.when(F.col("n") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("n") > 0, F.col("b")).otherwise(F.col("a"))
    return net.unionByName(steps).select(key, start.alias("s"), end.alias("e")).select(key, F.col("s.x").alias("x1"), F.col("s.y").alias("y1"), F.col("e.x").alias("x2"), F.col("e.y").alias("y2"))


def stitched(edges: DataFrame, key: str) -> DataFrame:
    """key, ring, pos, x, y, area: closed rings of edges, their first points, and the ring's signed area (holes are negative).

    Where rings touch in a point, an edge goes on to the next one clockwise from where it came, so that rings don't cross themselves."""
    rows = written(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    a, b = rows.alias("a"), rows.alias("b")
    angle = lambda x, y: F.atan2(y, x)
    back = angle(F.col("a.x1") - F.col("a.x2"), F.col("a.y1") - F.col("a.y2"))
    ahead = angle(F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1"))
    clockwise = F.pmod(back - ahead, F.lit(2 * 3.141592653589793))
    turn = F.when(clockwise == 0, 7.0).otherwise(clockwise)
    after = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.x2") == F.col("b.x1")) & (F.col("a.y2") == F.col("b.y1")))
    links = written(after.groupBy(F.col("a.id").alias("id")).agg(F.min_by("b.id", F.struct(turn, "b.id")).alias("next")), "links")
    # the least edge of each ring names it: each round looks twice as far ahead
    seen = links.select("id", "next", F.least("id", "next").alias("ring"))
    while True:
        other = seen.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("ring").alias("found"))
        step = written(seen.join(other, "next").select("id", F.col("further").alias("next"), F.least("ring", "found").alias("ring"), (F.col("found") < F.col("ring")).alias("moved")), "rings")
        seen = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    # rank: edges from each to the end of its ring, which is cut ahead of the edge that names it
    rank = links.join(seen.select("id", "ring"), "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("n"))
    rank = written(rank.withColumn("n", F.when(F.col("next").isNull(), 0).otherwise(F.col("n"))), "rank")
    while not rank.filter("next is not null").isEmpty():
        other = rank.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("n").alias("more"))
        rank = written(rank.join(other, "next", "left").select("id", "ring", F.col("further").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "rank")
    placed = rank.select("id", "ring", "n").join(rows, "id")
    facts = placed.groupBy("ring").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"), F.max("n").alias("most"))
    return placed.join(facts, "ring").select(key, "ring", (F.col("most") - F.col("n")).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x2").alias("to_x"), F.col("y2").alias("to_y"), "area")


def tiers(edges: DataFrame, covered: DataFrame, reachable: DataFrame, box: tuple[float, float, float, float] = EUROPE) -> DataFrame:
    """tier, ring, pos, x, y, to_x, to_y, area: what a map veils. light: countries that are reachable and not covered, inside the box.
    dark: all land but light and the covered countries inside the box; what these have outside is dark.

    edges: iso, ord, ring, x1, y1, x2, y2 of all countries; covered, reachable: iso. Countries without a code are dark."""
    coded = lambda df, kind: df.filter(F.col("iso").isNotNull() & ~F.col("iso").isin("", NO_CODE)).select("iso", F.lit(kind).alias("kind"))
    kinds = coded(covered, "covered").unionByName(coded(reachable, "light")).groupBy("iso").agg(F.min("kind").alias("kind"))
    land = written(oriented(edges).join(F.broadcast(kinds), "iso", "left").select("iso", "ord", "kind", "x1", "y1", "x2", "y2"), "land")  # a row for each country
    split = in_box(land.filter("kind is not null"), box, ["iso", "ord", "kind"])
    shown = split.select(F.when(~F.col("inside"), "dark").when(F.col("kind") == "light", "light").alias("tier"), "x1", "y1", "x2", "y2").filter("tier is not null")
    every = shown.unionByName(land.filter("kind is null").select(F.lit("dark").alias("tier"), "x1", "y1", "x2", "y2"))
    west, south, east, north = box
    return stitched(dissolved(every, "tier", (("x", west), ("y", south), ("x", east), ("y", north))), "tier")


def areas(rings: DataFrame) -> DataFrame:
    """tier, area and numbers of outer rings and holes."""
    one = rings.filter("pos = 0")
    return one.groupBy("tier").agg(F.sum("area").alias("area"), F.count_if(F.col("area") > 0).alias("outer_rings"), F.count_if(F.col("area") < 0).alias("holes"))


def features(rings: DataFrame) -> DataFrame:
    """tier and geometry: one GeoJSON MultiPolygon a tier, light first; holes follow the least outer ring that holds them."""
    rings = written(rings, "rings")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    holes = rings.filter("area < 0 and pos = 0").select(F.col("ring").alias("id"), middle("x", "to_x").alias("lon"), middle("y", "to_y").alias("lat"), "tier")
    outer = rings.filter("area > 0").select("tier", "ring", "area", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("to_x").alias("x2"), F.col("to_y").alias("y2"))
    held = crossed_rings(holes, outer, ["tier", "ring", "area"], ["tier"]).groupBy("id").agg(F.min_by("ring", "area").alias("outer"))
    owner = rings.select("tier", "ring").distinct().join(held.withColumnRenamed("id", "ring"), "ring", "left").select("tier", "ring", F.coalesce("outer", "ring").alias("outer"))
    number: Column = F.concat(F.lit("["), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]"))
    point = F.struct("pos", number.alias("p"))
    lines = rings.groupBy("ring").agg(F.array_sort(F.collect_list(point)).alias("l")).select("ring", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["p"]), ","), F.lit(","), F.col("l")[0]["p"], F.lit("]")).alias("line"))  # a ring of the map
    joined = lambda c, name: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x[name]), ","), F.lit("]"))
    polygons = owner.join(lines, "ring").groupBy("tier", "outer").agg(joined(F.struct((F.col("ring") != F.col("outer")).alias("hole"), "ring", "line"), "line").alias("polygon"))
    shapes = polygons.groupBy("tier").agg(joined(F.struct("outer", "polygon"), "polygon").alias("c"))
    return shapes.select("tier", F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), "c", F.lit("}")).alias("geometry")).orderBy(F.desc("tier"))
