"""Zones: polygons of rings in columns, selection by name, containment, dissolve, distance of points.

A zone's geometry is ``array<array<struct<x, y>>>``: rings of corners, not
closed, by the even-odd rule, so holes and several parts need nothing more.
Zones are a table of administrative areas, in the hundreds for a city; their
number is checked where they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.functions.geo import EARTH_M
from lastleg.operators.lineage import cut, units

RINGS = "array<array<struct<x: double, y: double>>>"
#: Zones up to which a table of them is broadcast to the points.
BROADCAST_ZONES = 20_000


def _edges(ring: Column) -> Column:
    """struct(x1, y1, x2, y2) of each side of a ring."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, _edges))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over all sides."""
    return _inside(edges(rings), x, y)


def _inside(sides: Column, x: Column, y: Column) -> Column:
    def hit(e: Column) -> Column:
        crosses = (e["y1"] > y) != (e["y2"] > y)
        return F.when(crosses & (x < (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]) * (y - e["y1"]) + e["x1"]), 1).otherwise(0)

    return F.aggregate(sides, F.lit(0), lambda n, e: n + hit(e)) % 2 == 1


def area2(rings: Column) -> Column:
    """Twice the signed area; rings of holes run the other way round."""
    return F.aggregate(edges(rings), F.lit(0.0), lambda t, e: t + e["x1"] * e["y2"] - e["x2"] * e["y1"])


def centroid(rings: Column) -> tuple[Column, Column]:
    """The middle of the area, by the shoelace formula about the first corner, so that no digits are lost."""
    x0, y0 = rings[0][0]["x"], rings[0][0]["y"]

    def moved(e: Column) -> tuple[Column, ...]:
        return e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0

    def step(t: Column, e: Column) -> Column:
        x1, y1, x2, y2 = moved(e)
        w = x1 * y2 - x2 * y1
        return F.struct((t["a"] + w).alias("a"), (t["x"] + (x1 + x2) * w).alias("x"), (t["y"] + (y1 + y2) * w).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(edges(rings), zero, step)
    return x0 + total["x"] / (3 * total["a"]), y0 + total["y"] / (3 * total["a"])


def box(rings: Column) -> Column:
    """struct(x1, y1, x2, y2) of the rings' extent."""
    corners = F.flatten(rings)
    xs, ys = F.transform(corners, lambda c: c["x"]), F.transform(corners, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def metres_to(rings: Column, x: Column, y: Column) -> Column:
    """Metres from a point to the polygon, 0 inside: to the nearest side on the plane that touches the globe at the point."""
    east = F.cos(F.radians(y)) * EARTH_M * F.radians(F.lit(1.0))
    north = F.lit(EARTH_M) * F.radians(F.lit(1.0))

    def side(e: Column) -> Column:
        ax, ay, bx, by = (e["x1"] - x) * east, (e["y1"] - y) * north, (e["x2"] - x) * east, (e["y2"] - y) * north
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
        return F.sqrt(F.pow(ax + t * dx, F.lit(2)) + F.pow(ay + t * dy, F.lit(2)))

    return F.when(contains(rings, x, y), 0.0).otherwise(F.array_min(F.transform(edges(rings), side)))


def few_zones(zones: DataFrame) -> DataFrame:
    """``zones`` to broadcast; more than BROADCAST_ZONES are refused."""
    n = zones.limit(BROADCAST_ZONES + 1).count()
    if n > BROADCAST_ZONES:
        raise ValueError(f"more than {BROADCAST_ZONES} zones: join them by cells of a grid")
    return F.broadcast(zones)


def zones_of_points(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Each point (lon, lat) with every zone that contains it; boxes first, then rays, once for each place and by many tasks."""
    others = [c for c in zones.columns if c != "rings"]
    z = few_zones(zones.select(*others, box(F.col("rings")).alias("__box"), edges(F.col("rings")).alias("__sides")))
    places = points.select("lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).distinct().repartition(units(points.sparkSession), "lon", "lat")
    near = places.join(z, F.col("lon").between(F.col("__box.x1"), F.col("__box.x2")) & F.col("lat").between(F.col("__box.y1"), F.col("__box.y2")))
    held = cut(near.where(_inside(F.col("__sides"), F.col("lon"), F.col("lat"))).select("lon", "lat", *others))
    return points.join(held, ["lon", "lat"]).select(*points.columns, *others)


def select_zones(zones: DataFrame, wanted: list[str]) -> DataFrame:
    """The zones that ``wanted`` names as ``name`` or ``name:type``, in any case; unknown and ambiguous names are errors.

    Adds ``request``, the position of the request.
    """
    parts = [tuple(p.strip().lower() for p in w.partition(":")[::2]) for w in wanted]
    asked = zones.sparkSession.createDataFrame([(k, n, t or None) for k, (n, t) in enumerate(parts)], "request int, __name string, __type string")
    found = zones.join(F.broadcast(asked), (F.lower("zone") == F.col("__name")) & (F.col("__type").isNull() | (F.lower("kind") == F.col("__type"))))
    counts = dict(found.groupBy("request").count().collect())  # one row a request
    if missing := [w for k, w in enumerate(wanted) if k not in counts]:
        raise ValueError(f"no zone is called {', '.join(missing)}")
    if several := [w for k, w in enumerate(wanted) if counts[k] > 1]:
        raise ValueError(f"several zones are called {', '.join(several)}; give name:type")
    return found.drop("__name", "__type")


def overlaps(zones: DataFrame) -> DataFrame:
    """(outer, inner): pairs of zones where one contains the other's centroid; boxes meet first."""
    x, y = centroid(F.col("rings"))
    inner = zones.select(F.col("zone").alias("inner"), x.alias("cx"), y.alias("cy"))
    outer = few_zones(zones.select(F.col("zone").alias("outer"), "rings", box(F.col("rings")).alias("b")))
    near = inner.join(outer, (F.col("inner") != F.col("outer")) & F.col("cx").between(F.col("b.x1"), F.col("b.x2")) & F.col("cy").between(F.col("b.y1"), F.col("b.y2")))
    return near.where(contains(F.col("rings"), F.col("cx"), F.col("cy"))).select("outer", "inner")


def dissolve(zones: DataFrame, by: str) -> DataFrame:
    """One multipart zone for each value of ``by``: all rings of its zones, in the order of their names, and how many zones it had."""
    packed = F.sort_array(F.collect_list(F.struct("zone", "rings")))
    return zones.groupBy(by).agg(packed.alias("p")).select(by, F.flatten(F.transform("p", lambda z: z["rings"])).alias("rings"), F.size("p").alias("parts"))


def adaptive_buffer(sites: DataFrame, rings: Column, initial: float, step: float, most: float, least_count: int) -> DataFrame:
    """Sites within the least of the radii initial, initial + step, ..., most around a zone that holds enough of them, else ``most``.

    Every site's distance is taken once; the radius follows from counts by step.
    """
    far = sites.withColumn("distance_m", metres_to(rings, F.col("lon"), F.col("lat"))).where(F.col("distance_m") <= most)
    reach = F.least(F.lit(float(most)), initial + step * F.greatest(F.lit(0.0), F.ceil((F.col("distance_m") - initial) / step))).cast("double")
    counts = far.groupBy(reach.alias("radius_m")).agg(F.count("*").alias("n"))  # one row for each radius
    from pyspark.sql import Window

    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("radius_m")))
    radius = upto.agg(F.coalesce(F.min(F.when(F.col("upto") >= least_count, F.col("radius_m"))), F.lit(float(most))).alias("radius_m"))
    return far.join(F.broadcast(radius), F.col("distance_m") <= F.col("radius_m"))  # one row


# -- formats -------------------------------------------------------------------


def rings_from_wkt(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text; the closing corner of each ring goes."""
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def corner(c: Column) -> Column:
        parts = F.split(F.trim(c), r"\s+")
        return F.struct(parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y"))

    def ring(t: Column) -> Column:
        corners = F.transform(F.split(t, ","), corner)
        return F.slice(corners, F.lit(1), F.size(corners) - 1)

    return F.transform(texts, ring)


def rings_to_wkt(rings: Column, digits: int = 6) -> Column:
    def ring(r: Column) -> Column:
        closed = F.concat(r, F.slice(r, 1, 1))
        return F.concat(F.lit("("), F.array_join(F.transform(closed, lambda c: F.format_string(f"%.{digits}f %.{digits}f", c["x"], c["y"])), ", "), F.lit(")"))

    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


def rings_from_coordinates(kind: Column, coordinates: Column) -> Column:
    """Rings from the JSON text of a GeoJSON Polygon's or MultiPolygon's coordinates."""
    rings = F.when(kind == "Polygon", F.from_json(coordinates, "array<array<array<double>>>")).otherwise(F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")))
    corners = F.transform(rings, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    return F.transform(corners, lambda r: F.slice(r, F.lit(1), F.size(r) - 1))


def polygon_feature(rings: Column, properties: Column) -> Column:
    """A GeoJSON feature as text."""
    closed = F.transform(rings, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda c: F.array(c["x"], c["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))
