"""More of the catalogue: zones as polygons in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.operators import zones as Z
from lastleg.queries import query
from lastleg.sources import tables as T

# A zone for each nation: a rectangle with a notch, of its own size and place; every fifth has a hole.
_CORNERS = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.6), (0.0, 1.0)]
_HOLE = [(0.4, 0.1), (0.4, 0.2), (0.6, 0.2), (0.6, 0.1)]


def zones(spark, d) -> DataFrame:
    """(zone, kind, city, rings): some contain others, and two kinds share each name."""
    n = T.table(spark, d, "nation")
    kinds = F.explode(F.array(F.struct(F.lit("district").alias("kind"), F.lit(0.02).alias("size")), F.struct(F.lit("neighbourhood").alias("kind"), F.lit(0.008).alias("size"))))
    z = n.select("n_nationkey", "n_name", "n_regionkey", kinds.alias("k")).select("*", "k.kind", "k.size")
    x0, y0 = F.lit(2.15) + (F.col("n_nationkey") * 7 % 11) * F.lit(0.004), F.lit(41.38) + (F.col("n_nationkey") * 5 % 13) * F.lit(0.003)

    def ring(corners):
        return F.array(*(F.struct((x0 + F.lit(a) * F.col("size")).alias("x"), (y0 + F.lit(b) * F.col("size")).alias("y")) for a, b in corners))

    rings = F.when(F.col("n_nationkey") % 5 == 0, F.array(ring(_CORNERS), ring(_HOLE))).otherwise(F.array(ring(_CORNERS)))
    return z.select(F.concat_ws(":", "n_name", "kind").alias("zone"), F.col("n_name").alias("name"), "kind", F.col("n_regionkey").alias("city"), rings.alias("rings"))


def _ring_sql(corners, ring: int) -> str:
    return ", ".join(f"({ring}, {k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(corners))


_ZONES = f"""zn AS (SELECT n_name || ':' || kind AS zone, n_name AS name, kind, n_regionkey AS city, n_nationkey AS k, size, 2.15::DOUBLE+(n_nationkey*7%11)*0.004::DOUBLE AS x0, 41.38::DOUBLE+(n_nationkey*5%13)*0.003::DOUBLE AS y0 FROM nation, (VALUES ('district',0.02::DOUBLE),('neighbourhood',0.008::DOUBLE)) v(kind,size)),
shape(ring, pos, a, b) AS (VALUES {_ring_sql(_CORNERS, 0)}, {_ring_sql(_HOLE, 1)}),
cn AS (SELECT zone, name, kind, city, ring, pos, x0+a*size AS x, y0+b*size AS y FROM zn, shape WHERE ring=0 OR k%5=0),
eg AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM cn WINDOW w AS (PARTITION BY zone, ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_INSIDE = "sum((((y>{y}) <> (y2>{y})) AND {x} < (x2-x)/(y2-y)*({y}-y)+x)::INT)%2=1"


@query(f"WITH {_ZONES} SELECT customer_id, zone FROM cust JOIN eg ON true GROUP BY customer_id, zone HAVING {_INSIDE.format(x='any_value(lon)', y='any_value(lat)').replace('any_value(lon)', 'lon').replace('any_value(lat)', 'lat')}", "cust")
def zone_table_points(spark, d):
    """Every point with every zone of a table that contains it: concave rings and holes."""
    return Z.zones_of_points(T.customers(spark, d).select("customer_id", "lon", "lat"), zones(spark, d).select("zone", "rings")).select("customer_id", "zone")


_AREA = f"ar AS (SELECT zone, city, sum(x*y2-x2*y) AS a2, min(x) FILTER (ring=0 AND pos=0) AS fx, min(y) FILTER (ring=0 AND pos=0) AS fy FROM eg GROUP BY 1, 2), ce AS (SELECT eg.zone, ar.city, fx + sum((x-fx+x2-fx)*((x-fx)*(y2-fy)-(x2-fx)*(y-fy)))/(3*sum((x-fx)*(y2-fy)-(x2-fx)*(y-fy))) AS cx, fy + sum((y-fy+y2-fy)*((x-fx)*(y2-fy)-(x2-fx)*(y-fy)))/(3*sum((x-fx)*(y2-fy)-(x2-fx)*(y-fy))) AS cy FROM eg JOIN ar USING (zone) GROUP BY eg.zone, ar.city, fx, fy)"


@query(f"WITH {_ZONES}, {_AREA} SELECT zone, round(cx,6) AS lon, round(cy,6) AS lat FROM ce")
def zone_centroids(spark, d):
    x, y = Z.centroid(F.col("rings"))
    return zones(spark, d).select("zone", F.round(x, 6).alias("lon"), F.round(y, 6).alias("lat"))


@query(f"WITH {_ZONES}, {_AREA} SELECT eg.zone AS outer, ce.zone AS inner FROM eg JOIN ce ON eg.zone<>ce.zone GROUP BY eg.zone, ce.zone, cx, cy HAVING {_INSIDE.format(x='cx', y='cy')}")
def zone_containment(spark, d):
    """Pairs of zones where one contains the other's centroid."""
    return Z.overlaps(zones(spark, d))


@query(f"WITH {_ZONES} SELECT city, count(DISTINCT zone)::INT AS parts, count(DISTINCT (zone, ring))::INT AS rings, count(*) AS corners, round(sum(x),6) AS sum_x FROM cn WHERE kind='district' GROUP BY 1")
def zone_dissolve(spark, d):
    """One multipart zone for each city, of its districts."""
    z = Z.dissolve(zones(spark, d).where("kind = 'district'"), "city")
    total = F.aggregate(F.flatten("rings"), F.lit(0.0), lambda t, c: t + c["x"])
    return z.select("city", "parts", F.size("rings").alias("rings"), F.size(F.flatten("rings")).cast("bigint").alias("corners"), F.round(total, 6).alias("sum_x"))


@query(f"WITH {_ZONES} SELECT zone, kind, CASE WHEN name='NATION_6' THEN 0 ELSE 1 END::INT AS request FROM zn WHERE (name='NATION_6' AND kind='district') OR (name='NATION_17' AND kind='neighbourhood')")
def zone_selection(spark, d):
    """Zones by name:type, in any case."""
    z = zones(spark, d).withColumnRenamed("zone", "key").withColumnRenamed("name", "zone")
    return Z.select_zones(z, ["Nation_6:District", "NATION_17:neighbourhood"]).select(F.col("key").alias("zone"), "kind", "request")


@query(f"WITH {_ZONES}, b AS (SELECT zone, min(x) AS x1, min(y) AS y1, max(x) AS x3, max(y) AS y3 FROM cn GROUP BY 1) SELECT p.zone AS zone_1, q.zone AS zone_2 FROM b p JOIN b q ON p.zone<q.zone WHERE p.x1<=q.x3 AND q.x1<=p.x3 AND p.y1<=q.y3 AND q.y1<=p.y3")
def zone_boxes_meet(spark, d):
    """Pairs of zones whose extents meet."""
    z = zones(spark, d).select("zone", Z.box(F.col("rings")).alias("b"))
    p, q = z.select(F.col("zone").alias("zone_1"), F.col("b").alias("p")), Z.few_zones(z.select(F.col("zone").alias("zone_2"), F.col("b").alias("q")))
    meet = (F.col("p.x1") <= F.col("q.x2")) & (F.col("q.x1") <= F.col("p.x2")) & (F.col("p.y1") <= F.col("q.y2")) & (F.col("q.y1") <= F.col("p.y2"))
    return p.join(q, (F.col("zone_1") < F.col("zone_2")) & meet).select("zone_1", "zone_2")


_DEGREE = "111194.92664455873::DOUBLE"
_SIDE = f"""sd AS (SELECT facility_id, lon, lat, x, y, x2, y2, (x-lon)*cos(radians(lat))*{_DEGREE} AS ax, (y-lat)*{_DEGREE} AS ay, (x2-lon)*cos(radians(lat))*{_DEGREE} AS bx, (y2-lat)*{_DEGREE} AS by_ FROM fac, eg WHERE zone='NATION_6:district'),
tt AS (SELECT *, greatest(0.0, least(1.0, -(ax*(bx-ax)+ay*(by_-ay))/((bx-ax)**2+(by_-ay)**2))) AS t FROM sd),
ds AS (SELECT facility_id, CASE WHEN {_INSIDE.format(x='lon', y='lat')} THEN 0.0::DOUBLE ELSE min(sqrt((ax+t*(bx-ax))**2+(ay+t*(by_-ay))**2)) END AS m FROM tt GROUP BY facility_id, lon, lat)"""


@query(f"WITH {_ZONES}, {_SIDE} SELECT facility_id, round(m,3) AS distance_m FROM ds", "fac")
def zone_distance(spark, d):
    """Metres from each facility to a zone, 0 inside."""
    z = zones(spark, d).where("zone = 'NATION_6:district'").select("rings")
    f = T.facilities(spark, d).join(Z.few_zones(z))  # one zone
    return f.select("facility_id", F.round(Z.metres_to(F.col("rings"), F.col("lon"), F.col("lat")), 3).alias("distance_m"))


@query(f"WITH {_ZONES}, {_SIDE}, k AS (SELECT facility_id, m, least(2000.0, 100.0+100.0*greatest(0, ceil((m-100)/100)))::DOUBLE AS r FROM ds WHERE m<=2000), c AS (SELECT r, sum(count(*)) OVER (ORDER BY r) AS upto FROM k GROUP BY r), x AS (SELECT coalesce(min(r) FILTER (upto>=12), 2000.0)::DOUBLE AS radius_m FROM c) SELECT facility_id, round(m,3) AS distance_m, radius_m FROM k, x WHERE m<=radius_m", "fac")
def zone_buffer_adaptive(spark, d):
    """Facilities around a zone within the least radius that holds twelve of them."""
    z = zones(spark, d).where("zone = 'NATION_6:district'").select("rings")
    near = Z.adaptive_buffer(T.facilities(spark, d).join(Z.few_zones(z)), F.col("rings"), 100.0, 100.0, 2000.0, 12)
    return near.select("facility_id", F.round("distance_m", 3).alias("distance_m"), "radius_m")


_POLYGON = "SELECT zone, 'POLYGON (' || string_agg(r, ', ' ORDER BY ring) || ')' AS wkt FROM (SELECT zone, ring, '(' || string_agg(printf('%.6f %.6f', x, y), ', ' ORDER BY pos) || ', ' || first(printf('%.6f %.6f', x, y) ORDER BY pos) || ')' AS r FROM cn GROUP BY 1, 2) GROUP BY 1"


@query(f"WITH {_ZONES} {_POLYGON}")
def zone_wkt(spark, d):
    """Polygons as text, read back and written again."""
    wkt = zones(spark, d).select("zone", Z.rings_to_wkt(F.col("rings")).alias("wkt"))
    return wkt.select("zone", Z.rings_to_wkt(Z.rings_from_wkt(F.col("wkt"))).alias("wkt"))


def _adder(field: str):
    return lambda t, c: t + c[field]


@query(f"WITH {_ZONES} SELECT zone, kind, count(DISTINCT ring)::INT AS rings, round(sum(x),6) AS sum_x, round(sum(y),6) AS sum_y FROM cn GROUP BY 1, 2")
def zone_geojson(spark, d):
    """Polygon features written to a file and scanned again."""
    from lastleg.sources import files, sinks

    path = sinks.scratch(spark, "zones")
    z = zones(spark, d)
    z.select(Z.polygon_feature(F.col("rings"), F.struct("zone", "kind")).alias("value")).write.text(path)
    back = files.read_geojson_polygons(spark, path, "zone string, kind string", multiline=False)
    corners = F.flatten("rings")
    sums = [F.round(F.aggregate(corners, F.lit(0.0), _adder(n)), 6).alias(f"sum_{n}") for n in ("x", "y")]
    return back.select("zone", "kind", F.size("rings").alias("rings"), *sums)


@query(f"WITH {_ZONES}, lb(label) AS (VALUES ('district'),('neighbourhood')) SELECT kind, count(DISTINCT zone) AS zones, count(*) AS corners FROM cn JOIN lb ON kind=label GROUP BY 1 UNION ALL SELECT 'city', count(DISTINCT city), count(*) FROM cn WHERE kind='district'")
def zone_levels_union(spark, d):
    """All administrative levels in one table: districts, neighbourhoods and the cities made of districts."""
    z = zones(spark, d)
    levels = z.select("kind", "zone", "rings").unionByName(Z.dissolve(z.where("kind = 'district'"), "city").select(F.lit("city").alias("kind"), F.col("city").cast("string").alias("zone"), "rings"))
    return levels.groupBy("kind").agg(F.count("*").alias("zones"), F.sum(F.size(F.flatten("rings"))).alias("corners"))
