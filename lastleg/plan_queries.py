"""More of the catalogue: legs and models over given routes, matrices, summaries, audits, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastleg.functions import clock, geo
from lastleg.operators import matrices, profile, resolution, routing
from lastleg.plans import legs, models
from lastleg.queries import _ORDERED, _VALID, _positions, query
from lastleg.sources import tables as T

# -- models over given routes ---------------------------------------------------

# Every order is a route of each leg that its key picks; every line a stop, or a customer's own way.
_PICKS = {"direct": "true", "supply_microhub": "route_id%3=0", "supply_pudo": "route_id%3=1", "cycling": "route_id%5=0", "walking": "route_id%5=1"}
_ROUTES = "rt AS (SELECT route_id, sum(km) AS km, count(*)*0.02 AS access_km, 10+sum(minutes)+5*count(*)+count(*)*0.02/5*60 AS minutes FROM st GROUP BY 1)"
_LEG_SQL = " UNION ALL ".join(f"SELECT '{leg}' AS leg, count(*) AS trips, sum(km) AS km, sum(access_km) AS access_km, sum(minutes) AS minutes FROM rt WHERE {pick}" for leg, pick in _PICKS.items())
_RATES = {"van_km": 0.25, "e_van_km": 0.30, "bike_km": 0.42}
_ROWS = ", ".join(f"('{m}','{leg}',{_RATES.get(rate, 0.0)}::DOUBLE,{paid},{ {'microhub': 0.28, 'pudo': 0.35}.get(fee, 0.0)}::DOUBLE)" for m, (parts, fee) in models.MODELS.items() for leg, rate, paid in parts)


@query(
    f"""WITH {_ROUTES}, lg AS ({_LEG_SQL} UNION ALL SELECT 'collection', count(*), sum(2*km), count(*)*0.05, sum((2*km+0.05)/5*60) FROM st WHERE route_id%7=0),
ct(model, leg, rate, paid, fee) AS (VALUES {_ROWS}), x AS (SELECT *, CASE WHEN paid THEN greatest(0.0, minutes-trips*10.0)/60*12 ELSE 0 END AS pay FROM lg JOIN ct USING (leg)), p AS (SELECT sum(load) AS packages FROM st)
SELECT model, round(sum(km+access_km),4) AS km, sum(trips)::BIGINT AS trips, any_value(packages) AS packages, round(sum(minutes),4) AS minutes, round(sum(km*rate+pay)+any_value(fee)*any_value(packages),4) AS cost_eur,
round(sum(CASE WHEN model='M1' THEN km*180 WHEN leg='collection' THEN (km+access_km)*120 ELSE 0 END)/1000,4)::DOUBLE AS co2_kg, round(sum(CASE WHEN model='M1' THEN km*0.4/1000 ELSE 0 END),6)::DOUBLE AS nox_kg FROM x, p GROUP BY model""",
    "st",
)
def models_of_routes(spark, d):
    """The five models from given routes of every leg."""
    s = T.stops(spark, d)
    n = F.count("*")
    routes = s.groupBy("route_id").agg(F.sum("km").alias("km"), (n * 0.02).alias("access_km"), (10 + F.sum("minutes") + 5 * n + n * 0.02 / 5 * 60).alias("minutes"))
    own = s.where("route_id % 7 = 0").select((2 * F.col("km")).alias("km"), F.lit(0.05).alias("access_km"), ((2 * F.col("km") + 0.05) / 5 * 60).alias("minutes"))
    rows = [legs.totals(routes.where(pick), leg) for leg, pick in _PICKS.items()] + [legs.totals(own, "collection")]
    return models.compare(reduce(DataFrame.unionByName, rows), s.agg(F.sum("load").alias("packages")))


@query(f"WITH a AS (SELECT customer_id, demand, min(facility_id) AS facility_id FROM cust JOIN fac_ ON company=section GROUP BY 1, 2) SELECT customer_id AS client_id, facility_id, demand, round(2*({geo.haversine_sql('cust.lat', 'cust.lon', 'fac.lat', 'fac.lon')}/1000*1.3),6) AS km, (customer_id%90)*2/1000.0::DOUBLE AS access_km, round((2*({geo.haversine_sql('cust.lat', 'cust.lon', 'fac.lat', 'fac.lon')}/1000*1.3)+(customer_id%90)*2/1000.0::DOUBLE)/5*60,6) AS minutes FROM a JOIN cust USING (customer_id, demand) JOIN fac USING (facility_id)".replace("fac_", "(SELECT facility_id, company FROM fac)"), "cust fac")
def collection_trips(spark, d):
    """Every customer's way to their facility and back, and from the road to the door."""
    f = T.facilities(spark, d)
    site = f.groupBy(F.col("company").alias("section")).agg(F.min("facility_id").alias("facility_id"))
    c = T.customers(spark, d).join(site, "section").select("facility_id", F.col("customer_id").alias("client_id"), "lat", "lon", "demand", (F.col("customer_id") % 90).cast("double").alias("snap_m"))
    out = legs.collection(legs.with_depot(c, f), "snap_m")
    return out.select("client_id", "facility_id", "demand", F.round("km", 6).alias("km"), "access_km", F.round("minutes", 6).alias("minutes"))


def _plan(spark, d) -> DataFrame:
    """Orders as solved routes: their stops in order, when each is reached, totals."""
    s = _positions(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("position", "customer_id", "facility_id", "load", "km", "minutes"))).alias("s"))
    before = F.transform("s", lambda x, i: x["minutes"])
    arrive = F.transform("s", lambda x, i: F.round(10 + F.aggregate(F.slice(before, F.lit(1), i + 1), F.lit(0.0), lambda t, m: t + m) + 5 * i, 6))
    total = lambda c: F.aggregate("s", F.lit(0.0), lambda t, x: t + x[c])
    n = F.size("s")
    return s.select(F.lit(0).cast("bigint").alias("problem_id"), F.col("route_id").alias("route"), F.col("s.customer_id").alias("clients"), F.col("s.facility_id").alias("facilities"), F.col("s.load").alias("loads"), arrive.alias("arrive_min"), total("load").alias("load"), total("km").alias("km"), (10 + total("minutes") + 5 * n).alias("minutes"), F.lit("ok").alias("status"))


_ARRIVE = f"{_ORDERED}, ar AS (SELECT *, round(10 + sum(minutes) OVER (PARTITION BY route_id ORDER BY position) + 5*(position-1), 6) AS arrive_min FROM o)"


@query(f"WITH {_ARRIVE} SELECT facility_id, round(max(arrive_min)+540+5,6) AS available FROM ar WHERE route_id%3=0 GROUP BY 1", "st")
def facility_supply_available(spark, d):
    """When the last supply visit of each facility has been served, from the stops of the supply routes."""
    supply = _plan(spark, d).where("route % 3 = 0")
    stops = supply.select("route", F.posexplode(F.arrays_zip("facilities", "arrive_min")).alias("p", "x")).select(F.col("x.facilities").alias("facility_id"), F.col("x.arrive_min").alias("arrive_min"))
    return stops.groupBy("facility_id").agg(F.round(F.max("arrive_min") + 540 + 5, 6).alias("available"))


@query(f"WITH {_ARRIVE} SELECT 'M1_zone_' || (route_id%50) || '_direct_' || lpad(route_id::VARCHAR, 7, '0') AS route_key, string_agg(customer_id::VARCHAR, ',' ORDER BY position) AS clients, string_agg(printf('%.3f', arrive_min), ',' ORDER BY position) AS arrivals, round(sum(load),6) AS load, round(sum(km),6) AS km, round(10+sum(minutes)+5*count(*),6) AS minutes, 10+sum(minutes)+5*count(*)<=480 AS in_shift, count(*)::INT AS stops FROM ar GROUP BY route_id", "st")
def route_details(spark, d):
    """One record for each route: its key, stops, arrivals and totals."""
    p = _plan(spark, d)
    key = F.concat(F.lit("M1_zone_"), F.col("route") % 50, F.lit("_direct_"), F.lpad(F.col("route").cast("string"), 7, "0"))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    clients, arrivals = text("clients", lambda x: x.cast("string")), text("arrive_min", lambda x: F.format_string("%.3f", x))
    return p.select(key.alias("route_key"), clients.alias("clients"), arrivals.alias("arrivals"), F.round("load", 6).alias("load"), F.round("km", 6).alias("km"), F.round("minutes", 6).alias("minutes"), (F.col("minutes") <= 480).alias("in_shift"), F.size("clients").alias("stops"))


@query(f"WITH {_ARRIVE} SELECT route_id AS route, position::INT AS position, customer_id, TIMESTAMP '2026-03-02 09:00:00' + to_minutes(floor(arrive_min)::INT) AS arrival, TIMESTAMP '2026-03-02 09:00:00' + to_minutes(floor(arrive_min)::INT + 5) AS served, CASE WHEN position=1 THEN 'facility' ELSE 'customer' END AS stop_type FROM ar", "st")
def route_stop_times(spark, d):
    """Stops with the clock times of a shift that starts at nine."""
    stops = routing.stops_of(_plan(spark, d))
    start = F.to_timestamp_ntz(F.lit("2026-03-02 09:00:00"))
    at = F.floor("arrive_min").cast("int")
    return stops.select("route", "position", F.col("client_id").alias("customer_id"), (start + F.make_dt_interval(mins=at)).alias("arrival"), (start + F.make_dt_interval(mins=at + 5)).alias("served"), F.when(F.col("position") == 1, "facility").otherwise("customer").alias("stop_type"))


_XY = "printf('[%.6f,%.6f]', 2.15+((customer_id*104729)%1000)::DOUBLE/20000.0::DOUBLE, 41.38+((customer_id*7919)%1000)::DOUBLE/20000.0::DOUBLE)"


@query(f"WITH {_ORDERED} SELECT route_id AS route, '{{\"type\":\"Feature\",\"properties\":{{\"route\":' || route_id || ',\"stops\":' || count(*) || '}},\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[[2.175000,41.405000],' || string_agg({_XY}, ',' ORDER BY position) || ',[2.175000,41.405000]]}}}}' AS feature FROM o WHERE customer_id%11>0 GROUP BY 1", "st")
def route_features(spark, d):
    """GeoJSON lines from the depot over the stops and back; stops without a place are left out."""
    s = _positions(spark, d).where("customer_id % 11 > 0").select("route_id", "position", T._spread("customer_id", 104729, 2.15).alias("x"), T._spread("customer_id", 7919, 41.38).alias("y"))
    points = F.transform(F.sort_array(F.collect_list(F.struct("position", "x", "y"))), lambda p: F.format_string("[%.6f,%.6f]", p["x"], p["y"]))
    depot = F.lit("[2.175000,41.405000]")
    text = F.concat(F.lit('{"type":"Feature","properties":{"route":'), F.col("route_id"), F.lit(',"stops":'), F.col("n"), F.lit('},"geometry":{"type":"LineString","coordinates":['), depot, F.lit(","), F.array_join("p", ","), F.lit(","), depot, F.lit("]}}"))
    return s.groupBy("route_id").agg(points.alias("p"), F.count("*").alias("n")).select(F.col("route_id").alias("route"), text.alias("feature"))


@query("WITH c AS (SELECT route_id, list_sort(list_distinct(list(facility_id))) AS s FROM st GROUP BY 1) SELECT count(*) AS features, sum(len(s))::BIGINT AS points FROM c", "st")
def feature_collection(spark, d):
    """A collection written to a file, one feature a line, and read again: features and points."""
    from lastleg.sources import sinks

    path = sinks.scratch(spark, "features")
    c = T.stops(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_set("facility_id")).alias("s"))
    geometry = F.struct(F.lit("MultiPoint").alias("type"), F.transform("s", lambda x: F.array(x * 0.1, x * 0.01)).alias("coordinates"))
    c.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("route_id").alias("properties"), geometry.alias("geometry"))).alias("value")).write.text(path)
    back = spark.read.schema("geometry struct<coordinates: array<array<double>>>").json(path)
    return back.agg(F.count("*").alias("features"), F.sum(F.size("geometry.coordinates")).alias("points"))


# -- timelines -------------------------------------------------------------------

_TIMES = "(VALUES (0, 540, 1.0), (540, 560, 1.4), (560, 580, 1.2), (580, 1440, 1.0)) iv(a, b, m)"


@query(
    f"""WITH RECURSIVE {{views}}{_ORDERED}, e AS (SELECT route_id, count(*) AS n FROM o GROUP BY 1),
t AS (SELECT route_id, 0::BIGINT AS position, 550.0::DOUBLE AS clock, 0.0::DOUBLE AS base, 0.0::DOUBLE AS adjusted FROM e
UNION ALL SELECT t.route_id, o.position, clock + minutes*m::DOUBLE + 5, base + minutes, adjusted + minutes*m::DOUBLE FROM t JOIN o ON o.route_id=t.route_id AND o.position=t.position+1 JOIN {_TIMES} ON clock>=a AND clock<b)
SELECT route_id, round(max(clock),6) AS ends, round(max(adjusted)-max(base),6) AS delay_min, max(clock)<=600 AS feasible FROM t GROUP BY 1""".replace("{views}", T.SQL["st"] + ", ")
)
def route_timelines(spark, d):
    """Ends of routes under multipliers by the time at which each arc starts, the delay against free roads, and whether the shift holds."""
    intervals = [(0, 540, 1.0), (540, 560, 1.4), (560, 580, 1.2), (580, 1440, 1.0)]
    s = _positions(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("position", "minutes"))).alias("s"))
    end = clock.timeline(F.transform("s", lambda x: x["minutes"]), 550.0, 5.0, intervals)
    t = s.select("route_id", end.alias("t"))
    return t.select("route_id", F.round("t.clock", 6).alias("ends"), F.round(F.col("t.adjusted") - F.col("t.base"), 6).alias("delay_min"), (F.col("t.clock") <= 600).alias("feasible"))


@query("WITH r AS (SELECT facility_id, route_id, CASE WHEN route_id%13=0 THEN NULL ELSE 540+10+sum(minutes)+5*count(*) END AS ends, 540+10 AS starts FROM st GROUP BY 1, 2), g AS (SELECT facility_id, count(*) AS routes, count(ends)=count(*) AS complete, min(CASE WHEN ends IS NOT NULL THEN starts END) AS first_start, max(ends) AS last, count(*) FILTER (ends>575) AS late FROM r GROUP BY 1) SELECT facility_id, routes, complete, first_start, CASE WHEN complete THEN round(last,6) END::DOUBLE AS last_end, CASE WHEN complete THEN round(last-first_start,6) END::DOUBLE AS duration, CASE WHEN complete THEN late END::DOUBLE AS after_shift, CASE WHEN complete THEN round(greatest(0,last-575),6) END::DOUBLE AS overtime FROM g", "st")
def timeline_completeness(spark, d):
    """Last end, duration, late routes and overtime of a plan: only where every route has its times; the first start always."""
    r = T.stops(spark, d).groupBy("facility_id", "route_id").agg((550 + F.sum("minutes") + 5 * F.count("*")).alias("e")).withColumn("ends", F.when(F.col("route_id") % 13 != 0, F.col("e")))
    g = r.groupBy("facility_id").agg(F.count("*").alias("routes"), (F.count("ends") == F.count("*")).alias("complete"), F.min(F.when(F.col("ends").isNotNull(), 550)).alias("first_start"), F.max("ends").alias("last"), F.count(F.when(F.col("ends") > 575, 1)).alias("late"))
    whole = lambda x: F.when(F.col("complete"), x)
    return g.select("facility_id", "routes", "complete", "first_start", whole(F.round("last", 6)).alias("last_end"), whole(F.round(F.col("last") - F.col("first_start"), 6)).alias("duration"), whole(F.col("late").cast("double")).alias("after_shift"), whole(F.round(F.greatest(F.lit(0.0), F.col("last") - 575), 6)).alias("overtime"))


# -- matrices ----------------------------------------------------------------------

_POINTS = "pt AS (SELECT customer_id, section, lat, lon, row_number() OVER (PARTITION BY section ORDER BY customer_id)-1 AS k FROM cust WHERE customer_id<=600)"
_WAY = geo.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")


def _points(spark, d) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("section").orderBy("customer_id")) - 1
    return T.customers(spark, d).where("customer_id <= 600").select(F.col("section").alias("problem_id"), k.alias("k"), "lat", "lon")


@query(f"WITH {_POINTS} SELECT a.section AS problem_id, a.k AS o, b.k AS d, round({_WAY}/1000*1.3,6) AS km, round({_WAY}/1000*1.3/20.0*60,6) AS minutes FROM pt a JOIN pt b ON a.section=b.section", "cust")
def matrix_square(spark, d):
    """Distances and times between all points of a problem, assembled from blocks."""
    m = matrices.square(_points(spark, d), matrices.GreatCircle(20.0, 1.3), block=7)
    return m.select("problem_id", "o", "d", F.round("km", 6).alias("km"), F.round("minutes", 6).alias("minutes"))


@query(f"WITH {_POINTS} SELECT a.section AS problem_id, a.k AS o, b.k AS d, round({_WAY}/1000*1.3,6) AS km FROM pt a JOIN pt b ON a.section=b.section AND b.k<3", "cust")
def matrix_rectangular(spark, d):
    """Distances from every point to a problem's first three, which stand for its facilities."""
    p = _points(spark, d)
    m = matrices.rectangular(p, p.where("k < 3"), matrices.GreatCircle(20.0, 1.3))
    return m.select("problem_id", "o", "d", F.round("km", 6).alias("km"))


@query(f"WITH {_POINTS}, m AS (SELECT a.section AS problem_id, a.k AS o, b.k AS d, {_WAY}/1000*1.3 AS km FROM pt a JOIN pt b ON a.section=b.section) SELECT problem_id, count(*) AS cells, round(sum(km),3) AS km, round(max(km),6) AS longest FROM m GROUP BY 1", "cust")
def matrix_cache(spark, d):
    """A matrix read from the content-addressed cache; the second time nothing is computed."""
    store = matrices.Cache(spark)
    for _ in range(2):
        m = store.square(_points(spark, d), matrices.GreatCircle(20.0, 1.3))
    return m.groupBy("problem_id").agg(F.count("*").alias("cells"), F.round(F.sum("km"), 3).alias("km"), F.round(F.max("km"), 6).alias("longest"))


@query(f"WITH {_POINTS}, m AS (SELECT a.section AS problem_id, a.k AS o, b.k AS d, {_WAY} AS m, (a.k*7+b.k)%19=0 AND a.k<>b.k AS bad FROM pt a JOIN pt b ON a.section=b.section), e AS (SELECT problem_id, unnest([o, d]) AS k, bad FROM m) SELECT problem_id, k, count(*) FILTER (bad) AS invalid, row_number() OVER (PARTITION BY problem_id ORDER BY count(*) FILTER (bad) DESC, k) AS place FROM e GROUP BY 1, 2 QUALIFY place<=5", "cust")
def matrix_worst_points(spark, d):
    """The five points of each problem with the most invalid cells, in and out."""
    m = matrices.square(_points(spark, d), matrices.GreatCircle(20.0, 1.3))
    bad = ((F.col("o") * 7 + F.col("d")) % 19 == 0) & (F.col("o") != F.col("d"))
    e = m.select("problem_id", F.explode(F.array("o", "d")).alias("k"), bad.alias("bad")).groupBy("problem_id", "k").agg(F.count(F.when(F.col("bad"), 1)).alias("invalid"))
    place = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.desc("invalid"), "k"))
    return e.withColumn("place", place).where("place <= 5")


@query(f"WITH {_POINTS} SELECT a.section AS problem_id, 'LINESTRING (' || printf('%.6f %.6f', a.lon, a.lat) || ', ' || printf('%.6f %.6f', b.lon, b.lat) || ')' AS wkt FROM pt a JOIN pt b ON a.section=b.section AND a.k=0 AND b.k=1", "cust")
def route_geometry(spark, d):
    """Straight lines, where no road geometry is given."""
    p = _points(spark, d)
    xy = F.format_string("%.6f %.6f", "lon", "lat")
    first, second = (p.where(f"k = {k}").select("problem_id", xy.alias(f"p{k}")) for k in (0, 1))
    return first.join(second, "problem_id").select("problem_id", F.concat(F.lit("LINESTRING ("), "p0", F.lit(", "), "p1", F.lit(")")).alias("wkt"))


@query(f"WITH {_POINTS}, f AS (SELECT section, k, lat, lon FROM pt WHERE k<4) SELECT a.section AS problem_id, a.k AS o, b.k AS d, row_number() OVER (PARTITION BY a.section, a.k ORDER BY round({_WAY},3), b.k) AS place FROM pt a JOIN f b ON a.section=b.section", "cust")
def facility_order(spark, d):
    """All facilities of a problem in the order of their distance, for every customer."""
    p = _points(spark, d)
    m = matrices.rectangular(p, p.where("k < 4"), matrices.GreatCircle(20.0, 1.0))
    place = F.row_number().over(Window.partitionBy("problem_id", "o").orderBy(F.round(F.col("km") * 1000, 3), "d"))
    return m.select("problem_id", "o", "d", place.alias("place"))


# -- summaries ------------------------------------------------------------------------


@query("SELECT section, round(avg(lat),6) AS lat, round(avg(lon),6) AS lon, count(*) AS customers FROM cust GROUP BY 1", "cust")
def plain_centroid(spark, d):
    return T.customers(spark, d).groupBy("section").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("*").alias("customers"))


@query("WITH p AS (SELECT c_nationkey AS section, c_custkey%3 AS year, c_custkey%2 AS sex, round(c_acctbal) AS n FROM customer WHERE c_acctbal>0) SELECT section, sum(n)::BIGINT AS population FROM p WHERE year=(SELECT max(year) FROM p) AND sex=0 GROUP BY 1")
def population_by_section(spark, d):
    """Persons of one sex in the latest year, by section."""
    from lastleg.sources.files import latest

    c = T.table(spark, d, "customer").where("c_acctbal > 0")
    p = c.select(F.col("c_nationkey").alias("section"), (F.col("c_custkey") % 3).alias("year"), (F.col("c_custkey") % 2).alias("sex"), F.round("c_acctbal").cast("bigint").alias("n"))
    return latest(p, "year").where("sex = 0").groupBy("section").agg(F.sum("n").alias("population"))


_KEYS = "weekday, slot, hour(ts) AS hour, month(ts) AS month"


def _four_keys(spark, d) -> DataFrame:
    return profile.valid_readings(T.readings(spark, d)).select("weekday", "slot", F.hour("ts").cast("bigint").alias("hour"), F.month("ts").cast("bigint").alias("month"), "intensity", "occupancy", "speed")


@query(f"WITH {_VALID} SELECT {_KEYS}, intensity, occupancy, count(*) AS n, sum(intensity)::BIGINT AS sum_intensity, sum(occupancy)::BIGINT AS sum_occupancy, count(*) FILTER (speed>=5) AS n_speed, round(sum(speed) FILTER (speed>=5),6) AS sum_speed FROM v GROUP BY 1,2,3,4,5,6", "rd")
def profile_partials(spark, d):
    """Counts and sums by four keys and both measures: what a monthly pass keeps."""
    fast = F.when(F.col("speed") >= 5, F.col("speed"))
    return _four_keys(spark, d).groupBy("weekday", "slot", "hour", "month", "intensity", "occupancy").agg(F.count("*").alias("n"), F.sum("intensity").alias("sum_intensity"), F.sum("occupancy").alias("sum_occupancy"), F.count(fast).alias("n_speed"), F.round(F.sum(fast), 6).alias("sum_speed"))


@query(f"WITH {_VALID}, k AS (SELECT {_KEYS}, intensity, occupancy FROM v) SELECT 'intensity' AS measure, weekday, slot, hour, month, intensity AS value, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'occupancy', weekday, slot, hour, month, occupancy, count(*) FROM k GROUP BY ALL", "rd")
def profile_marginals(spark, d):
    """Frequency tables of both measures, in one pass."""
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("intensity", "occupancy"))))
    return _four_keys(spark, d).select("weekday", "slot", "hour", "month", both.alias("x")).groupBy("x.measure", "weekday", "slot", "hour", "month", "x.value").agg(F.count("*").alias("n"))


@query(f"WITH {_VALID}, k AS (SELECT {_KEYS}, intensity, occupancy FROM v), t AS (SELECT weekday, slot, hour, month, count(*) AS n, round(avg(intensity),6) AS mean_intensity FROM k GROUP BY ALL), i AS (SELECT weekday, slot, hour, month, quantile_disc(intensity, 0.5) AS p50_intensity FROM k GROUP BY ALL), o AS (SELECT weekday, slot, hour, month, quantile_disc(occupancy, 0.5) AS p50_occupancy FROM k GROUP BY ALL) SELECT * FROM t LEFT JOIN i USING (weekday, slot, hour, month) LEFT JOIN o USING (weekday, slot, hour, month)", "rd")
def profile_joined(spark, d):
    """Totals with the medians of both measures; nearest ranks come from frequency tables, so no task holds a group's readings."""
    k = _four_keys(spark, d)
    keys = ["weekday", "slot", "hour", "month"]
    out = k.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("intensity"), 6).alias("mean_intensity"))
    for m in ("intensity", "occupancy"):
        out = out.join(profile.nearest_ranks(k, keys, m, {f"p50_{m}": 0.5}), keys, "left")
    return out


@query(f"WITH {_VALID} SELECT count(*) AS n, count(DISTINCT sensor_id) AS sensors, min(intensity) AS least, max(intensity) AS most, round(median(intensity),6) AS median_intensity, sum(intensity)::BIGINT AS sum_intensity, sum(occupancy)::BIGINT AS sum_occupancy, round(median(occupancy),6) AS median_occupancy, min(ts) AS first_at, max(ts) AS last_at FROM v", "rd")
def profile_totals(spark, d):
    """Counts, medians and sums over all readings; medians from frequency tables."""
    v = profile.valid_readings(T.readings(spark, d))
    one = v.agg(F.count("*").alias("n"), F.countDistinct("sensor_id").alias("sensors"), F.min("intensity").alias("least"), F.max("intensity").alias("most"), F.sum("intensity").alias("sum_intensity"), F.sum("occupancy").alias("sum_occupancy"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    for m in ("intensity", "occupancy"):
        one = one.join(F.broadcast(profile.median(v, m, f"median_{m}")))  # single rows
    return one


_CLUSTER = "s AS (SELECT company AS cluster, count(*) AS records, count(DISTINCT company) AS companies, count(DISTINCT code) AS services, list_sort(list_distinct(list(code))) AS codes, round(avg(lat),6) AS lat, round(avg(lon),6) AS lon, min(facility_id) AS first_id, max(facility_id) AS last_id, string_agg(DISTINCT name, ' | ' ORDER BY name) AS names, string_agg(facility_id::VARCHAR, ', ' ORDER BY facility_id) AS ids, bool_or(code=0) AS has_unknown, bool_or(code=1) AS has_locker, bool_or(code IN (2)) AS has_pudo, bool_or(code=3) AS has_collect, bool_or(code IN (4,6)) AS has_centre, bool_or(code=5) AS has_station, bool_or(code=7) AS has_store FROM fac GROUP BY 1)"


@query(
    f"""WITH {_CLUSTER}, g AS (SELECT a.company AS cluster, round(max({geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}),3) AS diameter_m FROM fac a JOIN fac b ON a.company=b.company GROUP BY 1)
SELECT s.* REPLACE (array_to_string(codes, ',') AS codes), diameter_m, CASE WHEN codes=[1] THEN 1 WHEN codes=[2] THEN 2 WHEN list_contains(codes,1) AND list_contains(codes,2) THEN 3 WHEN codes=[3] THEN 4 WHEN codes=[7] THEN 5 WHEN len(codes)=1 THEN 6 ELSE 7 END AS service_type,
CASE WHEN records=1 THEN 1 WHEN companies=1 THEN 2 WHEN services=1 THEN 3 ELSE 4 END AS sharing, CASE WHEN diameter_m<=15 THEN 1 WHEN diameter_m<=30 THEN 2 ELSE 3 END AS confidence, has_unknown OR diameter_m>30 AS review FROM s JOIN g USING (cluster)""",
    "fac",
)
def cluster_table(spark, d):
    """All columns of a cluster's summary: counts, sets, flags, middle, joined texts, type codes, and whether it needs review."""
    from lastleg.operators import spatial

    f = T.facilities(spark, d).withColumn("cluster", F.col("company"))
    out = resolution.cluster_table(f, spatial.diameters(f, "cluster").withColumn("diameter_m", F.round("diameter_m", 3)))
    return out.withColumn("codes", F.array_join(F.transform("codes", lambda x: x.cast("string")), ","))


@query(f"WITH {_CLUSTER}, k AS (SELECT cluster, records>1 AND NOT has_unknown AS merged FROM s) SELECT facility_id, cluster, records, service_count, merged FROM fac JOIN (SELECT cluster, records, services AS service_count, merged FROM s JOIN k USING (cluster)) ON cluster=company", "fac")
def records_with_clusters(spark, d):
    """Records with their cluster's columns, many to one: a cluster that is there twice is an error. Merged are those of several records, none unknown."""
    f = T.facilities(spark, d)
    c = f.groupBy(F.col("company").alias("cluster")).agg(F.count("*").alias("records"), F.countDistinct("code").alias("service_count"), (~F.bool_or(F.col("code") == 0) & (F.count("*") > 1)).alias("merged"))
    return resolution.many_to_one(f.select("facility_id", F.col("company").alias("cluster")), c, "cluster")


@query("WITH s AS (SELECT facility_id, count(*) AS visits, round(sum(load),6) AS supplied, max(day) AS last_supply FROM st WHERE line=1 GROUP BY 1), l AS (SELECT facility_id, count(DISTINCT route_id) AS routes, count(DISTINCT customer_id) AS customers, round(sum(load),6) AS delivered, max(day) AS last_delivery FROM st WHERE line>1 GROUP BY 1) SELECT facility_id, coalesce(visits,0) AS visits, coalesce(supplied,0)::DOUBLE AS supplied, last_supply, coalesce(routes,0) AS routes, coalesce(customers,0) AS customers, coalesce(delivered,0)::DOUBLE AS delivered, last_delivery, coalesce(supplied,0)>=coalesce(delivered,0) AS covered FROM s FULL JOIN l USING (facility_id)", "st")
def facility_balance(spark, d):
    """Supply against last mile of every facility that either has."""
    st = T.stops(spark, d)
    s = st.where("line = 1").groupBy("facility_id").agg(F.count("*").alias("visits"), F.round(F.sum("load"), 6).alias("supplied"), F.max("day").alias("last_supply"))
    m = st.where("line > 1").groupBy("facility_id").agg(F.countDistinct("route_id").alias("routes"), F.countDistinct("customer_id").alias("customers"), F.round(F.sum("load"), 6).alias("delivered"), F.max("day").alias("last_delivery"))
    return s.join(m, "facility_id", "full").na.fill(0, ["visits", "supplied", "routes", "customers", "delivered"]).withColumn("covered", F.col("supplied") >= F.col("delivered"))


@query("SELECT route_id%5 AS model, facility_id%7 AS zone, route_id%2 AS leg, facility_id AS depot, 'city' AS city, min(route_id) AS first_route, count(*) AS rows, arg_min(load, (route_id, line, customer_id, load)) AS load FROM st GROUP BY 1,2,3,4,5", "st")
def plan_metrics(spark, d):
    """One row for each plan (city, zone, model, leg, depot), with the measures of its first route."""
    keys = [(F.col("route_id") % 5).alias("model"), (F.col("facility_id") % 7).alias("zone"), (F.col("route_id") % 2).alias("leg"), F.col("facility_id").alias("depot"), F.lit("city").alias("city")]
    return T.stops(spark, d).groupBy(*keys).agg(F.min("route_id").alias("first_route"), F.count("*").alias("rows"), F.min_by("load", F.struct("route_id", "line", "customer_id", "load")).alias("load"))


@query("WITH r AS (SELECT route_id, sum(load) AS load, sum(km) AS before, sum(km)*(1-(route_id%10)/100.0) AS after FROM st GROUP BY 1) SELECT route_id, round(load,6) AS load, round(after,6)::DOUBLE AS km, CASE WHEN before>0 THEN round((before-after)/before*100,6) ELSE 0 END::DOUBLE AS improvement_pct, load<=200 AS fits FROM r", "st")
def route_improvement(spark, d):
    """Loads, ways and the share that a search has saved."""
    r = T.stops(spark, d).groupBy("route_id").agg(F.sum("load").alias("load"), F.sum("km").alias("before"))
    after = F.col("before") * (1 - (F.col("route_id") % 10) / 100.0)
    gain = F.when(F.col("before") > 0, F.round((F.col("before") - after) / F.col("before") * 100, 6)).otherwise(0.0)
    return r.select("route_id", F.round("load", 6).alias("load"), F.round(after, 6).alias("km"), gain.alias("improvement_pct"), (F.col("load") <= 200).alias("fits"))


@query("SELECT facility_id, round(coalesce(sum(CASE WHEN line=3 THEN NULL ELSE km END),0),6)::DOUBLE AS km, count(*) FILTER (line<>3) AS known, CASE WHEN count(*) FILTER (line<>3)>0 THEN round(sum(CASE WHEN line<>3 THEN km END)/count(*) FILTER (line<>3),6) ELSE 0 END::DOUBLE AS mean_km FROM st GROUP BY 1", "st")
def totals_without_nan(spark, d):
    """Sums that pass over NaN, and a mean that is 0 where nothing is known."""
    km = F.nanvl(F.when(F.col("line") == 3, F.lit(float("nan"))).otherwise(F.col("km")), F.lit(None))
    g = T.stops(spark, d).groupBy("facility_id").agg(F.sum(km).alias("s"), F.count(km).alias("known"))
    return g.select("facility_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("km"), "known", F.when(F.col("known") > 0, F.round(F.col("s") / F.col("known"), 6)).otherwise(0.0).alias("mean_km"))


@query("SELECT section, round(sum(sqrt((lat-41.405)**2+(lon-2.175)**2)),9) AS radial, round(sum((sqrt((lat-41.405)**2+(lon-2.175)**2)+sqrt((lat-41.405)**2+(lon-2.175)**2)*1.1)*demand),9) AS round_trips FROM cust GROUP BY 1", "cust")
def radial_distance(spark, d):
    """Sum of the ways out, and of the ways out and back for each package."""
    way = F.sqrt(F.pow(F.col("lat") - 41.405, F.lit(2)) + F.pow(F.col("lon") - 2.175, F.lit(2)))
    return T.customers(spark, d).groupBy("section").agg(F.round(F.sum(way), 9).alias("radial"), F.round(F.sum((way + way * 1.1) * F.col("demand")), 9).alias("round_trips"))


# -- reports, limits and sets ------------------------------------------------------------


@query("SELECT o_orderkey, (o_orderkey%100)::INT AS score, round(o_totalprice,2) AS distance FROM orders ORDER BY score DESC, distance, o_orderkey LIMIT 10")
def report_top(spark, d):
    """The first ten by score, then distance."""
    o = T.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("int").alias("score"), F.round("o_totalprice", 2).alias("distance"))
    return o.orderBy(F.desc("score"), "distance", "o_orderkey").limit(10)


@query("WITH r AS (SELECT DISTINCT route_id, route_id%5 AS model FROM st), k AS (SELECT route_id, model FROM r QUALIFY row_number() OVER (PARTITION BY model ORDER BY route_id)<=20) SELECT model, st.route_id, line, customer_id FROM st JOIN k USING (route_id)", "st")
def routes_and_their_stops(spark, d):
    """The first twenty routes of each model, with all their stops."""
    s = T.stops(spark, d).withColumn("model", F.col("route_id") % 5)
    r = s.select("model", "route_id").distinct()
    first = r.withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy("route_id"))).where("k <= 20").drop("k")
    return s.join(F.broadcast(first), ["model", "route_id"]).select("model", "route_id", "line", "customer_id")  # a hundred routes


@query("SELECT DISTINCT name FROM (SELECT s_name AS name FROM supplier WHERE s_suppkey%3=0 UNION SELECT coalesce(nullif(trim(CASE WHEN s_suppkey%5=0 THEN ' ' ELSE s_name END),''),'facility_'||s_suppkey) FROM supplier WHERE s_suppkey%2=0)")
def facility_names_union(spark, d):
    """Names of supplied and of serving facilities; a blank one is facility_ and its number."""
    s = T.table(spark, d, "supplier")
    raw = F.trim(F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.col("s_name")))
    named = F.coalesce(F.nullif(raw, F.lit("")), F.concat(F.lit("facility_"), F.col("s_suppkey")))
    return s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name")).union(s.where("s_suppkey % 2 = 0").select(named)).distinct()


@query("SELECT p_brand, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey)=1 AS kept FROM part")
def keep_first(spark, d):
    """The first row of each key stays; the others are returned as removed."""
    p = T.table(spark, d, "part").select("p_brand", "p_size", "p_partkey")
    return resolution.first_of(p, ["p_brand", "p_size"], ["p_partkey"]).select("p_brand", "p_size", "p_partkey", (F.col("copy_no") == 1).alias("kept"))


@query(f"WITH {_ORDERED}, c AS (SELECT route_id, position, customer_id FROM o UNION ALL SELECT route_id, max(position)+1, 0 FROM o GROUP BY 1) SELECT route_id, position, lag(customer_id, 1, 0) OVER (PARTITION BY route_id ORDER BY position) AS origin, customer_id AS destination FROM c", "st")
def route_arcs(spark, d):
    """Consecutive stops, from the depot (0) and back to it."""
    s = _positions(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct(F.col("position").cast("bigint"), "customer_id"))).alias("s"))
    path = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("s", lambda x: x["customer_id"]), F.array(F.lit(0).cast("bigint")))
    arcs = s.select("route_id", path.alias("p")).select("route_id", F.posexplode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a.alias("origin"), b.alias("destination")))).alias("k", "x"))
    return arcs.select("route_id", (F.col("k") + 1).alias("position"), "x.origin", "x.destination")


@query("WITH a AS (SELECT section, count(*) AS addresses FROM cust GROUP BY 1), p AS (SELECT s_nationkey AS section, sum(s_suppkey)*10 AS population FROM supplier WHERE s_nationkey%3>0 GROUP BY 1) SELECT customer_id, cust.section, (population/addresses)::DOUBLE AS weight FROM cust JOIN a USING (section) JOIN p USING (section) WHERE population>0", "cust")
def addresses_with_population(spark, d):
    """Addresses of sections with persons; each has its share of them as weight."""
    p = T.table(spark, d, "supplier").where("s_nationkey % 3 > 0").groupBy(F.col("s_nationkey").alias("section")).agg((F.sum("s_suppkey") * 10).alias("population"))
    c = T.customers(spark, d)
    both = c.join(c.groupBy("section").agg(F.count("*").alias("addresses")), "section").join(p, "section").where("population > 0")
    return both.select("customer_id", "section", (F.col("population") / F.col("addresses")).alias("weight"))


@query("WITH x AS (SELECT route_id%5 AS model, facility_id%9 AS zone, sum(km) AS km, count(DISTINCT route_id) AS routes FROM st GROUP BY 1,2), y AS (SELECT model, zone, model*10+zone AS budget FROM (SELECT unnest(range(5)) AS model), (SELECT unnest(range(8)) AS zone)) SELECT y.model, y.zone, budget, round(km,6) AS km, routes FROM y LEFT JOIN x ON x.model=y.model AND x.zone=y.zone", "st")
def summary_with_detail(spark, d):
    """A summary's rows with the detail of their model and zone, aggregated first."""
    x = T.stops(spark, d).groupBy((F.col("route_id") % 5).alias("model"), (F.col("facility_id") % 9).alias("zone")).agg(F.round(F.sum("km"), 6).alias("km"), F.countDistinct("route_id").alias("routes"))
    y = spark.range(5).select(F.col("id").alias("model"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("zone")).withColumn("budget", F.col("model") * 10 + F.col("zone"))
    return y.join(x, ["model", "zone"], "left")


_STATUS = "a AS (SELECT id, n, CASE WHEN id%17=0 THEN 'unroutable' WHEN n=0 THEN 'unassigned' WHEN n=1 THEN 'assigned' ELSE 'duplicated' END AS status FROM (SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1))"


@query(f"WITH {_STATUS} SELECT status, count(*) AS customers, sum(1+id%5)::BIGINT AS packages, sum((1+id%5)*n)::BIGINT AS routed, coalesce(sum((1+id%5)*(n-1)) FILTER (n>1), 0)::BIGINT AS surplus, min(id) AS first_id, max(id) AS last_id, array_to_string(list(id ORDER BY id)[1:20], ',') AS ids, round(100.0*count(*)/(SELECT count(*) FROM a),6)::DOUBLE AS share, max(n) AS most_visits, min(n) AS least_visits FROM a GROUP BY 1")
def integrity_by_status(spark, d):
    """Packages, visits, shares and the first twenty ids of every status."""
    from lastleg.queries import _audit

    a = _audit(spark, d)
    need = 1 + F.col("id") % 5
    total = a.agg(F.count("*").alias("all"))
    first = a.select("status", "id", F.row_number().over(Window.partitionBy("status").orderBy("id")).alias("k")).where("k <= 20").groupBy("status").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    g = a.groupBy("status").agg(F.count("*").alias("customers"), F.sum(need).alias("packages"), F.sum(need * F.col("n")).alias("routed"), F.coalesce(F.sum(F.when(F.col("n") > 1, need * (F.col("n") - 1))), F.lit(0)).alias("surplus"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("n").alias("most_visits"), F.min("n").alias("least_visits"))
    return g.join(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col("customers") / F.col("all"), 6)).drop("all").join(first, "status")  # single row; four rows


# -- experiments ---------------------------------------------------------------------------


@query("SELECT city, seed, size, scenario, ((seed*1000003 + CASE scenario WHEN 'low' THEN 11 WHEN 'medium' THEN 23 ELSE 37 END*10007 + size) % 4294967296)::BIGINT AS draw_seed, city || '_' || scenario || '_' || size || '_' || seed AS instance FROM (SELECT r_name AS city FROM region), (VALUES (101),(102),(103)) s(seed), (VALUES (100),(1000),(40000)) z(size), (VALUES ('low'),('medium'),('high')) c(scenario)")
def demand_matrix(spark, d):
    """Every instance of cities, seeds, sizes and scenarios, with the seed of its draw."""
    lists = {"seed": [101, 102, 103], "size": [100, 1000, 40000], "scenario": ["low", "medium", "high"]}
    out = T.table(spark, d, "region").select(F.col("r_name").alias("city"))
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    code = F.when(F.col("scenario") == "low", 11).when(F.col("scenario") == "medium", 23).otherwise(37)
    seed = (F.col("seed").cast("bigint") * 1000003 + code * 10007 + F.col("size")) % 4294967296
    return out.select("*", seed.alias("draw_seed"), F.concat_ws("_", "city", "scenario", F.col("size").cast("string"), F.col("seed").cast("string")).alias("instance"))


@query("SELECT r_name AS city, k AS replicate, 100+k AS demand_seed, 200+k AS search_seed, lower(r_name) || '_r' || lpad(k::VARCHAR, 3, '0') AS experiment FROM region, (SELECT unnest(range(1, 6)) AS k)")
def replicates(spark, d):
    """An experiment's replicates, each with its seeds and folder."""
    r = T.table(spark, d, "region").select(F.col("r_name").alias("city"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("replicate"))
    return r.select("city", "replicate", (100 + F.col("replicate")).alias("demand_seed"), (200 + F.col("replicate")).alias("search_seed"), F.concat(F.lower("city"), F.lit("_r"), F.lpad(F.col("replicate").cast("string"), 3, "0")).alias("experiment"))


@query("SELECT route_id%50 AS zone, count(*) AS routes, CASE WHEN max(load)>250 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN max(load)>250 THEN 'a load exceeds the capacity' END AS error FROM (SELECT route_id, sum(load) AS load FROM st GROUP BY 1) GROUP BY 1", "st")
def zone_status(spark, d):
    """Zones run on their own: one that fails says why, the others go on."""

    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            if frame["load"].max() > 250:
                raise ValueError("a load exceeds the capacity")
            status, why = "completed", None
        except ValueError as error:
            status, why = "failed", str(error)
        return pd.DataFrame({"zone": frame["zone"].iloc[:1], "routes": [len(frame)], "status": [status], "error": [why]})

    r = T.stops(spark, d).groupBy("route_id").agg(F.sum("load").alias("load")).withColumn("zone", F.col("route_id") % 50)
    return r.groupBy("zone").applyInPandas(run, "zone bigint, routes bigint, status string, error string")


@query("SELECT stage, count(*) AS runs, round(sum(seconds),6) AS seconds, round(sum(seconds)*100/(SELECT sum(o_totalprice) FROM orders),6) AS share, row_number() OVER (ORDER BY sum(seconds) DESC, stage) AS place FROM (SELECT o_orderpriority AS stage, o_totalprice AS seconds FROM orders) GROUP BY 1")
def stage_profile(spark, d):
    """Time spent by stage, the longest first, with its share."""
    g = T.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("runs"), F.sum("o_totalprice").alias("s"))
    total = g.agg(F.sum("s").alias("t"))
    both = g.join(F.broadcast(total))  # one row
    place = F.row_number().over(Window.orderBy(F.desc("s"), "stage"))  # a row for each stage
    return both.select("stage", "runs", F.round("s", 6).alias("seconds"), F.round(F.col("s") * 100 / F.col("t"), 6).alias("share"), place.alias("place"))


@query("SELECT model, leg, profile, model IN ('M3','M4') AS last_metre, TRUE AS in_all FROM (VALUES ('M1','direct_delivery','driving'),('M2','direct_delivery','driving'),('M3','cycling_last_mile','cycling'),('M4','walking_last_mile','walking'),('M5','customer_collection','walking')) x(model, leg, profile)")
def model_scope(spark, d):
    """Models to which a setting applies: those it names; with an empty list, all."""
    from lastleg.matrix_queries import LEGS

    m = spark.createDataFrame(LEGS, "model string, leg string, profile string")
    return m.select("*", matrices.applies(F.col("model"), ["M3", "M4"]).alias("last_metre"), matrices.applies(F.col("model"), []).alias("in_all"))


# -- checks of tables ----------------------------------------------------------------------


@query("SELECT o_orderkey AS customer_id, o_totalprice AS demand, 'low' AS scenario FROM orders WHERE o_orderkey%4>0")
def demand_checked(spark, d):
    """Demand renamed and coerced: rows without a number go, one that is not positive or of another scenario is an error."""
    raw = F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), raw.alias("Demand"), F.lit("low").alias("Scenario"))
    return matrices.checked_demand(o, {"ID": "customer_id", "Demand": "demand", "Scenario": "scenario"}, scenario="low")


@query("SELECT facility_id, code, lat, lon FROM fac WHERE code IN (1,2,3,7) AND facility_id%6>0", "fac")
def facility_candidates(spark, d):
    """Facilities of the allowed services whose coordinates are valid."""
    f = T.facilities(spark, d).withColumn("lat", F.when(F.col("facility_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("lat")))
    return matrices.candidates(f, [1, 2, 3, 7]).select("facility_id", "code", "lat", "lon")


@query("SELECT customer_id, section, demand, NULL::VARCHAR AS note FROM cust WHERE section IN (1,3,5) AND demand>=2", "cust")
def audit_rows(spark, d):
    """Rows of an audit: chosen sections, an availability flag given as text, at least a distance; absent columns come as null."""
    c = T.customers(spark, d).withColumn("available", F.when(F.col("demand") >= 2, " Yes ").otherwise("no"))
    kept = c.where(F.col("section").isin(1, 3, 5) & matrices.is_true(F.col("available")))
    return matrices.projected(kept, {"customer_id": "bigint", "section": "int", "demand": "bigint", "note": "string"})


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey%4=0 THEN 'missing address' ELSE 'ok' END AS flag, 'candidate' AS source FROM supplier WHERE s_acctbal>0")
def import_candidates(spark, d):
    """Candidates to import, with a flag for those without an address."""
    s = T.table(spark, d, "supplier").where("s_acctbal > 0").withColumn("address", F.when(F.col("s_suppkey") % 4 == 0, "  ").otherwise("street"))
    flag = F.when(F.trim(F.coalesce("address", F.lit(""))) == "", "missing address").otherwise("ok")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), flag.alias("flag"), F.lit("candidate").alias("source"))
