"""More of the catalogue: matrices, audits, snapping, supply-driven plans, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastleg.functions import projection, text
from lastleg.operators import profile
from lastleg.queries import _AUDIT, _CELLS, _ORDERED, _VALID, _audit, _positions, query
from lastleg.sources import tables as T

# -- matrices -----------------------------------------------------------------

_MATRIX = "mx AS (SELECT line::BIGINT AS o, customer_id%20 AS d, round(avg(minutes),6) AS minutes FROM st GROUP BY 1, 2)"


def _matrix(spark, d) -> DataFrame:
    s = T.stops(spark, d).groupBy(F.col("line").cast("bigint").alias("o"), (F.col("customer_id") % 20).alias("d"))
    return s.agg(F.round(F.avg("minutes"), 6).alias("minutes"))


@query(f"WITH {_MATRIX} SELECT o, d, CASE WHEN o=d THEN 0.0 ELSE round(minutes*1.2::DOUBLE,6) END::DOUBLE AS minutes FROM mx", "st")
def matrix_traffic(spark, d):
    """A static multiplier on every arc; the diagonal is zero."""
    return _matrix(spark, d).select("o", "d", F.when(F.col("o") == F.col("d"), 0.0).otherwise(F.round(F.col("minutes") * 1.2, 6)).alias("minutes"))


@query(f"WITH {_MATRIX} SELECT o, d, round(minutes + CASE WHEN d=0 OR o=d THEN 0.0 ELSE (d*7%90)*2/1000.0::DOUBLE/5*60 END,6) AS minutes FROM mx", "st")
def matrix_last_metre(spark, d):
    """The way from the road to a point is added to every arc into it, but not into the depot (0)."""
    access = (F.col("d") * 7 % 90) * 2 / 1000.0 / 5 * 60
    return _matrix(spark, d).select("o", "d", F.round(F.col("minutes") + F.when((F.col("d") == 0) | (F.col("o") == F.col("d")), 0.0).otherwise(access), 6).alias("minutes"))


@query(
    f"""WITH {_CELLS}, c AS (SELECT problem_id, point, count(*) FILTER (bad) AS invalid FROM ends GROUP BY 1, 2), g AS (SELECT problem_id, point FROM c JOIN n USING (problem_id) WHERE point<>0 AND invalid >= greatest(10, floor(0.25*n)))
SELECT problem_id, count(*) AS cells, count(*) FILTER (bad) AS invalid_left, count(*) FILTER (bad) > 0 AS failed FROM cells WHERE NOT EXISTS (FROM g WHERE g.problem_id=cells.problem_id AND g.point IN (o, d)) GROUP BY 1""",
    "st",
)
def matrix_without_excluded(spark, d):
    """The cells that are left when the points with too many invalid cells are gone; invalid ones among them fail the problem."""
    cells = T.stops(spark, d).select(F.col("facility_id").alias("problem_id"), F.col("line").cast("bigint").alias("o"), (F.col("customer_id") % 20).alias("d"), (F.col("load") > 45).alias("bad"))
    points = cells.select("problem_id", F.explode(F.array("o", "d")).alias("point"), "bad").groupBy("problem_id", "point").agg(F.count(F.when(F.col("bad"), 1)).alias("invalid"))
    n = F.count("*").over(Window.partitionBy("problem_id"))
    gone = points.withColumn("most", F.greatest(F.lit(10), F.floor(n * F.lit(0.25)))).where((F.col("point") != 0) & (F.col("invalid") >= F.col("most"))).select("problem_id", "point")
    left = cells.join(gone.withColumnRenamed("point", "o"), ["problem_id", "o"], "left_anti").join(gone.withColumnRenamed("point", "d"), ["problem_id", "d"], "left_anti")
    bad = F.count(F.when(F.col("bad"), 1))
    return left.groupBy("problem_id").agg(F.count("*").alias("cells"), bad.alias("invalid_left"), (bad > 0).alias("failed"))


@query(
    f"""WITH {_ORDERED}, {_MATRIX}, p AS (SELECT route_id, position, line::BIGINT AS a, customer_id%20 AS b FROM o)
SELECT route_id, count(*) AS arcs, count(mx.minutes) AS found, round(sum(coalesce(mx.minutes,0)),6) AS minutes FROM p LEFT JOIN mx ON mx.o=a AND mx.d=b GROUP BY 1""",
    "st",
)
def route_matrix_cost(spark, d):
    """Each arc of a route looked up in the matrix; the matrix has at most 7 x 20 cells by its keys, so its side is small."""
    arcs = _positions(spark, d).select("route_id", F.col("line").cast("bigint").alias("o"), (F.col("customer_id") % 20).alias("d"))
    return arcs.join(_matrix(spark, d), ["o", "d"], "left").groupBy("route_id").agg(F.count("*").alias("arcs"), F.count("minutes").alias("found"), F.round(F.sum(F.coalesce("minutes", F.lit(0.0))), 6).alias("minutes"))


@query("SELECT section, count(*) AS customers, round(sum(abs(lat-41.405)+abs(lon-2.175)),6) AS one_way, round(sum(demand*2*(abs(lat-41.405)+abs(lon-2.175))),6) AS round_trips FROM cust GROUP BY 1", "cust")
def radial_round_trips(spark, d):
    """Ways from the depot to every customer, once and there and back for each package."""
    way = F.abs(F.col("lat") - 41.405) + F.abs(F.col("lon") - 2.175)
    return T.customers(spark, d).groupBy("section").agg(F.count("*").alias("customers"), F.round(F.sum(way), 6).alias("one_way"), F.round(F.sum(F.col("demand") * 2 * way), 6).alias("round_trips"))


# -- snapping -----------------------------------------------------------------

# Audited pairs of model and leg, with the profile that serves them.
LEGS = [("M1", "direct_delivery", "driving"), ("M2", "direct_delivery", "driving"), ("M3", "cycling_last_mile", "cycling"), ("M4", "walking_last_mile", "walking"), ("M5", "customer_collection", "walking")]
_LEGS = "legs(model, leg, profile) AS (VALUES " + ", ".join(str(x) for x in LEGS) + ")"
_SNAP = f"{_LEGS}, snap AS (SELECT CASE s_suppkey%3 WHEN 0 THEN 'driving' WHEN 1 THEN 'cycling' ELSE 'walking' END AS profile, round(41.38 + ((s_suppkey*6007)%1000)::DOUBLE/20000.0::DOUBLE,6) AS lat, round(s_acctbal%90,3) AS snap_m FROM supplier), near AS (SELECT profile, lat, min(snap_m) AS snap_m FROM snap GROUP BY 1, 2), sn AS (SELECT model, leg, legs.profile, customer_id, snap_m FROM cust, legs LEFT JOIN near ON near.profile=legs.profile AND near.lat=round(cust.lat,6))"


def _snaps(spark, d) -> DataFrame:
    c = T.customers(spark, d).select("customer_id", F.round("lat", 6).alias("lat"), F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(leg).alias("leg"), F.lit(p).alias("profile")) for m, leg, p in LEGS))).alias("x"))
    s = T.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "driving").when(F.col("s_suppkey") % 3 == 1, "cycling").otherwise("walking").alias("profile"), F.round(T._spread("s_suppkey", 6007, 41.38), 6).alias("lat"), F.round(F.col("s_acctbal") % 90, 3).alias("snap_m"))
    near = s.groupBy("profile", "lat").agg(F.min("snap_m").alias("snap_m"))
    return c.select("x.*", "customer_id", "lat").join(near, ["profile", "lat"], "left").select("model", "leg", "profile", "customer_id", "snap_m")


@query(f"WITH {_SNAP} SELECT * FROM sn", "cust")
def snap_audit(spark, d):
    """Every model's leg to every customer, with the recorded way from its place to the network; null where there is none."""
    return _snaps(spark, d)


@query(f"WITH {_SNAP} SELECT model, profile, count(*) AS n, count(snap_m) AS known, round(median(snap_m),6) AS median_m, round(avg(snap_m),6) AS mean_m, max(snap_m) AS most_m FROM sn GROUP BY 1, 2", "cust")
def snap_summary(spark, d):
    return _snaps(spark, d).groupBy("model", "profile").agg(F.count("*").alias("n"), F.count("snap_m").alias("known"), F.round(F.median("snap_m"), 6).alias("median_m"), F.round(F.avg("snap_m"), 6).alias("mean_m"), F.max("snap_m").alias("most_m"))


# -- supply-driven plans and deadlines ----------------------------------------

_SUPPLY = "visits AS (SELECT facility_id, max(540.0::DOUBLE + minutes + 5) AS available FROM st WHERE line=1 GROUP BY 1), legs AS (SELECT facility_id, route_id, sum(minutes) AS minutes, count(*) AS stops FROM st WHERE line>1 GROUP BY 1, 2)"


@query(f"WITH {_SUPPLY} SELECT facility_id, route_id, available AS starts, round(available+10+minutes+5*stops,6) AS ends, available+10+minutes+5*stops<=575 AS feasible FROM legs LEFT JOIN visits USING (facility_id)", "st")
def supply_driven_start(spark, d):
    """Last-mile routes start when the last supply visit of their facility is served; without supply their times are null."""
    s = T.stops(spark, d)
    visits = s.where("line = 1").groupBy("facility_id").agg(F.max(540.0 + F.col("minutes") + 5).alias("starts"))
    legs = s.where("line > 1").groupBy("facility_id", "route_id").agg(F.sum("minutes").alias("minutes"), F.count("*").alias("stops"))
    ends = F.col("starts") + 10 + F.col("minutes") + 5 * F.col("stops")
    return legs.join(visits, "facility_id", "left").select("facility_id", "route_id", "starts", F.round(ends, 6).alias("ends"), (ends <= 575).alias("feasible"))


_DEADLINES = "e AS (SELECT facility_id, route_id, CASE WHEN route_id%11=0 THEN NULL ELSE 550 + sum(minutes) + 5*count(*) END AS finish, CASE WHEN facility_id%4=0 THEN NULL ELSE 570 END AS deadline FROM st GROUP BY 1, 2)"


@query(f"WITH {_DEADLINES} SELECT facility_id, count(*) AS routes, count(finish) AS timed, CASE WHEN max(deadline) IS NOT NULL THEN count(*) FILTER (finish > deadline) END::DOUBLE AS late, CASE WHEN max(deadline) IS NULL OR count(finish)<count(*) THEN 'undefined' WHEN max(finish)<=max(deadline) THEN 'yes' ELSE 'no' END AS feasible FROM e GROUP BY 1", "st")
def deadline_feasibility(spark, d):
    """Undefined where a facility has no deadline, or where one of its routes has no time."""
    e = T.stops(spark, d).groupBy("facility_id", "route_id").agg(F.sum("minutes").alias("m"), F.count("*").alias("n"))
    e = e.select("facility_id", F.when(F.col("route_id") % 11 != 0, 550 + F.col("m") + 5 * F.col("n")).alias("finish"), F.when(F.col("facility_id") % 4 != 0, 570).alias("deadline"))
    g = e.groupBy("facility_id").agg(F.count("*").alias("routes"), F.count("finish").alias("timed"), F.count(F.when(F.col("finish") > F.col("deadline"), 1)).alias("n_late"), F.max("finish").alias("last"), F.max("deadline").alias("deadline"))
    has = F.col("deadline").isNotNull()
    return g.select("facility_id", "routes", "timed", F.when(has, F.col("n_late")).cast("double").alias("late"), F.when(~has | (F.col("timed") < F.col("routes")), "undefined").when(F.col("last") <= F.col("deadline"), "yes").otherwise("no").alias("feasible"))


@query(f"WITH {_ORDERED} SELECT route_id, position, round(550 + sum(minutes) OVER (PARTITION BY route_id ORDER BY position) + 5*(position-1),6) AS arrival FROM o", "st")
def static_offsets(spark, d):
    """Arrival times without traffic: minutes so far, and five for each stop before."""
    w = Window.partitionBy("route_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return _positions(spark, d).select("route_id", "position", F.round(550 + F.sum("minutes").over(w) + 5 * (F.col("position") - 1), 6).alias("arrival"))


# -- audits -------------------------------------------------------------------


@query(
    f"""WITH {_AUDIT}, s AS (SELECT count(*) AS customers, count(*) FILTER (status<>'unroutable') AS routable, count(*) FILTER (status='unassigned') AS missing, count(*) FILTER (status='duplicated') AS duplicated, coalesce(sum(1+id%5),0)::BIGINT AS packages,
coalesce(sum(1+id%5) FILTER (status<>'unroutable'),0)::BIGINT AS routable_packages, coalesce(sum((1+id%5)*n) FILTER (status<>'unroutable'),0)::BIGINT AS routed_packages FROM a), u AS (SELECT count(DISTINCT o_custkey) AS unexpected FROM orders ANTI JOIN customer ON c_custkey=o_custkey)
SELECT *, missing+duplicated+unexpected=0 AS customers_ok, routable_packages=routed_packages AND duplicated+unexpected=0 AS packages_ok, CASE WHEN missing+duplicated+unexpected=0 AND routable_packages=routed_packages THEN 'OK' ELSE 'WARNING' END AS status FROM s, u"""
)
def integrity_summary(spark, d):
    """One row: what the plan was given, what it serves, and whether both agree."""
    demand, served = 1 + F.col("id") % 5, F.col("status") != "unroutable"
    number = lambda c: F.count(F.when(c, 1))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    s = _audit(spark, d).agg(F.count("*").alias("customers"), number(served).alias("routable"), number(F.col("status") == "unassigned").alias("missing"), number(F.col("status") == "duplicated").alias("duplicated"), total(demand).alias("packages"), total(F.when(served, demand)).alias("routable_packages"), total(F.when(served, demand * F.col("n"))).alias("routed_packages"))
    strange = T.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(T.table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_anti").agg(F.countDistinct("c_custkey").alias("unexpected"))
    both = s.join(F.broadcast(strange))  # two single rows
    wrong, balanced = F.col("duplicated") + F.col("unexpected"), F.col("routable_packages") == F.col("routed_packages")
    fine = F.col("missing") + wrong == 0
    return both.select("*", fine.alias("customers_ok"), (balanced & (wrong == 0)).alias("packages_ok"), F.when(fine & balanced, "OK").otherwise("WARNING").alias("status"))


@query("SELECT (SELECT count(*) FROM customer ANTI JOIN (SELECT s_nationkey AS c_nationkey FROM supplier WHERE s_nationkey%3>0) USING (c_nationkey)) AS without_population, (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey%3>0 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey%2=0)) AS without_address")
def population_unmatched(spark, d):
    """How many rows of either side of a join have no partner."""
    c = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = T.table(spark, d, "supplier").where("s_nationkey % 3 > 0").select(F.col("s_nationkey").alias("k")).distinct()
    left = c.join(s, "k", "left_anti").agg(F.count("*").alias("without_population"))
    right = s.join(c.where("k % 2 = 0"), "k", "left_anti").agg(F.count("*").alias("without_address"))
    return left.join(F.broadcast(right))  # two single rows


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_rows(spark, d):
    from lastleg.sources.files import latest

    return latest(T.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(f"WITH {_VALID} SELECT weekday::INT AS weekday, slot, quantile_disc(intensity,0.25) AS p25, quantile_disc(intensity,0.5) AS p50, quantile_disc(intensity,0.75) AS p75 FROM v GROUP BY 1, 2", "rd")
def profile_nearest_rank(spark, d):
    """Nearest-rank quantiles of each weekday and slot."""
    v = profile.valid_readings(T.readings(spark, d))
    return v.groupBy("weekday", "slot").agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY intensity)").cast("bigint").alias(f"p{p}") for p in (25, 50, 75)))


# -- parsing and projection ---------------------------------------------------

_CHUNKS = [f"('0x'||substr(md5(c_name),{1 + 8 * k},8))::BIGINT" for k in range(4)]


@query(f"SELECT c_custkey, ((((({_CHUNKS[0]}%360)*256+{_CHUNKS[1]})%360)*256+{_CHUNKS[2]})%360*256+{_CHUNKS[3]})%360 AS hue FROM customer")
def route_colour(spark, d):
    """A hue in degrees: the 128-bit md5 modulo 360, folded in 32-bit steps."""
    hue = F.lit(0).cast("bigint")
    for k in range(4):
        hue = (hue * 256 + F.conv(F.substring(F.md5("c_name"), 1 + 8 * k, 8), 16, 10).cast("bigint")) % 360
    return T.table(spark, d, "customer").select("c_custkey", hue.alias("hue"))


_EXPERIMENT = "c_mktsegment || '_' || CASE c_custkey%4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'none' END || '_' || (c_custkey%7*100) || '_x'"


@query(f"SELECT c_custkey, nullif(regexp_extract({_EXPERIMENT}, '_(low|medium|high)_(\\d+)_', 1),'') AS scenario, coalesce(try_cast(regexp_extract({_EXPERIMENT}, '_(low|medium|high)_(\\d+)_', 2) AS INT),0) AS size FROM customer")
def experiment_id_parse(spark, d):
    name, pattern = F.expr(_EXPERIMENT), r"_(low|medium|high)_(\d+)_"
    return T.table(spark, d, "customer").select("c_custkey", F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("scenario"), F.coalesce(F.regexp_extract(name, pattern, 2).try_cast("int"), F.lit(0)).alias("size"))


# Words of a facility's type and its service code.
TYPES = {"LOCKER": 1, "LOCKERS": 1, "LSP PUDO": 2, "LSP PUDOS": 2, "PUDO": 2, "PUDOS": 2, "CLICK COLLECT": 3, "CENTRO DE DISTRIBUCION RECEPCION": 4, "CENTROS DE DISTRIBUCION RECEPCION": 4, "ESTACION LOGISTICA DE ULTIMA MILLA": 5, "ALMACEN E FULFILMENT": 6, "CONVENIENCE STORE": 7, "CONVENIENCE STORES": 7}
_RAW = ["Locker", " lsp-pudo ", "Click & Collect", "Centro de Distribución / Recepción", "Estación logística de última milla", "Almacén e-fulfilment", "Convenience stores", "Otro", ""]
_RAW_SQL = "list_extract([" + ", ".join(f"'{x}'" for x in _RAW) + "], (s_suppkey%9+1)::INT)"


@query(f"SELECT s_suppkey, coalesce(MAP {{{', '.join(f"'{k}': {v}" for k, v in TYPES.items())}}}[trim(regexp_replace(translate(upper({_RAW_SQL}),'{text.ACCENTED}','{text.PLAIN}'),'[^A-Z0-9]+',' ','g'))],0)::INT AS code FROM supplier")
def record_type(spark, d):
    """Service codes from free text; what is unknown is 0."""
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("s_suppkey") % 9 + 1).cast("int"))
    codes = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return T.table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.try_element_at(codes, text.normalize_text(raw)), F.lit(0)).alias("code"))


_EAST, _NORTH = projection.to_utm("lat", "lon", 31)
_BACK = projection.from_utm("east", "north", 31)


@query(f"SELECT customer_id, round(east,3) AS east, round(north,3) AS north, round({_BACK[0]},7) AS lat, round({_BACK[1]},7) AS lon FROM (SELECT customer_id, {_EAST} AS east, {_NORTH} AS north FROM cust)", "cust")
def reproject_utm(spark, d):
    """Degrees to UTM zone 31 and back."""
    flat = T.customers(spark, d).select("customer_id", F.expr(_EAST).alias("east"), F.expr(_NORTH).alias("north"))
    return flat.select("customer_id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(F.expr(_BACK[0]), 7).alias("lat"), F.round(F.expr(_BACK[1]), 7).alias("lon"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, round(epoch(ts - date_trunc('day', ts))/60,3) AS minutes_of_day, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M') AS later FROM events")
def iso_minutes(spark, d):
    iso = "yyyy-MM-dd'T'HH:mm"
    since = F.expr("timestampdiff(MICROSECOND, date_trunc('day', ts), ts)") / 60e6
    return T.table(spark, d, "events").select("event_id", F.date_format("ts", iso).alias("minute"), F.round(since, 3).alias("minutes_of_day"), F.date_format(F.col("ts") + F.expr("INTERVAL 90 MINUTES"), iso).alias("later"))
