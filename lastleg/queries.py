"""Catalogue of the engine's queries over the driver's tables, with DuckDB SQL for each where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastleg.functions import clock, cost, geo, text
from lastleg.operators import assignment, profile, resolution, routing, spatial
from lastleg.plans import models
from lastleg.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name; ``views`` names the derived views that its SQL uses."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(T.SQL[v] for v in views.split())
            body = sql.strip()
            _SQL[f.__name__] = f"WITH {head}, {body[5:]}" if head and body.startswith("WITH ") else f"WITH {head} {body}" if head else body
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five delivery models side by side."""
    return models_compare(spark, sf_dir)


# -- traffic profiles ---------------------------------------------------------

_VALID = "v AS (SELECT *, isodow(ts)-1 AS weekday, (hour(ts)*60 + (minute(ts)//15)*15)::INT AS slot FROM rd WHERE read_error='N' AND intensity>=0 AND occupancy>=0 AND hour(ts) BETWEEN 7 AND 20)"


@query(f"WITH {_VALID} SELECT weekday::INT AS weekday, slot, count(*) AS n, round(avg(intensity),6) AS mean_intensity, round(quantile_cont(intensity,0.25),6) AS p25, round(quantile_cont(intensity,0.5),6) AS p50, round(quantile_cont(intensity,0.75),6) AS p75, count(*) FILTER (speed>=5) AS n_speed, round(avg(speed) FILTER (speed>=5),6) AS mean_speed FROM v GROUP BY 1, 2", "rd")
def profile_15min(spark, d):
    return profile.profile(profile.valid_readings(T.readings(spark, d)))


@query(f"WITH {_VALID}, c AS (SELECT weekday, intensity, count(*) AS n FROM v GROUP BY 1,2), r AS (SELECT *, sum(n) OVER (PARTITION BY weekday ORDER BY intensity) AS upto, sum(n) OVER (PARTITION BY weekday) AS total FROM c) SELECT weekday::INT AS weekday, max(total)::BIGINT AS total, min(intensity) FILTER (upto>=total*0.25) AS q25, min(intensity) FILTER (upto>=total*0.5) AS q50, min(intensity) FILTER (upto>=total*0.75) AS q75 FROM r GROUP BY 1", "rd")
def profile_quantiles_cumfreq(spark, d):
    return profile.frequency_quantiles(profile.valid_readings(T.readings(spark, d)))


@query(f"WITH {_VALID}, p AS (SELECT sensor_id, ts::DATE AS day, count(*) AS n, sum(intensity) AS s FROM v GROUP BY 1,2) SELECT sensor_id, count(*) AS days, sum(n)::BIGINT AS n, round(sum(s)/sum(n),6) AS mean_intensity FROM p GROUP BY 1", "rd")
def profile_partial_final(spark, d):
    return profile.two_step_means(profile.valid_readings(T.readings(spark, d)))


@query(f"WITH {_VALID} SELECT count(*) AS n, count(DISTINCT sensor_id) AS sensors, count(DISTINCT (weekday, slot)) AS slots, min(intensity) AS least, max(intensity) AS most FROM v", "rd")
def profile_summary(spark, d):
    v = profile.valid_readings(T.readings(spark, d))
    return v.agg(F.count("*").alias("n"), F.countDistinct("sensor_id").alias("sensors"), F.countDistinct("weekday", "slot").alias("slots"), F.min("intensity").alias("least"), F.max("intensity").alias("most"))


@query("SELECT read_error, hour(ts) BETWEEN 7 AND 20 AS in_hours, count(*) AS n, count(*) FILTER (speed < 5) AS slow FROM rd GROUP BY 1, 2", "rd")
def sensor_quality_filter(spark, d):
    r = T.readings(spark, d)
    return r.groupBy("read_error", F.hour("ts").between(7, 20).alias("in_hours")).agg(F.count("*").alias("n"), F.count(F.when(F.col("speed") < 5, 1)).alias("slow"))


# Interval table of time-dependent multipliers (profile, zone, days, start, end, multiplier).
_INTERVALS = [("driving", "all", "weekday", "07:00", "09:30", 1.4), ("driving", "all", "weekday", "17:00", "20:00", 1.5), ("driving", "all", "all", "00:00", "00:00", 1.0), ("driving", "all", "weekend", "11:00", "14:00", 1.2), ("driving", "zone_0", "all", "20:00", "06:00", 0.9), ("driving", "zone_0", "monday", "08:00", "09:00", 1.7)]
_INTERVAL_VALUES = ", ".join(f"({k}, '{p}', '{z}', '{w}', '{s}', '{e}', {m}::DOUBLE)" for k, (p, z, w, s, e, m) in enumerate(_INTERVALS))


@query(
    f"""WITH iv(pos, profile, zone, days, s, e, mult) AS (VALUES {_INTERVAL_VALUES}),
t AS (SELECT *, split_part(s,':',1)::INT*60+split_part(s,':',2)::INT AS a, split_part(e,':',1)::INT*60+split_part(e,':',2)::INT AS b FROM iv),
x AS (SELECT event_id, 'zone_' || (sensor_id % 3) AS z, lower(dayname(ts)) AS day, isodow(ts) >= 6 AS weekend, hour(ts)*60+minute(ts) AS m FROM rd),
j AS (SELECT event_id, mult, pos, (zone = z)::INT AS zm, CASE WHEN days = day THEN 3 WHEN days = 'weekend' AND weekend OR days = 'weekday' AND NOT weekend THEN 2 WHEN days = 'all' THEN 1 END AS dp
 FROM x JOIN t ON zone IN (z, 'all') AND CASE WHEN a = b THEN true WHEN a < b THEN m >= a AND m < b ELSE m >= a OR m < b END),
r AS (SELECT event_id, mult, row_number() OVER (PARTITION BY event_id ORDER BY zm DESC, dp DESC, pos) AS k FROM j WHERE dp IS NOT NULL)
SELECT x.event_id, coalesce(mult, 1.0)::DOUBLE AS multiplier FROM x LEFT JOIN r ON r.event_id = x.event_id AND k = 1""",
    "rd",
)
def traffic_interval_priority(spark, d):
    """The best interval of each reading, taken from a short literal list: no join and no shuffle."""
    iv = [(z, w, clock.minutes(a), clock.minutes(b), m) for _, z, w, a, b, m in _INTERVALS]
    zone, day, m = F.concat(F.lit("zone_"), F.col("sensor_id") % 3), F.lower(F.date_format("ts", "EEEE")), clock.minute_of_day(F.col("ts"))
    x = T.readings(spark, d).select("event_id", zone.alias("z"), day.alias("day"), (F.weekday("ts") >= 5).alias("weekend"), m.alias("m"))
    ranks = []
    for pos, (z, w, a, b, mult) in enumerate(iv):
        matched = F.lit(0) if z == "all" else F.lit(1)
        fits = clock.in_interval(F.col("m"), F.lit(a), F.lit(b)) & (F.lit(True) if z == "all" else F.col("z") == z)
        priority = F.when(F.col("day") == w, 3).when((F.lit(w) == "weekend") & F.col("weekend") | (F.lit(w) == "weekday") & ~F.col("weekend"), 2).when(F.lit(w) == "all", 1)
        ranks.append(F.when(fits & priority.isNotNull(), F.struct(matched.alias("zm"), priority.alias("dp"), F.lit(-pos).alias("p"), F.lit(mult).alias("mult"))))
    return x.select("event_id", F.coalesce(F.array_max(F.array(*ranks))["mult"], F.lit(1.0)).alias("multiplier"))


# -- spatial ------------------------------------------------------------------

# Rings of (lon, lat) corners; zone_b is concave and overlaps zone_a.
ZONES = {"zone_a": [(2.15, 41.38), (2.18, 41.38), (2.18, 41.41), (2.15, 41.41)], "zone_b": [(2.17, 41.39), (2.2, 41.39), (2.2, 41.43), (2.185, 41.405), (2.17, 41.43)], "zone_c": [(2.16, 41.41), (2.17, 41.43), (2.15, 41.43)]}
_ZONE_UNION = " UNION ALL ".join(f"SELECT *, '{z}' AS zone FROM cust WHERE {geo.in_ring_sql('lat', 'lon', ring)}" for z, ring in ZONES.items())


@query(f"SELECT customer_id, zone FROM ({_ZONE_UNION})", "cust")
def zone_points_contains(spark, d):
    return spatial.zone_of_points(T.customers(spark, d), ZONES).select("customer_id", "zone")


@query(f"SELECT c.customer_id, coalesce(z, 'outside') AS zone FROM cust c LEFT JOIN (SELECT customer_id, min(zone) AS z FROM ({_ZONE_UNION}) GROUP BY 1) USING (customer_id)", "cust")
def zone_attach_first(spark, d):
    c = T.customers(spark, d)
    first = F.coalesce(*(F.when(geo.in_ring(F.col("lat"), F.col("lon"), ring), F.lit(z)) for z, ring in sorted(ZONES.items())), F.lit("outside"))
    return c.select("customer_id", first.alias("zone"))


@query(f"SELECT a.zone AS zone_1, b.zone AS zone_2, count(*) AS shared FROM ({_ZONE_UNION}) a JOIN ({_ZONE_UNION}) b ON a.customer_id=b.customer_id AND a.zone<b.zone GROUP BY 1, 2", "cust")
def zone_overlap(spark, d):
    z = spatial.zone_of_points(T.customers(spark, d), ZONES).groupBy("customer_id").agg(F.sort_array(F.collect_set("zone")).alias("zs"))
    pairs = F.expr("flatten(transform(zs, (x, i) -> transform(slice(zs, i + 2, size(zs)), y -> struct(x as zone_1, y as zone_2))))")
    return z.select(F.explode(pairs).alias("p")).groupBy("p.zone_1", "p.zone_2").agg(F.count("*").alias("shared"))


@query(f"SELECT a.facility_id AS id_1, b.facility_id AS id_2, round({geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')},3) AS distance_m FROM fac a JOIN fac b ON a.facility_id<b.facility_id WHERE {geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500", "fac")
def pairs_within_radius(spark, d):
    p = spatial.pairs_within(T.facilities(spark, d), "facility_id", 500.0)
    return p.select(F.col("facility_id_1").alias("id_1"), F.col("facility_id_2").alias("id_2"), F.round("distance_m", 3).alias("distance_m"))


_NEAR = f"r AS (SELECT c.customer_id, f.facility_id, round({geo.haversine_sql('c.lat', 'c.lon', 'f.lat', 'f.lon')},3) AS distance_m, c.demand FROM cust c, fac f), n AS (SELECT customer_id, min({{'d': distance_m, 'i': facility_id}}) AS b FROM r GROUP BY 1)"


@query(f"WITH {_NEAR} SELECT customer_id, b.i AS facility_id, b.d AS distance_m FROM n", "cust fac")
def nearest_facility(spark, d):
    return spatial.nearest(T.customers(spark, d), T.facilities(spark, d), "customer_id", "facility_id")


@query(f"SELECT a.facility_id, b.facility_id AS other_id, round(min({geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}),3) AS distance_m FROM fac a JOIN fac b ON a.company=b.company AND a.facility_id<>b.facility_id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.facility_id ORDER BY distance_m, b.facility_id)=1", "fac")
def nearest_same_company(spark, d):
    f = T.facilities(spark, d)
    return spatial.nearest(f, f, "facility_id", "facility_id", by=("company",), other=True)


@query(f"WITH {_NEAR} SELECT b.i AS facility_id, count(*) AS customers, sum(demand)::BIGINT AS packages, round(max(b.d),3) AS farthest_m FROM n JOIN cust USING (customer_id) GROUP BY 1", "cust fac")
def assign_unlimited(spark, d):
    c = T.customers(spark, d)
    n = spatial.nearest(c, T.facilities(spark, d), "customer_id", "facility_id", carry=("demand",))
    return n.groupBy("facility_id").agg(F.count("*").alias("customers"), F.sum("demand").alias("packages"), F.round(F.max("distance_m"), 3).alias("farthest_m"))


@query(f"WITH q AS (SELECT facility_id, {geo.haversine_sql('41.405::DOUBLE', '2.175::DOUBLE', 'lat', 'lon')} AS m FROM fac), k AS (SELECT facility_id, m, row_number() OVER (ORDER BY m, facility_id) AS n FROM q WHERE m<=5000), r AS (SELECT least(5000.0, 500.0+500.0*greatest(0, ceil((coalesce((SELECT m FROM k WHERE n=5),5000.0)-500)/500)))::DOUBLE AS radius_m) SELECT facility_id, round(m,3) AS distance_m, radius_m FROM k, r WHERE m<=radius_m", "fac")
def facility_buffer_adaptive(spark, d):
    near = spatial.adaptive_buffer(T.facilities(spark, d), 41.405, 2.175, 500.0, 500.0, 5000.0, 5)
    return near.select("facility_id", F.round("distance_m", 3).alias("distance_m"), "radius_m")


@query("SELECT section, sum(demand)::BIGINT AS packages, round(sum(lat*demand)/sum(demand),6) AS lat, round(sum(lon*demand)/sum(demand),6) AS lon FROM cust GROUP BY 1", "cust")
def weighted_centroid(spark, d):
    c = T.customers(spark, d)
    weighted = [F.round(F.sum(F.col(x) * F.col("demand")) / F.sum("demand"), 6).alias(x) for x in ("lat", "lon")]
    return c.groupBy("section").agg(F.sum("demand").alias("packages"), *weighted)


# -- demand -------------------------------------------------------------------


@query("SELECT customer_id, section, count(*) OVER (PARTITION BY section) AS addresses, round((section+1)*100.0::DOUBLE/count(*) OVER (PARTITION BY section),6) AS weight FROM cust", "cust")
def population_weights(spark, d):
    n = F.count("*").over(Window.partitionBy("section"))
    return T.customers(spark, d).select("customer_id", "section", n.alias("addresses"), F.round((F.col("section") + 1) * 100.0 / n, 6).alias("weight"))


def _uniform(key, seed: int):
    """Uniform in (0, 1) from the first 52 bits of an md5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


_UNIFORM = "((('0x'||substr(md5('{seed}:'||customer_id),1,13))::BIGINT + 0.5::DOUBLE)/4503599627370496.0::DOUBLE)"


@query(f"SELECT customer_id, row_number() OVER (ORDER BY round(-ln({_UNIFORM.format(seed=7)})/(section+1),12), customer_id)-1 AS position FROM cust QUALIFY position < 100", "cust")
def sample_weighted(spark, d):
    """Weighted sampling without replacement: the least of -ln(u) / w."""
    c = T.customers(spark, d).select("customer_id", F.round(-F.log(_uniform(F.col("customer_id"), 7)) / (F.col("section") + 1), 12).alias("k")).orderBy("k", "customer_id").limit(100)
    return c.select("customer_id", (F.row_number().over(Window.orderBy("k", "customer_id")) - 1).alias("position"))


@query("SELECT customer_id, s.scenario, s.low + floor(" + _UNIFORM.format(seed=11) + "*(s.high-s.low+1))::BIGINT AS demand FROM cust, (VALUES ('low',1,2),('medium',2,5),('high',5,10)) s(scenario,low,high)", "cust")
def demand_assign(spark, d):
    s = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, a, b in (("low", 1, 2), ("medium", 2, 5), ("high", 5, 10)))))
    x = T.customers(spark, d).withColumn("s", s)
    return x.select("customer_id", "s.scenario", (F.col("s.low") + F.floor(_uniform(F.col("customer_id"), 11) * (F.col("s.high") - F.col("s.low") + 1))).alias("demand"))


@query("WITH o AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id)-1 AS p FROM cust), n(size) AS (VALUES (100),(500),(1000)) SELECT size, count(*) AS customers, max(customer_id) AS last_id FROM o, n WHERE p < size GROUP BY 1", "cust")
def nested_prefix(spark, d):
    o = T.customers(spark, d).orderBy("customer_id").limit(1000).select("customer_id", (F.row_number().over(Window.orderBy("customer_id")) - 1).alias("p"))
    return o.select("*", F.explode(F.array(F.lit(100), F.lit(500), F.lit(1000))).alias("size")).where("p < size").groupBy("size").agg(F.count("*").alias("customers"), F.max("customer_id").alias("last_id"))


# -- text and coercion --------------------------------------------------------

_NORM = "trim(regexp_replace(translate(upper(replace(coalesce({x},''),'ß','ss')),'" + text.ACCENTED + "','" + text.PLAIN + "'),'[^A-Z0-9]+',' ','g'))"


@query(f"SELECT doc_id, {_NORM.format(x='text')} AS normalized FROM documents")
def text_normalize(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query("SELECT customer_id, list_sort(list_distinct(regexp_extract_all(n, '\\b\\d+\\b'))) AS numbers FROM (SELECT c_custkey AS customer_id, upper(regexp_replace(c_name,'[^A-Za-z0-9]+',' ','g')) || ' ' || (c_custkey%7) AS n FROM customer)")
def address_numbers(spark, d):
    name = F.concat_ws(" ", F.col("c_name"), (F.col("c_custkey") % 7).cast("string"))
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), text.address_numbers(name).alias("numbers"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' & ' || p_brand)),'[^a-z0-9]+','_','g'),'^_+|_+$','','g') AS slug FROM part")
def slugify(spark, d):
    p = T.table(spark, d, "part")
    return p.select("p_partkey", text.slugify(F.concat(F.col("p_name"), F.lit(" & "), F.col("p_brand"))).alias("slug"))


@query("SELECT n_nationkey, coalesce(nullif(regexp_replace(regexp_replace(lower(CASE WHEN n_nationkey%5=0 THEN '' ELSE n_name || ' (Zona)' END),'[^a-z0-9]+','_','g'),'^_+|_+$','','g'),''),'all') AS zone FROM nation")
def zone_normalize(spark, d):
    raw = F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.concat("n_name", F.lit(" (Zona)")))
    return T.table(spark, d, "nation").select("n_nationkey", text.zone_key(raw).alias("zone"))


@query("SELECT o_orderkey, (o_custkey)::VARCHAR AS key FROM orders")
def customer_id_norm(spark, d):
    o = T.table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", text.customer_key(raw).alias("key"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN 'OP'||(1000+s_suppkey) WHEN s_suppkey%3=1 THEN 'OP'||(100000+s_suppkey) END AS branch FROM supplier")
def branch_id(spark, d):
    s = T.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Oficina "), 1000 + k)).when(k % 3 == 1, F.concat(F.lit("Correos "), 100000 + k)).otherwise("sin codigo")
    return s.select("s_suppkey", text.branch_id(raw).alias("branch"))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey%4=0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS price FROM orders")
def coerce_numeric(spark, d):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return T.table(spark, d, "orders").select("o_orderkey", raw.try_cast("double").alias("price"))


@query("SELECT c_custkey, sha256(c_custkey::VARCHAR||'|'||c_name) AS sha, md5(c_name) AS md5 FROM customer")
def hash_columns(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), "c_name"), 256).alias("sha"), F.md5("c_name").alias("md5"))


@query("SELECT code, CASE WHEN code IN (1,2,3,7) THEN 1 WHEN code=5 THEN 2 WHEN code IN (4,6) THEN 3 ELSE 0 END AS grp, count(*) AS n, count(DISTINCT company) AS companies FROM fac GROUP BY 1", "fac")
def service_classify(spark, d):
    return T.facilities(spark, d).groupBy("code", resolution.service_group(F.col("code")).alias("grp")).agg(F.count("*").alias("n"), F.countDistinct("company").alias("companies"))


_BANDS = [10, 20, 30, 40]


@query("SELECT load, CASE WHEN load<10 THEN 0 WHEN load<20 THEN 1 WHEN load<30 THEN 2 WHEN load<40 THEN 3 ELSE 4 END AS band_left, CASE WHEN load<=10 THEN 0 WHEN load<=20 THEN 1 WHEN load<=30 THEN 2 WHEN load<=40 THEN 3 ELSE 4 END AS band_right, count(*) AS n FROM st GROUP BY ALL", "st")
def bands(spark, d):
    """Bands closed on the left, and on the right."""
    left = sum(((F.col("load") >= b).cast("int") for b in _BANDS), F.lit(0))
    right = sum(((F.col("load") > b).cast("int") for b in _BANDS), F.lit(0))
    return T.stops(spark, d).groupBy("load", left.alias("band_left"), right.alias("band_right")).agg(F.count("*").alias("n"))


# -- entity resolution --------------------------------------------------------


@query(f"WITH RECURSIVE e AS (SELECT a.facility_id AS a, b.facility_id AS b FROM fac a JOIN fac b ON a.facility_id<>b.facility_id WHERE {geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=300), r AS (SELECT facility_id AS x, facility_id AS y FROM fac UNION SELECT x, b FROM r JOIN e ON y=a) SELECT x AS facility_id, min(y) AS component FROM r GROUP BY 1".replace("WITH RECURSIVE e", "WITH e"), "fac")
def connected_components(spark, d):
    f = T.facilities(spark, d)
    e = spatial.links_within(f, "facility_id", 300.0)
    return resolution.connected(f.select(F.col("facility_id").alias("node")), e).select(F.col("node").alias("facility_id"), "component")


_SQL["connected_components"] = _SQL["connected_components"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT company, count(*) AS records, count(DISTINCT code) AS services, string_agg(DISTINCT code::VARCHAR, '|' ORDER BY code::VARCHAR) AS codes, min(facility_id) AS first_id, bool_or(code=0) AS review FROM fac GROUP BY 1", "fac")
def cluster_summary(spark, d):
    codes = F.array_join(F.sort_array(F.collect_set(F.col("code").cast("string"))), "|")
    return T.facilities(spark, d).groupBy("company").agg(F.count("*").alias("records"), F.countDistinct("code").alias("services"), codes.alias("codes"), F.min("facility_id").alias("first_id"), F.bool_or(F.col("code") == 0).alias("review"))


@query(f"SELECT a.company, round(max({geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}),3) AS diameter_m FROM fac a JOIN fac b ON a.company=b.company GROUP BY 1", "fac")
def cluster_diameter(spark, d):
    return spatial.diameters(T.facilities(spark, d), "company").select("company", F.round("diameter_m", 3).alias("diameter_m"))


@query("SELECT route_id, line, customer_id, facility_id, load, row_number() OVER (PARTITION BY route_id, line ORDER BY customer_id, facility_id, load, price, day) AS copy_no FROM st", "st")
def exact_duplicates(spark, d):
    return resolution.first_of(T.stops(spark, d), ["route_id", "line"], ["customer_id", "facility_id", "load", "price", "day"]).select("route_id", "line", "customer_id", "facility_id", "load", "copy_no")


@query("SELECT company, code, count(*) AS n FROM fac GROUP BY 1, 2", "fac")
def company_type_counts(spark, d):
    return T.facilities(spark, d).groupBy("company", "code").agg(F.count("*").alias("n"))


# -- routes, costs and audit --------------------------------------------------

_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY line, customer_id, facility_id, load, price, day) AS position FROM st)"


def _positions(spark, d):
    return T.stops(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("route_id").orderBy("line", "customer_id", "facility_id", "load", "price", "day")))


@query(f"WITH {_ORDERED} SELECT route_id, position, round(sum(km) OVER (PARTITION BY route_id ORDER BY position),6) AS km_upto, round(sum(load) OVER (PARTITION BY route_id ORDER BY position),6) AS load_upto FROM o", "st")
def route_offsets_running(spark, d):
    w = Window.partitionBy("route_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return _positions(spark, d).select("route_id", "position", F.round(F.sum("km").over(w), 6).alias("km_upto"), F.round(F.sum("load").over(w), 6).alias("load_upto"))


@query(f"WITH {_ORDERED}, a AS (SELECT route_id, position, abs(load - lag(load,1,0) OVER (PARTITION BY route_id ORDER BY position)) AS arc FROM o) SELECT route_id, count(*) AS stops, round(sum(arc),6) AS cost FROM a GROUP BY 1", "st")
def route_cost_arcs(spark, d):
    before = F.lag("load", 1, 0).over(Window.partitionBy("route_id").orderBy("position"))
    return _positions(spark, d).select("route_id", F.abs(F.col("load") - before).alias("arc")).groupBy("route_id").agg(F.count("*").alias("stops"), F.round(F.sum("arc"), 6).alias("cost"))


@query(f"WITH {_ORDERED} SELECT route_id, string_agg(customer_id::VARCHAR, ' -> ' ORDER BY position) AS sequence, count(*) AS stops FROM o GROUP BY 1", "st")
def stop_sequence_roundtrip(spark, d):
    joined = _positions(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("position", "customer_id"))).alias("s"))
    sequence = F.array_join(F.transform("s", lambda x: x["customer_id"].cast("string")), " -> ")
    return joined.select("route_id", sequence.alias("sequence"), F.size(F.split(sequence, " -> ")).cast("bigint").alias("stops"))


@query(f"WITH {_ORDERED} SELECT route_id, position, customer_id, CASE WHEN position=1 THEN 'facility' ELSE 'customer' END AS stop_type FROM o", "st")
def route_stops_explode(spark, d):
    return _positions(spark, d).select("route_id", "position", "customer_id", F.when(F.col("position") == 1, "facility").otherwise("customer").alias("stop_type"))


@query("WITH s AS (SELECT facility_id, sum(load) AS q FROM st GROUP BY 1), v AS (SELECT facility_id, q, unnest(range(1, ceil(q/200)::BIGINT+1)) AS k FROM s) SELECT facility_id, k AS visit, least(200.0, q-(k-1)*200)::DOUBLE AS load FROM v", "st")
def supply_visits(spark, d):
    s = T.stops(spark, d).groupBy("facility_id").agg(F.sum("load").alias("q"))
    v = s.withColumn("visit", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("q") / 200))))
    return v.select("facility_id", "visit", F.least(F.lit(200.0), F.col("q") - (F.col("visit") - 1) * 200).alias("load"))


@query(f"SELECT a.facility_id AS i, b.facility_id AS j, round({geo.haversine_sql('a.lat', 'a.lon', '41.4::DOUBLE', '2.17::DOUBLE')}+{geo.haversine_sql('41.4::DOUBLE', '2.17::DOUBLE', 'b.lat', 'b.lon')}-{geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')},3) AS saving FROM fac a JOIN fac b ON a.facility_id//40=b.facility_id//40 AND a.facility_id<>b.facility_id", "fac")
def savings_table(spark, d):
    """The savings of all ordered pairs of a routing problem, which has 40 clients at most."""
    f = T.facilities(spark, d).withColumn("problem", F.floor(F.col("facility_id") / 40))
    o = f.select("problem", F.col("facility_id").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    depot = (F.lit(41.4), F.lit(2.17))
    saving = geo.haversine_m(F.col("lat"), F.col("lon"), *depot) + geo.haversine_m(*depot, F.col("lat2"), F.col("lon2")) - geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return f.join(o, "problem").where("facility_id <> j").select(F.col("facility_id").alias("i"), "j", F.round(saving, 3).alias("saving"))


@query("SELECT section, greatest(ceil(sum(demand)/60.0), ceil(count(*)/floor((480-10)/5.0)))::BIGINT AS least_routes FROM cust GROUP BY 1", "cust")
def route_lower_bound(spark, d):
    return T.customers(spark, d).groupBy("section").agg(F.greatest(F.ceil(F.sum("demand") / 60.0), F.ceil(F.count("*") / F.floor(F.lit((480 - 10) / 5.0)))).cast("bigint").alias("least_routes"))


@query("SELECT customer_id, round((customer_id%90)*2/1000.0::DOUBLE/5*60,6) AS walk_min, round((customer_id%90)/1000.0::DOUBLE/15*60,6) AS bike_min FROM cust", "cust")
def last_meter_penalty(spark, d):
    snap = (F.col("customer_id") % 90).cast("double")
    return T.customers(spark, d).select("customer_id", F.round(cost.last_metre_minutes(snap, 5.0), 6).alias("walk_min"), F.round(cost.last_metre_minutes(snap, 15.0, False), 6).alias("bike_min"))


_AUDIT = "c AS (SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1), a AS (SELECT id, n, CASE WHEN id%17=0 THEN 'unroutable' WHEN n=0 THEN 'unassigned' WHEN n=1 THEN 'assigned' ELSE 'duplicated' END AS status FROM c)"


def _audit(spark, d):
    counts = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("id") % 17 == 0, "unroutable").when(F.col("n") == 0, "unassigned").when(F.col("n") == 1, "assigned").otherwise("duplicated")
    return c.withColumn("status", status)


@query(f"WITH {_AUDIT} SELECT id, n, status FROM a")
def audit_customers(spark, d):
    return _audit(spark, d).select("id", "n", "status")


@query(f"WITH {_AUDIT} SELECT status, count(*) AS customers, sum(n)::BIGINT AS visits FROM a GROUP BY 1")
def audit_summary(spark, d):
    return _audit(spark, d).groupBy("status").agg(F.count("*").alias("customers"), F.sum("n").alias("visits"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 400000) USING (c_custkey)")
def unroutable_anti(spark, d):
    o = T.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return T.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_ids(spark, d):
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(T.table(spark, d, "orders").select(F.col("o_custkey")))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS flag FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, 'candidate' FROM customer WHERE c_custkey%50=0")
def union_candidates(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = T.table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("candidate").alias("flag"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topn_snap(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)<=3")
def routes_limit_per_model(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T.table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("k")).where("k <= 3").drop("k")


@query("SELECT facility_id, count(*) AS stops, count(DISTINCT route_id) AS routes, round(sum(load),6) AS load, max(day) AS available_at FROM st GROUP BY 1", "st")
def facility_available_at(spark, d):
    return T.stops(spark, d).groupBy("facility_id").agg(F.count("*").alias("stops"), F.countDistinct("route_id").alias("routes"), F.round(F.sum("load"), 6).alias("load"), F.max("day").alias("available_at"))


_PLAN = "p AS (SELECT facility_id, sum(km) AS km, sum(minutes) AS minutes, count(DISTINCT route_id) AS routes, sum(load) AS packages FROM st GROUP BY 1)"


@query(f"WITH {_PLAN} SELECT facility_id, round(km*0.25+greatest(0.0,minutes-routes*10.0)/60*12,6) AS m1, round(km*0.30+greatest(0.0,minutes-routes*10.0)/60*12,6) AS m2, round(km*0.42+greatest(0.0,minutes-routes*10.0)/60*12+packages*0.28,6) AS m3, round(greatest(0.0,minutes-routes*10.0)/60*12+packages*0.35,6) AS m4, round(packages*0.35,6) AS m5 FROM p", "st")
def cost_models(spark, d):
    p = T.stops(spark, d).groupBy("facility_id").agg(F.sum("km").alias("km"), F.sum("minutes").alias("minutes"), F.countDistinct("route_id").alias("routes"), F.sum("load").alias("packages"))
    return p.select("facility_id", *(F.round(c, 6).alias(m) for m, c in cost.leg_costs(F.col("km"), F.col("minutes"), F.col("routes"), F.col("packages")).items()))


@query("WITH p AS (SELECT route_id, max(day) AS ended, min(day) AS began, count(*) AS stops FROM st GROUP BY 1) SELECT year(began)::INT AS year, count(*) AS routes, count(*) FILTER (date_diff('day', began, ended)>365) AS late, max(date_diff('day', began, ended))::INT AS longest_days FROM p GROUP BY 1", "st")
def timeline_metrics(spark, d):
    p = T.stops(spark, d).groupBy("route_id").agg(F.max("day").alias("ended"), F.min("day").alias("began"))
    days = F.datediff("ended", "began")
    return p.groupBy(F.year("began").alias("year")).agg(F.count("*").alias("routes"), F.count(F.when(days > 365, 1)).alias("late"), F.max(days).alias("longest_days"))


@query("WITH z AS (SELECT o_custkey%50 AS zone, count(*) AS runs, count(*) FILTER (o_orderstatus='F') AS done, count(*) FILTER (o_orderstatus='P') AS failed FROM orders GROUP BY 1) SELECT zone, runs, done, failed, CASE WHEN done=runs THEN 'completed' WHEN done>0 THEN 'partial' ELSE 'failed' END AS status FROM z")
def status_rollup(spark, d):
    """A zone's runs: completed if all are, partial if some, failed if none."""
    o = T.table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("zone"))
    z = o.agg(F.count("*").alias("runs"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("failed"))
    return z.withColumn("status", F.when(F.col("done") == F.col("runs"), "completed").when(F.col("done") > 0, "partial").otherwise("failed"))


# -- assignment, plans and exports --------------------------------------------

# Distribution centres (name, lat, lon) and static profiles (profile, city, multiplier).
CENTRES = [("north", 41.43, 2.16), ("port", 41.36, 2.17), ("river", 41.41, 2.21), ("west", 41.39, 2.11)]
STATIC = [("driving", "all", 1.2), ("driving", "NATION_3", 1.35), ("driving", "NATION_6", 1.1), ("cycling", "all", 1.05), ("cycling", "NATION_3", 1.0)]


@query("WITH x AS (SELECT customer_id, least(" + ", ".join(f"{{'m': round({geo.haversine_sql(f'{y}::DOUBLE', f'{x}::DOUBLE', 'lat', 'lon')}*1.3::DOUBLE+{geo.haversine_sql(f'{y}::DOUBLE', f'{x}::DOUBLE', 'lat', 'lon')}*1.4::DOUBLE,3), 'name': '{n}'}}" for n, y, x in CENTRES) + ") AS b FROM cust) SELECT customer_id, b.name AS centre, b.m AS way_m FROM x", "cust")
def center_select_bidirectional(spark, d):
    best = assignment.best_centre(F.col("lat"), F.col("lon"), CENTRES)
    return T.customers(spark, d).select("customer_id", best.alias("b")).select("customer_id", F.col("b.name").alias("centre"), F.col("b.m").alias("way_m"))


@query("WITH p(profile, city, mult) AS (VALUES " + ", ".join(f"('{a}', '{c}', {m}::DOUBLE)" for a, c, m in STATIC) + ") SELECT n_nationkey, profile, max_by(mult, CASE WHEN city='all' THEN 0 ELSE 1 END) AS multiplier FROM nation JOIN p ON city IN ('all', n_name) GROUP BY 1, 2")
def static_profile_pick(spark, d):
    """A city's own row goes before the row for all; the table of profiles is a short literal."""
    rows = F.array(*(F.struct(F.lit(a).alias("profile"), F.lit(c).alias("city"), F.lit(m).alias("mult")) for a, c, m in STATIC))
    n = T.table(spark, d, "nation").select("n_nationkey", "n_name", F.explode(rows).alias("p")).where((F.col("p.city") == "all") | (F.col("p.city") == F.col("n_name")))
    return n.groupBy("n_nationkey", "p.profile").agg(F.max_by("p.mult", F.when(F.col("p.city") == "all", 0).otherwise(1)).alias("multiplier"))


_FREE = f"{{'d': round({geo.haversine_sql('lat', 'lon', 'fs[j].lat', 'fs[j].lon')},3), 'j': j, 'room': loads[j]+demand<=120}}"


@query(
    f"""WITH RECURSIVE {T.SQL['cust']}, {T.SQL['fac']}, fl AS (SELECT company AS section, list({{'i': facility_id, 'lat': lat, 'lon': lon}} ORDER BY facility_id) AS fs FROM fac GROUP BY 1), ck AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY customer_id) AS k FROM cust),
t AS (SELECT section, fs, list_transform(fs, lambda f: 0::DOUBLE) AS loads, 0::BIGINT AS k, NULL::BIGINT AS customer_id, NULL::BIGINT AS facility_id, NULL::DOUBLE AS distance_m FROM fl
UNION ALL SELECT section, fs, list_transform(range(1, len(fs)+1), lambda j: loads[j] + CASE WHEN j=b.j THEN demand ELSE 0 END), k, customer_id, fs[b.j].i, b.d FROM
(SELECT t.section, fs, loads, ck.k, ck.customer_id, demand, list_sort(list_filter(list_transform(range(1, len(fs)+1), lambda j: {_FREE}), lambda x: x.room))[1] AS b FROM t JOIN ck ON ck.section=t.section AND ck.k=t.k+1))
SELECT customer_id, facility_id IS NOT NULL AS served, coalesce(facility_id, -1) AS facility_id, coalesce(distance_m, -1) AS distance_m FROM t WHERE k>0 UNION ALL SELECT customer_id, false, -1, -1 FROM cust WHERE section NOT IN (SELECT section FROM fl)"""
)
def assign_capacity(spark, d):
    """Customers of a section take, in order, the nearest facility of its company that has room for them."""
    a = assignment.assign_capacity(T.customers(spark, d), T.facilities(spark, d), 120.0)
    return a.select("customer_id", F.col("facility_id").isNotNull().alias("served"), F.coalesce("facility_id", F.lit(-1)).alias("facility_id"), F.coalesce("distance_m", F.lit(-1.0)).alias("distance_m"))


@query("WITH c AS (SELECT company, code, min(facility_id) AS i FROM fac GROUP BY 1, 2) SELECT company, min(i) AS id_final, string_agg(code::VARCHAR, ' + ' ORDER BY i) AS codes, sum(CASE code WHEN 1 THEN 60 WHEN 2 THEN 120 WHEN 3 THEN 120 WHEN 4 THEN 500 WHEN 5 THEN 300 WHEN 6 THEN 500 WHEN 7 THEN 120 ELSE 0 END)::BIGINT AS capacity FROM c GROUP BY 1", "fac")
def cluster_merge(spark, d):
    """Distinct codes in the order they first appear, and the capacity they give; a code is one row, so a list holds eight at most."""
    c = T.facilities(spark, d).groupBy("company", "code").agg(F.min("facility_id").alias("i"))
    codes = F.transform(F.sort_array(F.collect_list(F.struct("i", "code"))), lambda x: x["code"].cast("string"))
    return c.groupBy("company").agg(F.min("i").alias("id_final"), F.array_join(codes, " + ").alias("codes"), F.sum(resolution.capacity(F.col("code"))).alias("capacity"))


@query(f"WITH {_ORDERED} SELECT route_id, 'LINESTRING (' || string_agg(printf('%.6f %.6f', 2.15+((customer_id*104729)%1000)::DOUBLE/20000.0::DOUBLE, 41.38+((customer_id*7919)%1000)::DOUBLE/20000.0::DOUBLE), ', ' ORDER BY position) || ')' AS wkt FROM o GROUP BY 1", "st")
def wkt_linestring(spark, d):
    s = _positions(spark, d).select("route_id", "position", T._spread("customer_id", 104729, 2.15).alias("x"), T._spread("customer_id", 7919, 41.38).alias("y"))
    points = F.transform(F.sort_array(F.collect_list(F.struct("position", "x", "y"))), lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    return s.groupBy("route_id").agg(F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")")).alias("wkt"))


_CELLS = "cells AS (SELECT facility_id AS problem_id, line::BIGINT AS o, customer_id%20 AS d, load>45 AS bad FROM st), ends AS (SELECT problem_id, unnest([o, d]) AS point, bad FROM cells), n AS (SELECT problem_id, count(DISTINCT point) AS n FROM ends GROUP BY 1)"


@query(f"WITH {_CELLS}, c AS (SELECT problem_id, point, count(*) AS cells, count(*) FILTER (bad) AS invalid FROM ends GROUP BY 1, 2) SELECT problem_id, point, cells, invalid, point<>0 AND invalid >= greatest(10, floor(0.25*n)) AS excluded FROM c JOIN n USING (problem_id)", "st")
def matrix_validity(spark, d):
    """Invalid cells of each point, in and out; points at the threshold go, the depot (0) never."""
    cells = T.stops(spark, d).select(F.col("facility_id").alias("problem_id"), F.explode(F.array(F.col("line").cast("bigint"), F.col("customer_id") % 20)).alias("point"), (F.col("load") > 45).alias("bad"))
    c = cells.groupBy("problem_id", "point").agg(F.count("*").alias("cells"), F.count(F.when(F.col("bad"), 1)).alias("invalid"))
    n = F.count("*").over(Window.partitionBy("problem_id"))
    return c.select("problem_id", "point", "cells", "invalid", ((F.col("point") != 0) & (F.col("invalid") >= F.greatest(F.lit(10), F.floor(n * F.lit(0.25))))).alias("excluded"))


@query(f"WITH {_ORDERED} SELECT o.route_id, o.position, coalesce(c.lat, f.lat) AS lat, coalesce(c.lon, f.lon) AS lon, CASE WHEN c.lat IS NOT NULL THEN 'demand' WHEN f.lat IS NOT NULL THEN 'gazetteer' ELSE 'unknown' END AS found FROM o LEFT JOIN cust c ON c.customer_id=o.customer_id LEFT JOIN fac f ON f.facility_id=o.facility_id", "st cust fac")
def stop_resolution(spark, d):
    """Coordinates of stops from the demand table, else from the gazetteer of facilities."""
    c = T.customers(spark, d).select("customer_id", F.col("lat").alias("y1"), F.col("lon").alias("x1"))
    f = T.facilities(spark, d).select("facility_id", F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    found = F.when(F.col("y1").isNotNull(), "demand").when(F.col("y2").isNotNull(), "gazetteer").otherwise("unknown")
    s = _positions(spark, d).select("route_id", "position", "customer_id", "facility_id").join(c, "customer_id", "left").join(f, "facility_id", "left")
    return s.select("route_id", "position", F.coalesce("y1", "y2").alias("lat"), F.coalesce("x1", "x2").alias("lon"), found.alias("found"))


@query("SELECT r_regionkey, unnest([11, 23, 37]) + r_regionkey AS demand_seed, unnest([101, 102, 103]) AS search_seed FROM region")
def seed_zip(spark, d):
    pairs = F.arrays_zip(F.array(F.lit(11), F.lit(23), F.lit(37)).alias("a"), F.array(F.lit(101), F.lit(102), F.lit(103)).alias("b"))
    r = T.table(spark, d, "region").select("r_regionkey", F.explode(pairs).alias("p"))
    return r.select("r_regionkey", (F.col("p.a") + F.col("r_regionkey")).alias("demand_seed"), F.col("p.b").alias("search_seed"))


@query("SELECT company, arg_min(lat, facility_id) AS lat, arg_min(lon, facility_id) AS lon, count(*) AS records, sum(q)::DOUBLE AS load FROM fac JOIN (SELECT facility_id, sum(load) AS q FROM st GROUP BY 1) USING (facility_id) GROUP BY 1", "fac st")
def facility_summary_used(spark, d):
    """Used facilities by name: the first one's place, how many, and their load."""
    used = T.stops(spark, d).groupBy("facility_id").agg(F.sum("load").alias("q"))
    return T.facilities(spark, d).join(used, "facility_id").groupBy("company").agg(F.min_by("lat", "facility_id").alias("lat"), F.min_by("lon", "facility_id").alias("lon"), F.count("*").alias("records"), F.sum("q").alias("load"))


_ENDS = "e AS (SELECT facility_id, route_id, 540 + 10 + sum(minutes) + 5*count(*) AS finish FROM st GROUP BY 1, 2)"


@query(f"WITH {_ENDS} SELECT facility_id, round(max(finish),6) AS last_service, count(*) FILTER (finish > 570) AS after_cutoff, count(*) FILTER (finish > 575) AS after_shift, round(greatest(0, max(finish)-575),6)::DOUBLE AS overtime, bool_and(finish <= 575) AS feasible FROM e GROUP BY 1", "st")
def last_service_metrics(spark, d):
    """Ends of service against a shift that ends at 575 with a margin of 5 minutes."""
    e = T.stops(spark, d).groupBy("facility_id", "route_id").agg((550 + F.sum("minutes") + 5 * F.count("*")).alias("finish"))
    late = lambda at: F.count(F.when(F.col("finish") > at, 1))
    return e.groupBy("facility_id").agg(F.round(F.max("finish"), 6).alias("last_service"), late(570).alias("after_cutoff"), late(575).alias("after_shift"), F.round(F.greatest(F.lit(0.0), F.max("finish") - 575), 6).alias("overtime"), F.every(F.col("finish") <= 575).alias("feasible"))


@query("SELECT route_id, facility_id, min(line)::INT AS first_line, count(*) AS visits FROM st GROUP BY 1, 2", "st")
def plan_metrics_dedup(spark, d):
    """One row for each plan (route and depot)."""
    return T.stops(spark, d).groupBy("route_id", "facility_id").agg(F.min("line").cast("int").alias("first_line"), F.count("*").alias("visits"))


@query(f"""WITH {_ORDERED}, t AS (SELECT route_id, 0::BIGINT AS position, 550.0::DOUBLE AS clock FROM o WHERE position=1
UNION ALL SELECT t.route_id, o.position, clock + minutes*(CASE WHEN clock<560 THEN 1.4 WHEN clock<580 THEN 1.2 ELSE 1.0 END)::DOUBLE + 5 FROM t JOIN o ON o.route_id=t.route_id AND o.position=t.position+1)
SELECT route_id, round(max(clock),6) AS finish, max(position) AS stops FROM t GROUP BY 1""", "st")
def timeline_fold(spark, d):
    """Clock along a route: each arc takes its minutes times the multiplier of the time it starts; service is 5 minutes."""
    step = lambda t, x: t + x["minutes"] * F.when(t < 560, 1.4).when(t < 580, 1.2).otherwise(1.0) + 5
    s = _positions(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("position", "minutes"))).alias("s"))
    return s.select("route_id", F.round(F.aggregate("s", F.lit(550.0), step), 6).alias("finish"), F.size("s").cast("bigint").alias("stops"))


_SQL["timeline_fold"] = _SQL["timeline_fold"].replace("WITH ", "WITH RECURSIVE ", 1)

# A catalogue with every rate set.
CATALOGUE = {"km": 0.25, "hour": 12.0, "commission": 0.28, "facility": 30.0, "warehouse": 100.0, "package": 0.05, "vehicle": 15.0, "facility_capex": 4.0, "vehicle_capex": 8.0, "customer_hour": 9.0, "kg": 0.08}


@query(f"WITH {_PLAN} SELECT facility_id, round(km*0.25,6) AS distance, round(greatest(0.0,minutes-routes*10.0)/60*12,6) AS labour, round(30.0+100.0+packages*0.05+routes*15.0+(4.0+routes*8.0)+packages*6.0/60*9+km*0.18*0.08,6) AS other, round(km*0.25+greatest(0.0,minutes-routes*10.0)/60*12+packages*0.28+30.0+100.0+packages*0.05+routes*15.0+(4.0+routes*8.0)+packages*6.0/60*9+km*0.18*0.08,6) AS total FROM p", "st")
def cost_components(spark, d):
    p = T.stops(spark, d).groupBy("facility_id").agg(F.sum("km").alias("km"), F.sum("minutes").alias("minutes"), F.countDistinct("route_id").alias("routes"), F.sum("load").alias("packages"))
    plan = {c: F.col(c) for c in ("km", "minutes", "routes", "packages")} | {"facilities": F.lit(1), "customer_minutes": F.col("packages") * 6.0, "co2_kg": F.col("km") * 0.18}
    got = cost.components(plan, CATALOGUE)
    return p.select("facility_id", *(F.round(got[c], 6).alias(c) for c in ("distance", "labour", "other", "total")))


# -- kernels (rows only) ------------------------------------------------------


def _problems(spark, d, size: int = 1000):
    """Routing problems of ``size`` customers each."""
    c = T.customers(spark, d).withColumn("problem_id", F.floor(F.col("customer_id") / size).cast("bigint"))
    return c.select("problem_id", F.col("customer_id").alias("client_id"), "lat", "lon", "demand", F.lit(41.405).alias("depot_lat"), F.lit(2.175).alias("depot_lon"))


@query()
def routes_cws(spark, d):
    """Savings routes of problems of a thousand customers."""
    return routing.stops_of(routing.solve(_problems(spark, d)))


@query()
def routes_ils(spark, d):
    """Iterated local search, 100 tries or 20 without success, on problems of a hundred customers."""
    return routing.stops_of(routing.solve(_problems(spark, d, 100), improve=True))


@query()
def models_compare(spark, d):
    """The five models over zones of a thousand customers: all legs routed."""
    c = T.customers(spark, d).withColumns({"zone": F.floor(F.col("customer_id") / 1000).cast("bigint"), "snap_m": (F.col("customer_id") % 90).cast("double")})
    f = T.facilities(spark, d).withColumn("group", resolution.service_group(F.col("code")))
    return models.compare_all(c, f, (41.405, 2.175))


from lastleg import matrix_queries, plan_queries, scan_queries, text_queries, zone_queries  # noqa: E402, F401  register their queries
