"""More of the catalogue: files written in the forms that are scanned, and scanned again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.functions import clock, projection
from lastleg.operators import matrices, resolution
from lastleg.queries import query
from lastleg.sources import files, sinks
from lastleg.sources import tables as T

_SUPPLIERS = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


def _suppliers(spark, d) -> DataFrame:
    return T.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


@query(_SUPPLIERS)
def scan_csv_typed(spark, d):
    """A file with a fixed list of columns, and a byte order mark that is no part of the first name."""
    path = sinks.scratch(spark, "typed")
    sinks.write_csv(_suppliers(spark, d), path)
    return files.read_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name AS nombre, replace(s_acctbal::VARCHAR, '.', ',') AS importe FROM supplier")
def scan_csv_sniffed(spark, d):
    """A file of unknown separator, all text."""
    path = sinks.scratch(spark, "sniffed")
    raw = _suppliers(spark, d).select("s_suppkey", F.col("s_name").alias("nombre"), F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("importe"))
    raw.write.option("header", True).option("sep", ";").csv(path)
    return files.read_csv(spark, path)


@query("SELECT s_suppkey AS id, round(s_acctbal,2) AS amount FROM supplier")
def scan_csv_fuzzy(spark, d):
    """Columns found by keywords whatever their accents, and numbers with a decimal comma and thousands dots."""
    path = sinks.scratch(spark, "fuzzy")
    x = F.col("s_acctbal")
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.replace(F.replace(F.replace(F.format_number(F.abs(x), 2), F.lit(","), F.lit("#")), F.lit("."), F.lit(",")), F.lit("#"), F.lit(".")))
    _suppliers(spark, d).select(F.col("s_suppkey").alias("Código"), text.alias("Población TOTAL"), F.lit(None).cast("string").alias("Unnamed: 2")).write.option("header", True).option("sep", "\t").csv(path)
    raw = files.without_empty_columns(files.read_csv(spark, path))
    return raw.select(F.col(files.find_column(raw, "codigo")).cast("bigint").alias("id"), files.decimal(F.col(files.find_column(raw, "poblacion", "total"))).alias("amount"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey%3=0 THEN 'private' ELSE 'office' END AS kind, CASE WHEN s_suppkey%3=0 THEN 'OP' || lpad(s_suppkey::VARCHAR,5,'0') ELSE s_name END AS name, s_suppkey/8.0::DOUBLE AS lat FROM supplier")
def scan_json_nested(spark, d):
    """A document of nested offices, private ones named by their number."""
    path = sinks.scratch(spark, "nested")
    office = F.struct(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3 == 0).alias("isPrivate"), F.col("s_name").alias("title"), F.struct((F.col("s_suppkey") / 8.0).alias("lat")).alias("position"))
    groups = T.table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 16).alias("g")).agg(F.collect_list(office).alias("offices"))
    groups.select(F.to_json(F.struct(F.struct("offices").alias("others"))).alias("value")).write.text(path)
    return files.read_offices(spark, path)


@query("SELECT s_suppkey AS id, 41.38 + ((s_suppkey*6007)%1000)::DOUBLE/20000.0::DOUBLE AS lat, 2.15 + ((s_suppkey*3001)%1000)::DOUBLE/20000.0::DOUBLE AS lon FROM supplier")
def scan_geojson_points(spark, d):
    path = sinks.scratch(spark, "points")
    sinks.write_geojson(T.facilities(spark, d).select(F.col("facility_id").alias("id"), "lat", "lon"), path)
    return files.read_geojson_points(spark, path, "id bigint", multiline=False).select("id", "lat", "lon")


@query("SELECT n_regionkey::INT AS n_regionkey, n_nationkey::INT AS n_nationkey, n_name FROM nation")
def sink_partitioned(spark, d):
    """ZSTD parquet in a folder for each zone, written again for some of them only."""
    path = sinks.scratch(spark, "zones")
    n = T.table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("n_regionkey"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    sinks.write_parquet(n.withColumn("n_name", F.when(F.col("n_regionkey") < 2, "old").otherwise(F.col("n_name"))), path, ["n_regionkey"])
    sinks.write_parquet(n.where("n_regionkey < 2"), path, ["n_regionkey"])
    sinks.write_parquet(n.limit(0), path, ["n_regionkey"], if_absent=True)
    return spark.read.parquet(path)


@query("SELECT r_regionkey::INT AS zone, CASE WHEN r_regionkey=3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN r_regionkey=3 THEN 0 ELSE count(*) END::BIGINT AS rows FROM region JOIN nation ON n_regionkey=r_regionkey GROUP BY r_regionkey")
def sink_by_zone(spark, d):
    """Zones written one after another; one that fails leaves a status and the others' rows."""
    n = T.table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("zone"), "n_name")
    bad = F.when(F.col("zone") == 3, F.raise_error(F.lit("no route"))).otherwise(F.col("n_name"))
    zones = [r.r_regionkey for r in T.table(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # an experiment's zones, a handful
    return sinks.write_zones(n.withColumn("n_name", bad), "zone", zones, sinks.scratch(spark, "by-zone")).select("zone", "status", "rows")


@query("SELECT 'service' AS catalogue, code, name FROM (VALUES (0,'Unknown'),(1,'Locker'),(2,'PUDO'),(3,'Click & Collect'),(4,'Distribution / Reception Center'),(5,'Last Mile Logistics Station'),(6,'Warehouse / E-Fulfilment'),(7,'Convenience Store')) s(code,name) UNION ALL SELECT 'group', code, name FROM (VALUES (0,'Unknown'),(1,'PUDO'),(2,'Microhub'),(3,'CC')) g(code,name) UNION ALL SELECT 'confidence', code, name FROM (VALUES (1,'High'),(2,'Medium'),(3,'Review')) c(code,name)")
def catalogues(spark, d):
    """The code tables."""
    return resolution.catalogues(spark)


@query("SELECT round(o_totalprice/20000)::INT AS bin, count(*) AS n, round(min(o_totalprice),2) AS least, round(max(o_totalprice),2) AS most FROM orders GROUP BY 1")
def histogram(spark, d):
    """The numbers behind a chart: counts by bins."""
    o = T.table(spark, d, "orders").groupBy(F.round(F.col("o_totalprice") / 20000).cast("int").alias("bin"))
    return o.agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("least"), F.round(F.max("o_totalprice"), 2).alias("most"))


@query("SELECT s_suppkey%5 AS id, '<category render=\"1\" value=\"' || replace(replace(s_name, '&', '&amp;'), '<', '&lt;') || '\" symbol=\"' || s_suppkey || '\"/>' AS style FROM supplier")
def style_text(spark, d):
    """Categories of a layer's style as text."""
    from lastleg.functions import text

    s = T.table(spark, d, "supplier")
    return s.select((F.col("s_suppkey") % 5).alias("id"), F.concat(F.lit('<category render="1" value="'), text.xml_escape(F.col("s_name")), F.lit('" symbol="'), F.col("s_suppkey"), F.lit('"/>')).alias("style"))


@query("SELECT DISTINCT section::BIGINT AS section, 'low' AS scenario FROM (SELECT c_nationkey AS section FROM customer)")
def demand_instance(spark, d):
    """An instance found by its id, before its seed, before an old name; scanned, renamed and checked."""
    folder = sinks.scratch(spark, "demand")
    c = T.customers(spark, d).select(F.col("customer_id").alias("ID"), F.col("demand").cast("string").alias("Demand"), F.lit("low").alias("Scenario"), "section")
    c.write.option("header", True).csv(f"{folder}/city_low_100_7.csv")
    c.limit(1).write.option("header", True).csv(f"{folder}/city_low_100.csv")
    path = files.resolve_instance(spark, folder, "city", "low", 100, seed=7)
    raw = files.read_csv(spark, path)
    checked = matrices.checked_demand(raw, {"ID": "customer_id", "Demand": "demand", "Scenario": "scenario"}, "low")
    return raw.select(F.col("ID").alias("customer_id"), F.col("section").cast("bigint").alias("section")).join(checked, "customer_id").select("section", "scenario").distinct()


@query("SELECT c_custkey AS id, round(2.15 + ((c_custkey*104729)%1000)::DOUBLE/20000.0::DOUBLE,6) AS lon, round(41.38 + ((c_custkey*7919)%1000)::DOUBLE/20000.0::DOUBLE,6) AS lat FROM customer")
def scan_addresses(spark, d):
    """Addresses in metres of a UTM zone, with decimal commas, as longitude and latitude."""
    path = sinks.scratch(spark, "addresses")
    east, north = map(F.expr, projection.to_utm("lat", "lon", 31))
    comma = lambda x: F.replace(F.format_string("%.4f", x), F.lit("."), F.lit(","))
    T.customers(spark, d).select(F.col("customer_id").alias("id"), comma(east).alias("x"), comma(north).alias("y")).write.option("header", True).option("sep", ";").csv(path)
    raw = files.read_csv(spark, path).select(F.col("id").cast("bigint").alias("id"), files.decimal(F.col("x")).alias("x"), files.decimal(F.col("y")).alias("y"))
    zone = projection.estimate_zone(raw, "x", "y", (30, 31), near=(2.17, 41.4))
    lat, lon = map(F.expr, projection.from_utm("x", "y", zone))
    return raw.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT n_nationkey AS id, 'zone_' || (n_nationkey%3) AS zone, (n_nationkey%12)*60 AS start_min, (n_nationkey%12)*60+90 AS end_min, 1.0+n_nationkey%4/10.0 AS multiplier FROM nation")
def scan_time_traffic(spark, d):
    """Timed multipliers scanned and checked: clock times, days and positive multipliers, or the query fails."""
    path = sinks.scratch(spark, "traffic")
    n = F.col("n_nationkey")
    at = lambda m: F.format_string("%02d:%02d", F.floor(m / 60), F.floor(m % 60))
    start = (n % 12) * 60
    T.table(spark, d, "nation").select(n.alias("id"), F.lit("driving").alias("profile"), F.concat(F.lit("Zone "), n % 3).alias("zone"), F.lit("weekday").alias("day_of_week"), at(start).alias("start_time"), at(start + 90).alias("end_time"), (1.0 + n % 4 / 10).alias("multiplier")).write.option("header", True).csv(path)
    return clock.checked_intervals(files.read_csv(spark, path), "driving").select("id", "zone", "start_min", "end_min", "multiplier")


@query("SELECT 'routes' AS kind, count(*) AS rows FROM nation UNION ALL SELECT 'stops', count(*) FROM region")
def classify_files(spark, d):
    """Files told apart by their headers, and those of a kind read as one table."""
    folder = sinks.scratch(spark, "mixed")
    T.table(spark, d, "nation").select(F.col("n_nationkey").alias("route_id"), F.col("n_name").alias("model")).write.option("header", True).csv(f"{folder}/a")
    T.table(spark, d, "region").select(F.col("r_regionkey").alias("route_id"), F.col("r_name").alias("stop_position")).write.option("header", True).csv(f"{folder}/b")
    found = files.by_header(spark, [f"{folder}/a", f"{folder}/b"], {"stops": {"stop_position"}, "routes": {"model"}})
    return found["routes"].select(F.lit("routes").alias("kind")).unionByName(found["stops"].select(F.lit("stops").alias("kind"))).groupBy("kind").agg(F.count("*").alias("rows"))


@query("WITH x AS (SELECT s_name AS label, 41.38 + ((s_suppkey*6007)%1000)::DOUBLE/20000.0::DOUBLE AS lat, s_suppkey AS k, 0 AS c FROM supplier UNION ALL SELECT 'nation_' || s_nationkey, 41.38 + ((s_suppkey*6007)%1000)::DOUBLE/20000.0::DOUBLE, s_suppkey, 1 FROM supplier) SELECT label, arg_min(lat, (k, c)) AS lat FROM x GROUP BY 1")
def gazetteer(spark, d):
    """Every text of a table as a name of its row's place; the first row wins."""
    f = T.facilities(spark, d).withColumn("nation", F.concat(F.lit("nation_"), "company"))
    return files.gazetteer(f, ["name", "nation"], order=["facility_id"]).select("label", "lat")


@query("SELECT unnest(range(1, (SELECT count(*) FROM customer WHERE c_custkey<=4500)+1)) AS id, 2.0::DOUBLE AS lon")
def scan_paged(spark, d):
    """A source read page by page, each a partition of its own, until a page is short."""
    return files.read_pages(spark, files.CountingSource(T.table(spark, d, "customer").where("c_custkey <= 4500").count()), page=2000).select("id", "lon")
