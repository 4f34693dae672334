"""Tables of a directory, and the last-mile domain derived from them.

Customers, facilities and stops are projections of the star schema, so the
engine's operators run on any scale of it; a real deployment reads the same
columns from its own tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spread(key: str, factor: int, origin: float) -> Column:
    return F.lit(origin) + (F.col(key) * factor % 1000).cast("double") / F.lit(20000.0)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), _spread("c_custkey", 7919, 41.38).alias("lat"), _spread("c_custkey", 104729, 2.15).alias("lon"), (1 + F.col("c_custkey") % 5).alias("demand"), F.col("c_nationkey").alias("section"))


def facilities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("name"), _spread("s_suppkey", 6007, 41.38).alias("lat"), _spread("s_suppkey", 3001, 2.15).alias("lon"), (F.col("s_suppkey") % 8).cast("int").alias("code"), F.col("s_nationkey").alias("company"))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor readings: intensity, occupancy, speed and an error flag."""
    return table(spark, folder, "events").select(F.col("event_id"), F.col("user_id").alias("sensor_id"), F.col("ts"), F.floor("value").cast("bigint").alias("intensity"), F.get_json_object("props", "$.k").cast("bigint").alias("occupancy"), F.col("value").alias("speed"), F.when(F.col("event_type") == "error", "S").otherwise("N").alias("read_error"))


def stops(spark: SparkSession, folder: str) -> DataFrame:
    """Route stops: orders are routes, line items their stops, in a total order."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("customer_id"), F.col("l_suppkey").alias("facility_id"), F.col("l_quantity").alias("load"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 0.25).alias("km"), (F.col("l_discount") * 100).alias("minutes"), F.col("l_shipdate").alias("day"))


#: The same views as DuckDB common table expressions.
SQL = {
    "cust": "cust AS (SELECT c_custkey AS customer_id, 41.38 + ((c_custkey*7919)%1000)::DOUBLE/20000.0::DOUBLE AS lat, 2.15 + ((c_custkey*104729)%1000)::DOUBLE/20000.0::DOUBLE AS lon, 1 + c_custkey%5 AS demand, c_nationkey AS section FROM customer)",
    "fac": "fac AS (SELECT s_suppkey AS facility_id, s_name AS name, 41.38 + ((s_suppkey*6007)%1000)::DOUBLE/20000.0::DOUBLE AS lat, 2.15 + ((s_suppkey*3001)%1000)::DOUBLE/20000.0::DOUBLE AS lon, (s_suppkey%8)::INT AS code, s_nationkey AS company FROM supplier)",
    "rd": "rd AS (SELECT event_id, user_id AS sensor_id, ts, floor(value)::BIGINT AS intensity, (props->>'$.k')::BIGINT AS occupancy, value AS speed, CASE WHEN event_type='error' THEN 'S' ELSE 'N' END AS read_error FROM events)",
    "st": "st AS (SELECT l_orderkey AS route_id, l_linenumber AS line, l_partkey AS customer_id, l_suppkey AS facility_id, l_quantity AS load, l_extendedprice AS price, l_quantity*0.25 AS km, l_discount*100 AS minutes, l_shipdate AS day FROM lineitem)",
}
