"""Wall time of the headline queries and of savings construction by size: one JSON line."""

import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "profile_15min", "profile_quantiles_cumfreq", "traffic_interval_priority", "zone_points_contains", "pairs_within_radius", "nearest_facility", "assign_unlimited", "weighted_centroid",
    "route_offsets_running", "route_stops_explode", "supply_visits", "cluster_summary", "audit_summary", "cost_models", "routes_cws", "models_compare",
]
#: Clients of one problem: uniform asymmetric ways, loads 1 to 10, capacity 1,000, no limit of time.
SAVINGS = (500, 1000, 2000, 4000, 6000)


def savings_seconds(n: int) -> float:
    from lastleg.operators.routing import savings_routes

    random = np.random.default_rng(0)
    minutes, demand = random.uniform(1, 100, (n + 1, n + 1)), np.concatenate(([0.0], random.integers(1, 11, n).astype(float)))
    np.fill_diagonal(minutes, 0)
    began = time.time()
    savings_routes(minutes, demand, 1000.0, 1e9)
    return round(time.time() - began, 3)


def main() -> None:
    from lastleg import queries

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, known = {}, queries.queries()
    known["audit_summary"](spark, FOLDER).write.format("noop").mode("overwrite").save()  # the session's own start is no query's time
    for name in HEADLINES:
        began = time.time()
        known[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    total = round(sum(found.values()), 3)
    found |= {f"savings_{n}": savings_seconds(n) for n in SAVINGS}
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": found, "sf": os.path.basename(FOLDER.rstrip("/"))}))


if __name__ == "__main__":
    main()
