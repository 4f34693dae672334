"""Assignment of customers to facilities and centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.functions.geo import EARTH_M, haversine_m
from lastleg.operators.lineage import units


#: Ways from customers to all facilities of their group that are held at once.
CELLS = 1 << 20


def greedy_capacity(metres: np.ndarray, demand: np.ndarray, capacity: float, load: np.ndarray | None = None) -> np.ndarray:
    """Customers in row order take the nearest facility with room; -1 where none has. Unreachable (NaN) facilities come last.

    ``load`` is what the facilities hold already; it is changed.
    """
    load = np.zeros(metres.shape[1]) if load is None else load
    out = np.full(len(demand), -1)
    for k, need in enumerate(demand):
        free = load + need <= capacity
        if free.any():
            ways = np.where(free, metres[k], np.nan)
            out[k] = np.argmax(free) if np.isnan(ways).all() else np.nanargmin(ways)  # the first of equal ones
            load[out[k]] += need
    return out


def assign_capacity(customers: DataFrame, facilities: DataFrame, capacity: float, group: str = "section", site_group: str = "company", strict: bool = False) -> DataFrame:
    """(customer_id, facility_id, distance_m), facility null where no room is left (an error if ``strict``).

    Every group is one sequential problem: a zone's customers, and rows of
    ways to its facilities, at most CELLS of them (or one row) at a time.
    """

    def run(c: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        c, f = c.sort_values("customer_id"), f.sort_values("facility_id")
        lat1, lon1, lat2, lon2 = (np.radians(x.to_numpy(float)) for x in (c["lat"], c["lon"], f["lat"], f["lon"]))
        demand, load = c["demand"].to_numpy(float), np.zeros(len(f))
        out, far = np.full(len(c), -1), np.full(len(c), np.nan)
        block = max(1, CELLS // max(1, len(f)))
        for at in range(0, len(c) if len(f) else 0, block):
            y, x = lat1[at : at + block, None], lon1[at : at + block, None]
            a = np.sin((lat2 - y) / 2) ** 2 + np.cos(y) * np.cos(lat2) * np.sin((lon2 - x) / 2) ** 2
            metres = np.round(2 * EARTH_M * np.arcsin(np.sqrt(a)), 3)
            own = greedy_capacity(metres, demand[at : at + block], capacity, load)
            out[at : at + block] = own
            far[at : at + block] = np.where(own >= 0, metres[np.arange(len(own)), own], np.nan)
        if strict and (out < 0).any():
            raise ValueError(f"no room for customer {c['customer_id'].iloc[int(np.argmin(out))]}")
        ids = pd.array([int(f["facility_id"].iloc[k]) if k >= 0 else None for k in out], dtype="Int64")
        return pd.DataFrame({"customer_id": c["customer_id"].to_numpy(), "facility_id": ids, "distance_m": [None if np.isnan(m) else float(m) for m in far]})

    parts = units(customers.sparkSession)  # few bytes would be merged into one task
    left = customers.select(F.col(group).alias("_g"), "customer_id", "lat", "lon", "demand").repartition(parts, "_g").groupBy("_g")
    right = facilities.select(F.col(site_group).alias("_g"), "facility_id", "lat", "lon").repartition(parts, "_g").groupBy("_g")
    return left.cogroup(right).applyInPandas(run, "customer_id bigint, facility_id bigint, distance_m double")


def best_centre(lat: Column, lon: Column, centres: list[tuple[str, float, float]], out_factor: float = 1.3, back_factor: float = 1.4) -> Column:
    """struct(m, name) of the centre with the least way out and back; centres are a short literal list."""
    ways = [(name, haversine_m(F.lit(y), F.lit(x), lat, lon)) for name, y, x in centres]
    return F.array_min(F.array(*(F.struct(F.round(m * out_factor + m * back_factor, 3).alias("m"), F.lit(name).alias("name")) for name, m in ways)))
