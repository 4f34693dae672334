"""UTM on the GRS80/WGS84 ellipsoid by the Krueger series, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import math

# Ellipsoid, scale on the central meridian, false easting.
RADIUS, FLATTENING, SCALE, EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0

_N = FLATTENING / (2 - FLATTENING)
_ARC = SCALE * RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _lit(x: float) -> str:
    return f"{x:.17e}"


def _series(terms: tuple[float, ...], first: str, second: str, x: str, y: str, sign: str) -> str:
    return "".join(f" {sign} {_lit(t)}*{first}({_lit(2.0 * j)}*({x}))*{second}({_lit(2.0 * j)}*({y}))" for j, t in enumerate(terms, start=1))


def to_utm(lat: str, lon: str, zone: int) -> tuple[str, str]:
    """SQL for easting and northing, in metres, on the northern hemisphere."""
    c = 2 * math.sqrt(_N) / (1 + _N)
    sine, turn = f"sin(radians({lat}))", f"radians({lon} - {_lit(6.0 * zone - 183)})"
    t = f"sinh(atanh({sine}) - {_lit(c)}*atanh({_lit(c)}*{sine}))"
    xi, eta = f"atan2({t}, cos({turn}))", f"atanh(sin({turn})/sqrt({_lit(1.0)} + pow({t}, 2)))"
    east = f"({_lit(EAST)} + {_lit(_ARC)}*({eta}{_series(_ALPHA, 'cos', 'sinh', xi, eta, '+')}))"
    return east, f"({_lit(_ARC)}*({xi}{_series(_ALPHA, 'sin', 'cosh', xi, eta, '+')}))"


def from_utm(east: str, north: str, zone: int) -> tuple[str, str]:
    """SQL for latitude and longitude, in degrees."""
    x, y = f"({north})/{_lit(_ARC)}", f"(({east}) - {_lit(EAST)})/{_lit(_ARC)}"
    xi, eta = f"({x}{_series(_BETA, 'sin', 'cosh', x, y, '-')})", f"({y}{_series(_BETA, 'cos', 'sinh', x, y, '-')})"
    chi = f"asin(sin({xi})/cosh({eta}))"
    lat = chi + "".join(f" + {_lit(d)}*sin({_lit(2.0 * j)}*{chi})" for j, d in enumerate(_DELTA, start=1))
    return f"degrees({lat})", f"({_lit(6.0 * zone - 183)} + degrees(atan2(sinh({eta}), cos({xi}))))"


def estimate_zone(frame, east: str, north: str, zones: tuple[int, ...], near: tuple[float, float]) -> int:
    """The zone under which the middle of all points lies nearest to a known place (lon, lat)."""
    from pyspark.sql import functions as F

    middle = frame.agg(F.avg(east).alias("x"), F.avg(north).alias("y"))
    places = middle.select(*(F.expr(part).alias(f"{name}{z}") for z in zones for name, part in zip(("lat", "lon"), from_utm("x", "y", z), strict=True))).first()
    return min(zones, key=lambda z: math.hypot((places[f"lon{z}"] or 1e9) - near[0], (places[f"lat{z}"] or 1e9) - near[1]))
