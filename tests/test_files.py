"""Files in and out: separators, encodings, marks, GeoJSON, configurations, projection."""

from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from lastleg.functions import projection
from lastleg.sources import files, sinks


@pytest.mark.parametrize(("sep", "encoding"), [(";", "utf-8-sig"), ("\t", "utf-8"), (",", "latin-1")])
def test_csv_of_any_form(spark, tmp_path, sep, encoding):
    (tmp_path / "x.csv").write_bytes(sep.join(["Código", "Población", "Unnamed: 2", "leer"]).encode(encoding) + ("\n" + sep.join(["01", "1.234", "x", ""]) + "\n" + sep.join(["ñ", "12.5", "y", ""])).encode(encoding))
    got = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert files.find_column(got, "codigo") == "Código"
    assert files.find_column(got, "nothing", required=False) is None
    assert files.without_empty_columns(got).columns == ["Código", "Población"]
    assert sorted(r[0] for r in got.collect()) == ["01", "ñ"]
    with pytest.raises(ValueError):
        files.find_column(got, "nothing")
    with pytest.raises(ValueError):
        files.require_columns(got, ["Código", "zip"], "x")


def test_decimals(spark):
    rows = spark.createDataFrame([("1.234,5",), ("3,25",), (" 7.5 ",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in rows.select(files.decimal(F.col("x"))).collect()] == [1234.5, 3.25, 7.5, None, None]


def test_latest(spark):
    rows = spark.createDataFrame([(1, "2020"), (2, "2021"), (3, "2021"), (4, None)], "a int, y string")
    assert sorted(r.a for r in files.latest(rows, "y").collect()) == [2, 3]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, name string")
    path = str(tmp_path / "out")
    sinks.write_csv(rows, path)
    part = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfid,name")
    sinks.write_csv(rows.limit(1), path, if_absent=True)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.count() == 2
    assert files.read_csv(spark, path).columns == ["id", "name"]


def test_parquet_replaces_only_what_occurs(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "zone string, n int")
    sinks.write_parquet(rows, path, by=["zone"])
    sinks.write_parquet(spark.createDataFrame([("b", 5)], "zone string, n int"), path, by=["zone"])
    assert sorted((r.zone, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]


def test_geojson(spark, tmp_path):
    rows = spark.createDataFrame([(2.1, 41.3, "x"), (None, 41.0, "y"), (2.2, 41.4, None)], "lon double, lat double, name string")
    sinks.write_geojson(rows, str(tmp_path / "lines"))
    got = files.read_geojson_points(spark, str(tmp_path / "lines"), "name: string", multiline=False)
    assert sorted((r.lon, r.lat, r.name) for r in got.collect()) == [(2.1, 41.3, "x"), (2.2, 41.4, None)]
    (tmp_path / "c.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}, {"type": "Feature", "properties": {}, "geometry": null}]}')
    assert [tuple(r) for r in files.read_geojson_points(spark, str(tmp_path / "c.geojson"), "name: string").collect()] == [(1.0, 2.0, "p")]


@dataclass
class Settings:
    city: str
    sizes: list = field(default_factory=lambda: [100])


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('\ufeff{"city": "x"}', encoding="utf-8")
    assert files.load_config(str(path), Settings) == Settings("x")
    for wrong in ('{"city": "x", "other": 1}', '{"sizes": []}'):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            files.load_config(str(path), Settings)
    assert files.pair_seeds(1, [5, 6]) == [(1, 5), (1, 6)]
    assert files.pair_seeds([1, 2], [5, 6]) == [(1, 5), (2, 6)]
    for a, b in (([1, 2], [1, 2, 3]), ([1, 1], [2, 2])):
        with pytest.raises(ValueError):
            files.pair_seeds(a, b)
    assert sinks.payload_hash({"b": 1, "a": 2}) == sinks.payload_hash({"a": 2, "b": 1})


def test_projection(spark):
    points = spark.createDataFrame([(40.0, 3.0), (41.3874, 2.1686), (0.0, 3.0), (39.47, -0.376)], "lat double, lon double")
    east, north = projection.to_utm("lat", "lon", 31)
    flat = points.select("lat", "lon", F.expr(east).alias("x"), F.expr(north).alias("y"))
    lat, lon = projection.from_utm("x", "y", 31)
    rows = flat.select("*", F.expr(lat).alias("lat2"), F.expr(lon).alias("lon2")).collect()
    assert abs(rows[0].x - 500_000) < 1e-3 and abs(rows[0].y - 0.9996 * 4_429_529.03) < 0.01 and abs(rows[2].y) < 1e-6
    assert all(abs(r.lat - r.lat2) < 1e-8 and abs(r.lon - r.lon2) < 1e-8 for r in rows)


def test_experiments_from_a_file_and_overrides(tmp_path):
    import json

    from lastleg.plans import experiment as E

    path = tmp_path / "e.json"
    path.write_text(json.dumps({"city": "Porto", "zones": ["Old"], "demand_seed": [1, 2]}))
    got = E.resolved(["--config", str(path), "--set", "customers=50", "--set", 'models=["M1"]'])
    assert [(x.demand_seed, x.search_seed, x.customers, x.models) for x in got] == [(1, 42, 50, ["M1"]), (2, 42, 50, ["M1"])]
    assert E.folder_name(got[1]) == "porto_low_50_2_42"
    for bad in ('models=["M9"]', "zones=[]", 'scenario="odd"', "speed=1"):
        with pytest.raises(ValueError):
            E.resolved(["--config", str(path), "--set", bad])
