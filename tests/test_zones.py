"""Polygons against plain loops, zone selection, formats; points at the poles and across the date line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lastleg.functions import clock, text
from lastleg.operators import resolution, spatial, zones
from lastleg.sources import files, sinks
from tests.test_spatial import metres


def shape(spark, rings, name="z", kind="district"):
    return spark.createDataFrame([(name, kind, rings)], f"zone string, kind string, rings {zones.RINGS}")


SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]


def test_a_square_with_a_hole(spark):
    z = shape(spark, SQUARE)
    x, y = zones.centroid(F.col("rings"))
    got = z.select(x.alias("x"), y.alias("y"), (zones.area2(F.col("rings")) / 2).alias("a")).first()
    assert got.a == pytest.approx(15) and (got.x, got.y) == pytest.approx(((16 * 2 - 1.5) / 15,) * 2)
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 1.0), (4, 3.0, 3.9)], "id int, lon double, lat double")
    assert sorted(r.id for r in zones.zones_of_points(points, z.select("zone", "rings")).collect()) == [1, 4]
    assert z.select(zones.rings_to_wkt(zones.rings_from_wkt(zones.rings_to_wkt(F.col("rings"))), 1).alias("w")).first().w.startswith("POLYGON ((0.0 0.0, 4.0 0.0")


def test_distance_to_a_zone(spark):
    z = shape(spark, [[(2.0, 41.0), (2.01, 41.0), (2.01, 41.01), (2.0, 41.01)]])
    points = spark.createDataFrame([(1, 2.005, 41.005), (2, 2.005, 41.02), (3, 2.03, 41.02)], "id int, lon double, lat double")
    got = {r.id: r.m for r in points.join(F.broadcast(z)).select("id", zones.metres_to(F.col("rings"), F.col("lon"), F.col("lat")).alias("m")).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(metres((41.02, 2.005), (41.01, 2.005)), rel=1e-3) and got[3] == pytest.approx(metres((41.02, 2.03), (41.01, 2.01)), rel=1e-3)


def test_zone_selection_says_what_is_wrong(spark):
    z = shape(spark, SQUARE, "Centre").unionByName(shape(spark, SQUARE, "Centre", "quarter")).unionByName(shape(spark, SQUARE, "Port"))
    assert {r.kind for r in zones.select_zones(z, ["centre:Quarter", "PORT"]).collect()} == {"quarter", "district"}
    with pytest.raises(ValueError, match="several"):
        zones.select_zones(z, ["Centre"])
    with pytest.raises(ValueError, match="no zone"):
        zones.select_zones(z, ["Hill"])


def test_geojson_collection_of_polygons(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [("Polygon", [ring]), ("MultiPolygon", [[ring], [ring, ring]]), ("Point", [1, 2])]
    whole = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": k}, "geometry": {"type": k, "coordinates": c}} for k, c in shapes]}
    (tmp_path / "z.json").write_text(json.dumps(whole, indent=1))
    got = {r.name: r.rings for r in files.read_geojson_polygons(spark, str(tmp_path / "z.json"), "name string").collect()}
    assert sorted(got) == ["MultiPolygon", "Polygon"] and [len(r) for r in got["MultiPolygon"]] == [3, 3, 3] and tuple(got["Polygon"][0][1]) == (1.0, 0.0)


@pytest.mark.parametrize("middle", [(41.4, 2.1), (66.0, 25.0), (89.7, 0.0), (-89.9, 10.0), (0.0, 179.99)])
@pytest.mark.parametrize("radius", [300.0, 20_000.0])
def test_pairs_anywhere_on_the_globe(spark, middle, radius):
    random = np.random.default_rng(8)
    scale = radius / 111_000 * 3
    lat = np.clip(middle[0] + scale * random.normal(size=60), -90, 90)
    lon = (middle[1] + scale * random.normal(size=60) / max(0.01, np.cos(np.radians(middle[0]))) + 180) % 360 - 180
    rows = [(k, float(a), float(b), 1.0) for k, (a, b) in enumerate(zip(lat, lon, strict=True))] + [(99, None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "id bigint, lat double, lon double, _x double")
    got = sorted((r.id_1, r.id_2) for r in spatial.pairs_within(frame, "id", radius).collect())
    assert got == sorted((a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and metres(a[1:3], b[1:3]) <= radius)


def test_nearest_over_all_distances(spark):
    random = np.random.default_rng(9)
    p = [(k, float(random.uniform(-80, 80)), float(random.uniform(-180, 180))) for k in range(40)]
    s = [(k, 41.0 + k / 1000, 2.0) for k in range(5)] + [(7, -70.0, -170.0)]
    points, sites = spark.createDataFrame(p, "id bigint, lat double, lon double"), spark.createDataFrame(s, "site bigint, lat double, lon double")
    got = {r.id: r.site for r in spatial.nearest(points, sites, "id", "site").collect()}
    assert got == {a[0]: min((round(float(metres(a[1:], b[1:])), 3), b[0]) for b in s)[1] for a in p}
    assert spatial.nearest(points, sites.where("false"), "id", "site").count() == 0


def test_text_similarity_is_difflib(spark):
    from difflib import SequenceMatcher

    pairs = [("CALLE MAYOR 3", "CALLE MAJOR 3"), ("", "x"), (None, "x"), ("abc", "abc"), ("abcd", "dcba")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.s for r in frame.select("a", "b", resolution.text_similarity("a", "b").alias("s")).collect()}
    assert got == {(a, b): round(100 * SequenceMatcher(None, a, b).ratio(), 2) if a and b else 0.0 for a, b in pairs}


def test_letters_beyond_latin_1(spark):
    frame = spark.createDataFrame([("Škoda Žižkov Ő Ｏｋ",), (None,)], "x string")
    assert sorted(r[0] for r in frame.select(text.fold(F.col("x"))).collect()) == ["", "SKODA ZIZKOV O OK"]


def test_many_to_one_refuses_two(spark):
    records = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, cluster int")
    one = spark.createDataFrame([(7, "a"), (8, "b")], "cluster int, name string")
    assert {r.id: r.name for r in resolution.many_to_one(records, one, "cluster").collect()} == {1: "a", 2: "b", 3: None}
    with pytest.raises(Exception, match="twice"):
        resolution.many_to_one(records, one.unionByName(one), "cluster").collect()


def test_numbers_follow_the_order(spark):
    frame = spark.createDataFrame([(k * 7 % 101, "x") for k in range(100)], "v int, x string").repartition(5)
    assert [(r.id, r.v) for r in resolution.numbered(frame, ["v"]).orderBy("id").collect()] == list(enumerate(sorted(k * 7 % 101 for k in range(100)), start=1))


def test_bad_intervals_fail(spark):
    row = {"id": "1", "profile": "driving", "zone": "Old Town", "day_of_week": "Monday", "start_time": "07:00", "end_time": "09:30", "multiplier": "1.2"}
    got = clock.checked_intervals(spark.createDataFrame([row]), "driving").first()
    assert (got.zone, got.days, got.start_min, got.end_min, got.multiplier) == ("old_town", "monday", 420, 570, 1.2)
    for key, value in (("day_of_week", "someday"), ("start_time", "25:00"), ("multiplier", "0"), ("multiplier", "x")):
        with pytest.raises(Exception, match="no (day|clock time|multiplier)"):
            clock.checked_intervals(spark.createDataFrame([row | {key: value}]), "driving").collect()


def test_outputs_by_level_and_whole_files(spark, tmp_path):
    tables = {k: spark.range(1) for k in ("integrity", "routing_detail", "stages")}
    assert sorted(sinks.chosen_outputs(tables)) == ["integrity"] and sinks.chosen_outputs(tables, "none") == {}
    assert sorted(sinks.chosen_outputs(tables, "full", profile=True)) == ["integrity", "routing_detail", "stages"]
    with pytest.raises(ValueError, match="level"):
        sinks.chosen_outputs(tables, "some")
    path = tmp_path / "run.json"
    sinks.write_json({"b": 1, "a": sinks.provenance({"x": 1}, [__file__])}, str(path))
    back = json.loads(path.read_text())
    assert back["a"]["settings_sha256"] == sinks.payload_hash({"x": 1}) and len(back["a"]["inputs_sha256"][__file__]) == 64 and not (tmp_path / "run.json.tmp").exists()


def test_pages_until_one_is_short(spark):
    for n in (0, 5, 200, 201):
        assert files.read_pages(spark, files.CountingSource(n), page=50, wave=2).count() == n


def test_instances_by_id_seed_and_old_name(spark, tmp_path):
    for name in ("c_low_10", "c_low_10_7", "own"):
        (tmp_path / f"{name}.csv").write_text("a\n")
    find = lambda **x: files.resolve_instance(spark, str(tmp_path), "c", "low", 10, **x).rsplit("/", 1)[1]
    assert (find(instance="own"), find(seed=7), find(seed=8), find()) == ("own.csv", "c_low_10_7.csv", "c_low_10.csv", "c_low_10.csv")
    with pytest.raises(FileNotFoundError):
        find(instance="absent")


def test_rays_are_cast_by_many_tasks_once_a_place(spark, monkeypatch):
    cut, seen = zones.cut, []
    monkeypatch.setattr(zones, "cut", lambda frame: seen.append((frame.rdd.mapPartitions(lambda part: [any(True for _ in part)]).filter(bool).count(), frame.count())) or cut(frame))
    points = spark.range(2000).select("id", (F.col("id") % 50 / 50.0).alias("lon"), F.lit(0.5).alias("lat")).repartition(1)
    square = spark.createDataFrame([("a", [[(0.1, 0.0), (0.7, 0.0), (0.7, 1.0), (0.1, 1.0)]])], f"zone string, rings {zones.RINGS}")
    got = sorted(r.id for r in zones.zones_of_points(points, square).collect())
    assert got == [k for k in range(2000) if 0.1 <= k % 50 / 50.0 < 0.7]
    assert seen[0][0] > 4 and seen[0][1] == 30
