"""GeoJSON, terrain and scenario documents."""

import json

import pytest

from gridwright.sources import files


def write(path, doc):
    path.write_text(json.dumps(doc))
    return str(path)


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_buildings_and_towers(spark, tmp_path):
    ring = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    b = files.read_buildings(spark, write(tmp_path / "b.json", {"features": [feature("Polygon", ring, id="", height="12.5"), feature("Polygon", ring, id="X", building="office", height="3")]})).orderBy("ord").collect()
    assert [(r.id, r.kind, r.height, len(r.ring)) for r in b] == [("B0", "yes", 12.5, 4), ("X", "office", 3.0, 4)]
    t = files.read_towers(spark, write(tmp_path / "t.json", {"features": [feature("Point", [101.0, 3.0], id="T1", range_m="0", battery_minutes="90")]})).first()
    assert (t.range_m, t.mhz, t.tier, t.battery_s) == (600.0, 2100.0, "edge", 5400.0)


def test_a_building_without_height_fails(spark, tmp_path):
    path = write(tmp_path / "b.json", {"features": [feature("Polygon", [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]], id="X")]})
    with pytest.raises(Exception, match="no height"):
        files.read_buildings(spark, path).collect()


def test_roads(spark, tmp_path):
    line = [[0.0, 0.0], [10.0, 0.0], [10.1, 0.0], [10.0, 20.0]]
    docs = {"features": [feature("LineString", line, name="A", highway="primary", oneway="yes"), feature("LineString", line[:2], name="B", highway="service", oneway="-1"), feature("LineString", line[:2], name="C")]}
    got = {(r.src, r.dst): r.name for r in files.read_roads(spark, write(tmp_path / "r.json", docs)).collect()}
    assert got == {("0:0", "20:0"): "C", ("20:0", "0:0"): "C", ("20:0", "20:40"): "A"}


def test_terrain_and_scenario(spark, tmp_path):
    z = files.read_terrain(spark, write(tmp_path / "z.json", {"nx": 2, "elevations": [1.0, 2.0, 3.0, 4.0]}))
    assert {(r.ix, r.iy): r.z for r in z.collect()} == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 3.0, (1, 1): 4.0}
    s = files.read_scenario(spark, write(tmp_path / "s.json", {"faults": [{"tower_id": "T1", "profile": "power_failure", "start_s": 180.0}]}))
    assert [tuple(r) for r in s.collect()] == [("T1", "power_failure", 180.0)]


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sorted(map(str, files.round_trip(df).collect())) == sorted(map(str, df.collect()))


def test_cache_follows_its_fingerprint(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string"), spark.createDataFrame([(2, None), (1, "x")], "k long, v string")
    key = files.fingerprint(a, "k", "v")
    assert len(key) == 16 and key == files.fingerprint(b, "k", "v") != files.fingerprint(a.where("k = 1"), "k", "v")
    assert files.cached(a, str(tmp_path), key).count() == 2
    assert files.cached(a.where("k = 1"), str(tmp_path), key).count() == 2
    assert files.cached(a.where("k = 1"), str(tmp_path), "other").count() == 1
