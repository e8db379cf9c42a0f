"""The feature catalogue: build, lookups, windows, pages, freshness."""

import json

import pytest

from citytables.sources.catalog import Catalog, build, layout_of

HEADER = {"type": "Town", "version": "2.0", "transform": {"scale": [0.25, 0.25, 1.0], "translate": [-4.0, 6.0, 0.0]}, "CityObjects": {}, "vertices": []}


def feature(name, vertices, used, **more):
    g = [{"type": "MultiSurface", "lod": "1", "boundaries": [[used]]}] if used else []
    return {"type": "TownFeature", "id": name, "CityObjects": {name: {"type": "Building", "geometry": g, **more}}, "vertices": vertices}


def written(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))


def test_catalog(spark, tmp_path):
    data = tmp_path / "data"
    two = feature("c", [[0, 0, 0]], [])
    two["CityObjects"]["d"] = {"type": "BuildingPart"}
    written(data / "a/x.jsonl", HEADER, feature("a", [[0, 0, 1], [2, 2, 2], [900, 900, 900]], [0, 1, 0]), feature("b", [[100, 100, 0]], []))
    written(data / "b/y.jsonl", HEADER, feature("a", [[40, 40, 0]], [0]), two)
    build(spark, f"file://{data}", f"file://{tmp_path}/cat")
    c = Catalog(spark, f"file://{tmp_path}/cat")
    assert tuple(c.counts().first()) == (2, 5, 7)
    assert sorted(r["feature_id"] for r in c.query(-4, 6, -3.5, 6.5).collect()) == ["a", "c", "d"]
    a = c.lookup("a").collect()
    assert len(a) == 2 and json.loads(c.get("a"))["id"] == "a" and c.get("zz") is None
    boxes = {(r["min_x"], r["max_x"], r["min_z"], r["max_z"]) for r in a}
    assert boxes == {(-4.0, -3.5, 1.0, 2.0), (6.0, 6.0, 0.0, 0.0)}
    ids = [r["id"] for r in c.page(None, 10).collect()]
    assert [r["id"] for r in c.page(ids[1], 2).collect()] == ids[2:4]
    assert [r["feature_id"] is None for r in c.rows([ids[3], -1, ids[0]]).collect()] == [False, True, False]
    assert c.bounds().first()["n"] == 5 and c.validate(f"file://{data}")
    (data / "a/x.jsonl").unlink()
    written(data / "b/z.jsonl", HEADER)
    assert sorted(r["issue"] for r in c.inspect(f"file://{data}").collect()) == ["missing", "unindexed"]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        build(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/cat2")


def test_large_package(spark, tmp_path):
    large = feature("a", [[0, 0, 0]], [])
    large["CityObjects"] |= {f"a{i}": {"type": "BuildingPart"} for i in range(5000)}
    written(tmp_path / "data/x.jsonl", HEADER, large, feature("b", [[0, 0, 0]], []), feature("c", [[1, 1, 0]], []))
    build(spark, f"file://{tmp_path}/data", f"file://{tmp_path}/cat")
    c = Catalog(spark, f"file://{tmp_path}/cat")
    ids = [r["id"] for r in c.page(None, 6000).collect()]
    assert len(ids) == len(set(ids)) == 5003
    assert len(c.page(ids[4096], 6000).collect()) == 5003 - 4097 and c.rows(ids[4090:4110]).count() == 20


def test_documents_and_feature_files(spark, tmp_path):
    surface = lambda *v: {"type": "MultiSurface", "lod": "1", "boundaries": [[list(v)]], "semantics": {"surfaces": [{"type": "WallSurface"}], "values": [0]}}
    doc = HEADER | {
        "+note": {"a": 1},
        "CityObjects": {"a": {"type": "Building", "children": ["a1"], "geometry": [surface(3, 1, 2)]}, "a1": {"type": "BuildingPart", "parents": ["a"], "geometry": [surface(5, 3, 5)]}, "b": {"type": "Road", "geometry": [surface(0, 4, 0)]}},
        "vertices": [[i, 2 * i, 1] for i in range(7)],
    }
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/one.json").write_text(json.dumps(doc))
    assert layout_of(spark, f"file://{tmp_path}/docs") == "documents"
    build(spark, f"file://{tmp_path}/docs", f"file://{tmp_path}/cat")
    c = Catalog(spark, f"file://{tmp_path}/cat")
    got = json.loads(c.get("a"))
    assert set(got["CityObjects"]) == {"a", "a1"} and got["id"] == "a" and got["+note"] == {"a": 1}
    assert got["CityObjects"]["a"]["geometry"][0]["boundaries"] == [[[2, 0, 1]]] and got["CityObjects"]["a1"]["geometry"][0]["boundaries"] == [[[3, 2, 3]]]
    assert got["vertices"] == [[-4 + 0.25 * i, 6 + 0.5 * i, 1.0] for i in (1, 2, 3, 5)]
    assert got["CityObjects"]["a"]["geometry"][0]["semantics"] == {"surfaces": [{"type": "WallSurface"}], "values": [0]}
    assert sorted(r["feature_id"] for r in c.query(-4, 6, -3.9, 6.1).collect()) == ["b"] and c.counts().first()["n_features"] == 3
    models = c.models(c.features)
    assert models["cityobjects"].count() == 3 and models["geometries"].count() == 3
    assert c.inspect(f"file://{tmp_path}/docs", "documents").isEmpty()

    meta = {k: v for k, v in HEADER.items()}
    for name, shift in (("", 0.0), ("deep/", 100.0)):
        folder = tmp_path / "files" / name
        (folder / "x").mkdir(parents=True)
        (folder / "metadata.json").write_text(json.dumps(meta | {"transform": {"scale": [1.0, 1.0, 1.0], "translate": [shift, 0.0, 0.0]}}))
        (folder / "x/f.jsonl").write_text(json.dumps(feature(f"f{name[:4]}", [[1, 1, 1]], [])) + "\n")
    assert layout_of(spark, f"file://{tmp_path}/files") == "features"
    build(spark, f"file://{tmp_path}/files", f"file://{tmp_path}/cat2")
    c = Catalog(spark, f"file://{tmp_path}/cat2")
    assert sorted((r["feature_id"], r["min_x"]) for r in c.features.collect()) == [("f", 1.0), ("fdeep", 101.0)]
    (tmp_path / "files/one.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="several layouts"):
        layout_of(spark, f"file://{tmp_path}/files")
