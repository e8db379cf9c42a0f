"""Merging of whole models: pools, objects, geometries, templates, metadata."""

import json

import pytest

from citytables.operators import merge
from citytables.sources import catalog, model
from citytables.sources.document import overlaid


def side(n_materials, n_textures, n_template_vertices, own, value, **more):
    """Two pieces of furniture with two instances each."""
    matrix = [float(i % 5 == 0) for i in range(16)]
    at = lambda a, b: [{"type": "GeometryInstance", "template": 0, "boundaries": [v], "transformationMatrix": matrix} for v in (a, b)]
    ring = list(range(n_template_vertices))
    return {
        "type": "Town", "version": "2.0",
        "appearance": {"materials": [{"name": f"m{own}{i}"} for i in range(n_materials)], "textures": [{"type": "PNG", "image": f"{own}{i}.png"} for i in range(n_textures)]},
        "geometry-templates": {"templates": [{"type": "MultiSurface", "lod": "2", "boundaries": [[ring]], "material": {"x": {"values": [n_materials - 1]}}}], "vertices-templates": [[float(i), float(i % 3), 0.5] for i in ring]},
        "CityObjects": {
            "bench": {"type": "CityFurniture", "attributes": {"seats": 2, "made": {"by": [own]}, own: value}, "geometry": at(0, 1), **more},
            own: {"type": "CityFurniture", "geometry": at(2, 3)},
        },
        "vertices": [[float(i), float(i), 1.0] for i in range(4)],
    }


def tables_of(spark, doc):
    return model.one_model(model.read_models(spark.createDataFrame([(0, json.dumps(doc))], "doc_key int, value string")), 0)


def text_of(tables):
    return json.loads(model.write_models(model.keyed(tables, 0)).first()["value"])


def test_two_models(spark):
    left, right = side(2, 2, 12, "lamp", True, geographicalExtent=[0, 0, 0, 1, 1, 1]), side(3, 2, 24, "bin", None, geographicalExtent=[-1, 0, 0, 1, 2, 1])
    right["metadata"], left["+a"], right["+b"] = {"title": "R"}, 1, [2]
    m = merge.merge_all([tables_of(spark, left), tables_of(spark, right)])
    counts = {n: m[n].count() for n in ("cityobjects", "geometry_instances", "template_geometries", "materials", "textures", "vertices", "template_vertices")}
    assert counts == {"cityobjects": 3, "geometry_instances": 8, "template_geometries": 2, "materials": 5, "textures": 4, "vertices": 8, "template_vertices": 36}
    doc = text_of(m)
    bench = doc["CityObjects"]["bench"]
    assert list(doc["CityObjects"]) == ["bench", "lamp", "bin"]
    assert bench["attributes"] == {"seats": 2, "made": {"by": ["bin"]}, "lamp": True, "bin": None} and bench["geographicalExtent"] == [-1, 0, 0, 1, 2, 1]
    assert [g["template"] for g in bench["geometry"]] == [0, 0, 1, 1] and [g["boundaries"] for g in bench["geometry"]] == [[0], [1], [4], [5]]
    assert [t["material"]["x"]["values"] for t in doc["geometry-templates"]["templates"]] == [[1], [4]]
    assert doc["metadata"]["title"] == "R" and doc["+a"] == 1 and doc["+b"] == [2]


def test_appended_objects_keep_their_geometries(spark):
    one = lambda name: {"type": "Town", "version": "2.0", "CityObjects": {name: {"type": "Road", "children": [f"{name}-part"], "geometry": [{"type": "MultiPoint", "lod": "1", "boundaries": [0]}]}, f"{name}-part": {"type": "Road"}}, "vertices": [[1.0, 2.0, 3.0]]}
    out = merge.append_pools(tables_of(spark, one("a")), tables_of(spark, one("b")))
    ix = {r["cityobject_id"]: r["cityobject_ix"] for r in out["cityobjects"].collect()}
    assert {r["cityobject_ix"] for r in out["geometries"].collect()} == {ix["a"], ix["b"]}
    assert {(r[0], r[2]) for r in out["cityobject_children"].collect()} == {(ix["a"], ix["a-part"]), (ix["b"], ix["b-part"])}
    with pytest.raises(Exception, match="duplicate object"):
        merge.append_pools(tables_of(spark, one("a")), tables_of(spark, one("a")))["cityobjects"].collect()


def test_refused(spark):
    a, b = side(1, 1, 3, "lamp", 1), side(1, 1, 3, "bin", 1)
    b["CityObjects"]["bench"]["type"] = "Road"
    with pytest.raises(Exception, match="types differ"):
        merge.merge_models(tables_of(spark, a), tables_of(spark, b))["cityobjects"].collect()
    with pytest.raises(Exception, match="kinds differ"):
        merge.merge_models(tables_of(spark, a), tables_of(spark, a | {"type": "Village"}))["metadata"].collect()
    with pytest.raises(ValueError):
        merge.merge_all([])


def test_values_keep_their_kinds(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":[1]},"n":null}', '{"a":2,"d":true}', '{"type":"T","version":"2.0","x":{"y":1}}')], "x string, y string, h string")
    row = df.select(merge.merged_attributes(df.x, df.y).alias("m"), overlaid(df.h, df.x).alias("o")).first()
    assert json.loads(row["m"]) == {"a": 2, "b": {"c": [1]}, "n": None, "d": True}
    assert json.loads(row["o"]) == {"a": 1, "b": {"c": [1]}, "n": None, "x": {"y": 1}}
    assert catalog.BOUNDS[0] == "min_x"


def test_dense_ranks(spark):
    got = merge.dense_ranks(spark.range(0, 300, 3).withColumnRenamed("id", "v").repartition(4), ["v"], "r").collect()
    assert sorted((r["v"], r["r"]) for r in got) == [(3 * i, i) for i in range(100)]
