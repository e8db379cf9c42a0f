"""Whole documents to canonical tables and back, on a document made for the purpose."""

import json

import pytest

from citytables.schema import TABLES
from citytables.sources import model

CUBE = [[[0, 1, 2, 3]], [[4, 5, 6, 7]], [[0, 1, 5, 4]], [[1, 2, 6, 5], [8, 9, 10]]]
DOC = {
    "type": "Town",
    "version": "2.0",
    "transform": {"scale": [0.25, 0.5, 2.0], "translate": [7.0, -3.0, 1.0]},
    "+survey": {"year": 1999, "by": ["a", None]},
    "metadata": {"identifier": "town-9", "title": "A \"town\"", "geographicalExtent": [7, -3, 1, 9, 3, 5], "pointOfContact": {"contactName": "Jo", "emailAddress": "jo@example.org"}, "+note": 2.5},
    "extensions": {"Noise": {"url": "https://example.org/noise.json", "version": "1.1"}},
    "appearance": {
        "materials": [{"name": "brick", "diffuseColor": [0.5, 0.25, 0.0], "isSmooth": False}, {"name": "glass", "transparency": 0.5}],
        "textures": [{"type": "PNG", "image": "t/0.png", "wrapMode": "wrap"}],
        "vertices-texture": [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]],
        "default-theme-material": "day",
        "default-theme-texture": "photo",
    },
    "geometry-templates": {"templates": [{"type": "MultiSurface", "lod": "2", "boundaries": [[[0, 1, 2]]], "material": {"day": {"value": 1}}}], "vertices-templates": [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.5]]},
    "CityObjects": {
        "house": {
            "type": "Building", "attributes": {"storeys": 3, "height": 7.5, "tags": ["x", {"y": None}], "none": None, "open": True}, "children": ["roof-part", "porch"], "geographicalExtent": [7, -3, 1, 8, 1, 5],
            "geometry": [
                {
                    "type": "Solid", "lod": "2.1", "boundaries": [CUBE[:3], CUBE[3:]],
                    "semantics": {"surfaces": [{"type": "WallSurface", "children": [1]}, {"type": "Window", "parent": 0, "size": 1.5}, {"type": "RoofSurface"}], "values": [[0, 1, None], [2]]},
                    "material": {"day": {"values": [[0, 0, None], [1]]}, "night": {"value": 1}},
                    "texture": {"photo": {"values": [[[[0, 0, 1, 2, 3]], [[None]], [[None]]], [[[0, 3, 2, 1, 0], [None]]]]}},
                },
                {"type": "MultiPoint", "lod": "0", "boundaries": [0, 3], "semantics": {"surfaces": [{"type": "GroundSurface"}], "values": [None, 0]}},
            ],
        },
        "roof-part": {"type": "BuildingPart", "parents": ["house"], "+age": 12, "geometry": [{"type": "MultiLineString", "lod": "1", "boundaries": [[0, 1], [1, 2, 3]]}, {"type": "MultiSolid", "lod": "3", "boundaries": [[[[[0, 1, 2]]]], [[[[4, 5, 6]], [[5, 6, 7]]]]], "semantics": {"surfaces": [{"type": "WallSurface"}], "values": [[[0]], [[None, 0]]]}}]},
        "porch": {"type": "BuildingInstallation", "parents": ["house"]},
        "tree": {"type": "SolitaryVegetationObject", "geometry": [{"type": "GeometryInstance", "template": 0, "boundaries": [2], "transformationMatrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]}]},
    },
    "vertices": [[0, 0, 0], [4, 0, 0], [4, 8, 0], [0, 8, 0], [0, 0, 2], [4, 0, 2], [4, 8, 2], [0, 8, 2], [1, 1, 1], [2, 1, 1], [1, 2, 1]],
}
PLAIN = {"type": "Town", "version": "2.0", "CityObjects": {}, "vertices": []}


def tables_of(spark, *docs):
    return model.read_models(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_key int, value string"))


def rows(tables):
    return {n: sorted(map(repr, (r.asDict(recursive=True) for r in df.collect()))) for n, df in tables.items()}


def test_a_document_as_tables(spark):
    t = tables_of(spark, DOC)
    assert list(t) == list(TABLES)
    counts = {n: df.count() for n, df in t.items()}
    assert counts == {
        "metadata": 1, "extensions": 1, "vertices": 11, "template_vertices": 3, "texture_vertices": 4, "semantics": 5, "semantic_children": 1, "materials": 2, "textures": 1,
        "template_geometry_boundaries": 1, "template_geometry_semantics": 0, "template_geometry_materials": 1, "template_geometry_ring_textures": 0, "template_geometries": 1, "geometry_boundaries": 4,
        "geometry_surface_semantics": 7, "geometry_point_semantics": 2, "geometry_linestring_semantics": 0, "geometry_surface_materials": 7, "geometry_ring_textures": 2, "geometry_instances": 1,
        "geometries": 4, "cityobjects": 4, "cityobject_children": 2,
    }
    meta = t["metadata"].first()
    assert meta["identifier"] == "town-9" and json.loads(meta["root_extra"]) == {"+survey": DOC["+survey"]} and json.loads(meta["metadata_extra"]) == {"+note": 2.5}
    assert json.loads(meta["point_of_contact"])["contactName"] == "Jo" and meta["default_material_theme"] == "day"
    house = t["cityobjects"].where("cityobject_id = 'house'").first()
    assert json.loads(house["attributes"]) == DOC["CityObjects"]["house"]["attributes"] and house["cityobject_ix"] == 0
    assert [(r["surface_ordinal"], r["semantic_id"]) for r in t["geometry_surface_semantics"].where("geometry_id = 0").orderBy("surface_ordinal").collect()] == [(0, 0), (1, 1), (2, None), (3, 2)]
    assert [(r["surface_ordinal"], r["ring_ordinal"], r["texture_id"], list(r["uv_indices"])) for r in t["geometry_ring_textures"].orderBy("surface_ordinal").collect()] == [(0, 0, 0, [0, 1, 2, 3]), (3, 0, 0, [3, 2, 1, 0])]
    assert t["vertices"].where("vertex_id = 6").select("x", "y", "z").first() == (8.0, 1.0, 5.0)
    assert [r["doc_key"] for r in model.has_theme(t, "texture", "photo").collect()] == [0] and model.has_theme(t, "material", "photo").isEmpty()


def test_round_trip(spark):
    t = tables_of(spark, DOC, PLAIN)
    for scale in ((0.25, 0.5, 2.0), None):
        written = {r["doc_key"]: json.loads(r["value"]) for r in model.write_models(t, scale=scale).collect()}
        assert list(written[0]["CityObjects"]) == list(DOC["CityObjects"])
        if scale:
            want = json.loads(json.dumps(DOC))
            want["CityObjects"]["house"]["geometry"][0]["material"]["night"] = {"values": [[1, 1, 1], [1]]}
            want["geometry-templates"]["templates"][0]["material"]["day"] = {"values": [1]}
            assert written[0] == want
        assert written[1] == PLAIN | ({"transform": {"scale": [0.25, 0.5, 2.0], "translate": [0.0, 0.0, 0.0]}} if scale else {})
        again = tables_of(spark, written[0], written[1])
        assert rows(again) == rows(t)


def test_a_feature(spark):
    feature = {"type": "TownFeature", "id": "a", "CityObjects": {"a": {"type": "Road"}}, "vertices": []}
    t = tables_of(spark, feature)
    assert t["metadata"].first()["feature_root_id"] == "a"
    assert json.loads(model.write_models(t).first()["value"]) == feature


@pytest.mark.parametrize(
    "change, message",
    [
        ({"version": "9.9"}, "version"),
        ({"CityObjects": {"a": {"type": "Castle"}}}, "Castle"),
        ({"CityObjects": {"a": {"type": "Road", "children": ["b"]}}}, "unknown object"),
        ({"CityObjects": {"a": {"type": "Road", "geometry": [{"type": "Blob", "lod": "1", "boundaries": []}]}}}, "geometry type"),
        ({"type": "TownFeature", "id": "x"}, "names none"),
        ({"type": None}, "without a type"),
        ({"appearance": {"default-theme-material": "dusk"}}, "default theme"),
    ],
)
def test_errors(spark, change, message):
    with pytest.raises(Exception, match=message):
        t = tables_of(spark, PLAIN | change)
        [df.collect() for df in t.values()]
        model.write_models(t).collect()


def test_no_documents(spark):
    t = model.read_models(spark.createDataFrame([], "doc_key int, value string"))
    assert all(df.isEmpty() for df in t.values()) and model.write_models(t).isEmpty()


def feature(name, x, **more):
    return {"type": "TownFeature", "id": name, "CityObjects": {name: {"type": "Road", "geometry": [{"type": "MultiPoint", "lod": "1", "boundaries": [0, 1]}]}}, "vertices": [[x, 1.0, 2.0], [x + 0.5, 2.0, 2.0]], **more}


def test_sequence(spark, tmp_path):
    shared = {"appearance": DOC["appearance"] | {"default-theme-material": None, "default-theme-texture": None}, "extensions": DOC["extensions"], "+note": 1}
    shared["appearance"] = {k: v for k, v in shared["appearance"].items() if v is not None}
    t = tables_of(spark, feature("b", 4.0, **shared), feature("a", 8.0, **shared))
    report = model.write_feature_sequence(t, f"{tmp_path}/seq", "Town", scale=(0.5, 1.0, 1.0)).first()
    assert (report["features"], report["cityobjects"], report["translate"], report["geographical_extent"]) == (2, 2, [4.0, 1.0, 2.0], [4.0, 1.0, 2.0, 8.5, 2.0, 2.0])
    lines = [json.loads(x) for f in sorted((tmp_path / "seq").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["type"] for x in lines] == ["Town", "TownFeature", "TownFeature"] and [x.get("id") for x in lines] == [None, "b", "a"]
    assert lines[0]["CityObjects"] == {} and lines[0]["appearance"] == shared["appearance"] and lines[0]["transform"]["translate"] == [4.0, 1.0, 2.0]
    assert lines[2]["vertices"] == [[8, 0, 0], [9, 1, 0]] and "appearance" not in lines[1]
    from citytables.sources.document import read_sequence

    back = model.read_feature_sequence(read_sequence(spark, f"{tmp_path}/seq"))
    assert sorted((r["x"], r["y"]) for r in back["vertices"].collect()) == [(4.0, 1.0), (4.5, 2.0), (8.0, 1.0), (8.5, 2.0)]
    assert back["materials"].count() == 4 and back["metadata"].select("root_extra").distinct().count() == 1
    for other, message in ((feature("b", 1.0), "roots differ"), (feature("b", 1.0, **shared), "duplicate object"), (PLAIN, "no feature")):
        with pytest.raises(ValueError, match=message):
            model.checked_features(tables_of(spark, feature("b", 4.0, **shared), other))


def test_values(spark):
    from citytables.functions import values

    one = spark.createDataFrame([("wrap", "+Mine", [0.5, 0.25, 1.0], [0.0, 1.0, 2.0, 4.0, 5.0, 8.0], "a\r\n\n\u00e9b\nc")], "w string, s string, c array<double>, b array<double>, t string")
    r = one.select(values.parse_wrap_mode(one.w).alias("w"), values.parse_semantic_type(one.s).alias("s"), values.rgb(one.c).alias("c"), values.rgba(one.c).alias("d"), values.box_size(one.b).alias("z"), values.box_center(one.b).alias("m"), values.line_spans(one.t).alias("l")).first()
    assert (r["w"], r["s"], tuple(r["c"]), tuple(r["d"]), tuple(r["z"]), r["m"]) == ("wrap", "+Mine", (0.5, 0.25, 1.0), (0.5, 0.25, 1.0, 1.0), (4.0, 4.0, 6.0), [2.0, 3.0, 5.0])
    assert [tuple(x) for x in r["l"]] == [(0, "a"), (4, "\u00e9b"), (8, "c")]
    for f in (values.parse_wrap_mode, values.parse_texture_type, values.parse_image_type, values.parse_contact_role, values.parse_contact_type, values.parse_semantic_type):
        with pytest.raises(Exception, match="unknown"):
            one.select(f(one.t)).collect()


def test_tables_are_made_when_asked_for(spark, monkeypatch):
    """Documents are parsed where they were dealt to, not ahead of it; a table by itself writes only its own steps; large documents are numbered alike."""
    written, write = [], model.materialised
    monkeypatch.setattr(model, "materialised", lambda df: written.append(df) or write(df))
    docs = spark.createDataFrame([(0, json.dumps(DOC)), (1, json.dumps(PLAIN))], "doc_key int, value string").repartition(3, "doc_key")
    t = model.read_models(docs)
    assert t["cityobjects"].count() == 4 and not written
    few = {n: sorted(map(repr, t[n].collect())) for n in ("geometries", "semantics", "geometry_surface_materials")}
    for df in written:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan.partition("RepartitionByExpression")[2]
    monkeypatch.setattr(model, "FEW", 1)
    other = model.read_models(docs)
    assert {n: sorted(map(repr, other[n].collect())) for n in few} == few
