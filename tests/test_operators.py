"""Operators beyond the catalogue: errors, documents, datasets, streams, generator, validation."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citytables.functions import arrays, attributes, spatial
from citytables.operators import extent, filters, generate, index, merge, selection, validate
from citytables.schema import LODS, TABLES
from citytables.sources import dataset, document
from citytables.streaming import sequence

DOC = {
    "type": "Town", "version": "2.0.1", "transform": {"scale": [0.25, 0.25, 1.0], "translate": [10.0, 20.0, 0.0]},
    "CityObjects": {
        "b": {"type": "Building", "attributes": {"levels": 2}, "children": ["p"], "geometry": [{"type": "MultiSurface", "lod": "2.2", "boundaries": [[[0, 1, 2, 3]], [[0, 1, 4], [1, 2, 4]]]}]},
        "p": {"type": "BuildingPart", "parents": ["b"], "geometry": [{"type": "MultiPoint", "lod": "1", "boundaries": [4, 0]}, {"type": "Solid", "lod": "2", "boundaries": [[[[0, 1, 2]], [[1, 2, 3]]]]}]},
    },
    "vertices": [[0, 0, 0], [4, 0, 0], [4, 4, 0], [0, 4, 0], [2, 2, 3]],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d", json.dumps(DOC))], "doc_key string, value string")


def test_document(spark, docs):
    checked = document.checked(docs)
    assert checked.first()["version"] == "2.0"
    objects = document.cityobjects(checked)
    assert [(r["cityobject_id"], r["object_type"], r["parents"]) for r in objects.orderBy("ix").collect()] == [("b", "Building", None), ("p", "BuildingPart", ["b"])]
    assert [tuple(r) for r in document.relations(objects).collect()] == [("d", "b", 0, "p")]
    g = {(r["cityobject_id"], r["geometry_ordinal"]): r for r in document.geometries(objects).collect()}
    assert (g["b", 0]["vertex_indices"], g["b", 0]["ring_offsets"], g["b", 0]["surface_offsets"]) == ([0, 1, 2, 3, 0, 1, 4, 1, 2, 4], [0, 4, 7], [0, 1])
    assert g["p", 0]["vertex_indices"] == [4, 0] and g["p", 1]["shell_offsets"] == [0] and g["p", 1]["ring_offsets"] == [0, 3]
    v = document.vertices(docs)
    assert tuple(v.where("vertex_id = 4").first()) == ("d", 4, 10.5, 20.5, 3.0)
    t = document.auto_transform(v, (0.25, 0.25, 1.0))
    assert [tuple(r)[1:] for r in document.quantized(v.drop("doc_key"), t).select("vertex_id", "qx", "qy", "qz").where("vertex_id = 2").collect()] == [(4, 4, 0)]


@pytest.mark.parametrize("change, error", [({"version": None}, "expected"), ({"version": "1.1"}, "unsupported"), ({"CityObjects": {"x": {"type": "Castle"}}}, "unknown object type"), ({"CityObjects": {"x": {"type": "Road", "children": ["y"]}}}, "unknown object: y")])
def test_document_errors(spark, change, error):
    d = document.checked(spark.createDataFrame([("d", json.dumps(DOC | change))], "doc_key string, value string"))
    with pytest.raises(PySparkException, match=error):
        o = document.cityobjects(d)
        o.collect(), document.relations(o).collect(), d.collect()


def test_sequence_files(spark, docs, tmp_path):
    header = spark.createDataFrame([(json.dumps({k: v for k, v in DOC.items() if k not in ("CityObjects", "vertices")} | {"CityObjects": {}, "vertices": []}),)], "value string")
    features = spark.createDataFrame([(i, json.dumps({"type": "TownFeature", "id": f"f{i}", "CityObjects": {f"f{i}": {"type": "Road"}}, "vertices": []})) for i in (2, 0, 1)], "ix long, value string")
    document.write_sequence(header, features, f"{tmp_path}/seq")
    lines = document.read_sequence(spark, f"{tmp_path}/seq").orderBy("line").collect()
    assert [json.loads(r["value"]).get("id") for r in lines] == [None, "f0", "f1", "f2"]
    with pytest.raises(ValueError):
        document.read_documents(spark, f"{tmp_path}/x.jsonl")
    stream = sequence.read_feature_stream(spark, f"{tmp_path}/seq", header.first()[0])
    q = sequence.summary_stream(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable(), q.stop()
    assert tuple(spark.sql("select * from sums").first()) == (3, 3)
    q = sequence.failing_on_duplicates(stream).writeStream.format("memory").queryName("ids").start()
    q.processAllAvailable()
    assert spark.sql("select * from ids").count() == 3
    features.where("ix = 1").select("value").write.mode("append").text(f"{tmp_path}/seq")
    with pytest.raises(Exception, match="duplicate feature: f1"):
        q.processAllAvailable()
    q.stop()


def test_dataset_round_trip(spark, tmp_path):
    made = generate.generate(spark, generate.GenerateConfig(objects=20), seed=1)
    tables = {n: (made[n] if n in made else spark.createDataFrame([], dataset.schema_of(n))) for n in TABLES if n in made or n == "metadata"}
    manifest = dataset.write_dataset(spark, tables, f"{tmp_path}/ds")
    assert [t["name"] for t in manifest["tables"]] == [n for n in TABLES if n in tables]
    back = dataset.read_dataset(spark, f"{tmp_path}/ds")
    assert back["vertices"].count() == 20 * 2 * 16 and sorted(map(str, back["cityobjects"].collect())) == sorted(map(str, tables["cityobjects"].collect()))
    again = generate.generate(spark, generate.GenerateConfig(objects=20), seed=1)
    assert again["vertices"].exceptAll(back["vertices"]).isEmpty()
    assert validate.violations(back["geometries"], back["geometry_boundaries"], back["vertices"]).isEmpty()
    for broken in ({"tables": manifest["tables"][1:]}, {"tables": manifest["tables"][::-1]}, {"tables": [manifest["tables"][0] | {"path": "../x"}, *manifest["tables"][1:]]}, {"tables": [{"name": "x", "path": "x"}]}):
        with pytest.raises(ValueError):
            dataset.validate_manifest(broken)
    dataset.to_arrow_file(back["semantics"], f"{tmp_path}/s.arrow")
    assert dataset.from_arrow_file(spark, f"{tmp_path}/s.arrow").count() == 3


def test_violations(spark):
    g = spark.createDataFrame([(1, "MultiSurface"), (2, "Solid"), (3, "MultiPoint"), (4, "MultiSurface")], "geometry_id long, geometry_type string")
    b = spark.createDataFrame(
        [(1, [0, 1, 2], None, [0, 3], [0], None, None), (2, [0, 1, 2], None, [0], [0], None, None), (3, [0, 9], None, None, None, None, None)],
        "geometry_id long, vertex_indices array<int>, line_offsets array<int>, ring_offsets array<int>, surface_offsets array<int>, shell_offsets array<int>, solid_offsets array<int>",
    )
    v = spark.range(5).withColumnRenamed("id", "vertex_id")
    got = {(r["geometry_id"], r["rule"]) for r in validate.violations(g, b, v).collect()}
    assert got == {(1, "empty ring"), (2, "shell level is required"), (2, "type doesn't match the boundary"), (3, "vertex doesn't exist"), (4, "boundary is absent")}


def test_cycles_and_errors(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("g", "b")], "parent_id string, child_id string")
    o = spark.createDataFrame([(x, i) for i, x in enumerate("abcg")], "cityobject_id string, ix long")
    assert {r[0] for r in selection.closure(e, o.where("cityobject_id = 'a'")).collect()} == set("abc")
    for ids in ([], ["zz"]):
        with pytest.raises(ValueError):
            selection.subset(o, e, ids)
    geo = spark.createDataFrame([(1, "a")], "geometry_id long, cityobject_id string")
    with pytest.raises(PySparkException, match="geometry that its object"):
        selection.extract(o, e, geo, selection.select_objects(o, F.col("ix") == 0).withColumn("whole", F.lit(False)).withColumn("geometry_ids", F.array(F.lit(7).cast("long"))))[2].collect()
    with pytest.raises(ValueError):
        selection.reroot(o, e, o.limit(0), None)
    with pytest.raises(ValueError):
        index.keyset_page(o, None, 0)
    typed = o.withColumn("object_type", F.lit("Road"))
    with pytest.raises(ValueError):
        filters.ensure_lods(typed, geo.withColumn("lod", F.lit("2")), {"Road": "2.0"})
    with pytest.raises(PySparkException, match="duplicate object"):
        merge.append_strict(o, o).collect()


def test_merging(spark):
    kinds = "cityobject_id string, object_type string, attributes string, geographical_extent array<double>, cityobject_ix long"
    a = spark.createDataFrame([("x", "Road", '{"a":1,"b":{"c":[1]}}', [0.0] * 3 + [1.0] * 3, 0)], kinds)
    b = spark.createDataFrame([("x", "Road", '{"a":2}', [-1.0] * 3 + [0.5] * 3, 0), ("y", "Road", None, None, 1)], kinds)
    m = {r["cityobject_id"]: r for r in merge.merge_objects(a, b).collect()}
    assert m["x"]["geographical_extent"] == [-1.0] * 3 + [1.0] * 3 and json.loads(m["x"]["attributes"])["a"] == 2 and m["y"]["attributes"] is None
    with pytest.raises(PySparkException, match="types differ"):
        merge.merge_objects(a, b.withColumn("object_type", F.lit("Bridge"))).collect()
    v = spark.createDataFrame([(0, 1.0), (1, 2.0)], "vertex_id long, x double")
    g = spark.createDataFrame([(0, [0, 1])], "geometry_id long, vertex_indices array<int>")
    ids = spark.createDataFrame([(0, "Road")], "geometry_id long, geometry_type string")
    both = merge.append_pools({"vertices": v, "geometry_boundaries": g, "geometries": ids}, {"vertices": v, "geometry_boundaries": g, "geometries": ids})
    assert sorted(map(tuple, both["geometry_boundaries"].collect())) == [(0, [0, 1]), (1, [2, 3])]
    x = spark.createDataFrame([("n", "u", "1")], "extension_name string, uri string, version string")
    assert tuple(merge.merge_extensions(x, x.withColumn("version", F.lit("2"))).first()) == ("n", "u", "2")
    with pytest.raises(PySparkException, match="extensions differ"):
        merge.merge_extensions(x, x.withColumn("version", F.lit("2")), strict=True).collect()


def test_attributes(spark):
    rows = ['{"a":1,"b":[1,2.5],"c":{"d":null}}', '{"a":-2,"b":[],"e":"x"}', '{"a":1.5,"c":{"d":true,"f":1},"e":{"q":1}}']
    df = spark.createDataFrame(list(enumerate(rows)), "id int, attrs string")
    spec = attributes.infer(df, "attrs")
    assert {k: (v.kind, v.nullable) for k, v in spec.fields.items()} == {"a": ("float", False), "b": ("list", True), "c": ("map", True), "e": ("json", True)}
    assert spec.fields["b"].item.kind == "float" and spec.fields["c"].fields["d"].kind == "bool"
    assert attributes.project(df, "attrs", spec).orderBy("id").first()["attributes"]["b"] == [1.0, 2.5]
    assert attributes.infer(df.limit(0), "attrs") is None
    got = {k: [r["value"] for r in attributes.extract_column(df, "id", "attrs", "a", k).collect()] for k in ("unsigned", "integer", "float")}
    assert got == {"unsigned": [1], "integer": [-2], "float": [1.5]}
    assert spark.range(1).select(attributes.project_i64(F.lit("18446744073709551615").cast("decimal(20,0)"))).first()[0] == 2**63 - 1


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(*[spatial.quantize(F.lit(x)) for x in (2.5, -2.5, 0.4)]).first()[0:3] == (3, -3, 0)
    cells = spark.createDataFrame([(x, y) for x in range(8) for y in range(8)], "x int, y int").select("x", "y", spatial.hilbert(F.col("x"), F.col("y"), 3).alias("d")).orderBy("d").collect()
    assert [r["d"] for r in cells] == list(range(64)) and all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(cells, cells[1:]))
    two = {(r["x"], r["y"]): r["d"] for r in spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "x int, y int").select("x", "y", spatial.hilbert(F.col("x"), F.col("y"), 1).alias("d")).collect()}
    assert two == {(0, 0): 0, (0, 1): 1, (1, 1): 2, (1, 0): 3}
    assert len(LODS) == 20
    with pytest.raises(PySparkException, match="level of detail"):
        one.select(spatial.parse_lod(F.lit("2.9"))).collect()
    r = one.select(arrays.fan(F.array(F.lit(1), F.lit(2))), arrays.resized(F.array(F.lit(1)), F.lit(3)), spatial.box_union(F.lit(None).cast("array<double>"), F.array(*[F.lit(1.0)] * 6))).first()
    assert r[0] == [] and r[1] == [1, None, None] and r[2] == [1.0] * 6
    i = spark.createDataFrame([(1, 5, None, 1.0, 2.0, 3.0)], "geometry_id long, template_geometry_id long, transform_matrix array<double>, rx double, ry double, rz double")
    t = spark.createDataFrame([(5, 0.0, 0.0, 0.0), (5, 1.0, 1.0, 1.0)], "template_geometry_id long, x double, y double, z double")
    assert tuple(extent.instance_extents(i, t).first()) == (1, 1.0, 2.0, 3.0, 2.0, 3.0, 4.0)


def _joined(plan):
    """The largest number of rows that a join of a finished plan (without adaptive execution) made."""
    kids = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.getClass().getSimpleName() else 0
    return max([own, *[_joined(kids.apply(i)) for i in range(kids.size())]])


def test_instances_of_a_large_template(spark):
    """Vertices aren't paired with each instance, and boxes are those of all points."""
    turn = [0.1, -0.7, 0.3, 100.0, 0.9, 0.2, -0.4, 50.0, -0.6, 0.1, 0.8, 0.0, 0.0, 0.0, 0.0, 1.0]
    dots = [(k % 2, (k * 37 % 91) / 7, (k * 53 % 83) / 3, (k * 29 % 101) / 9) for k in range(400)] + [(0, None, 900.0, 1.0), (1, 1.0, 2.0, float("inf")), (2, 5.0, 6.0, None)]
    placed = [(k, k % 4, [v * (1 + k % 3) for v in turn] if k % 5 else None, k / 7, -k / 3, k * 11.0) for k in range(300)] + [(7, 0, turn, -1e6, 0.0, 0.0)]
    i = spark.createDataFrame(placed, "geometry_id bigint, template_geometry_id bigint, transform_matrix array<double>, rx double, ry double, rz double")
    t = spark.createDataFrame(dots, "template_geometry_id bigint, x double, y double, z double")
    x, y, z = spatial.affine(F.col("transform_matrix"), F.col("x"), F.col("y"), F.col("z"))
    want = i.join(t, "template_geometry_id").groupBy("geometry_id").agg(*spatial.box([x + F.col("rx"), y + F.col("ry"), z + F.col("rz")]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = extent.instance_extents(i, t)
        got = df.collect()
        assert _joined(df._jdf.queryExecution().executedPlan()) < 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect())) and len(got) == 226
