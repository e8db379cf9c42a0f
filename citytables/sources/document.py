"""JSON documents, features and feature sequences as tables, and back.

A document (or feature) is one JSON text a row; everything is parsed in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.functions.arrays import flatten_levels
from citytables.functions.spatial import dequantize, parse_lod, parse_object_type, parse_version, quantize
from citytables.schema import GEOMETRY_TYPES

#: Members of a header that features of a sequence don't take over.
OWN = ("type", "version", "CityObjects", "vertices", "id")



def is_feature(value: Column) -> Column:
    """Whether a root is a feature: it has an id and no version of its own. Else it is a document, or the header of a sequence."""
    return F.get_json_object(value, "$.id").isNotNull() & F.get_json_object(value, "$.version").isNull()


def is_document(value: Column) -> Column:
    return F.get_json_object(value, "$.type").isNotNull() & F.get_json_object(value, "$.version").isNotNull()


def probe(value: Column) -> list[Column]:
    """Kind and version of a text, without reading the rest of it."""
    return [F.get_json_object(value, "$.type").alias("kind"), F.get_json_object(value, "$.version").alias("version")]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and value of whole-file documents; files of sequences (.jsonl) are refused."""
    if path.endswith(".jsonl"):
        raise ValueError("a sequence is no document")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """path, line (by order in the file) and value of the lines of sequences; blank lines are passed over."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    return lines.where(F.trim("value") != "").drop("block")


def checked(docs: DataFrame, kind: str | None = None, feature: bool = False) -> DataFrame:
    """Documents (or features); another root, another kind if one is given, or for documents an unknown version, is an error while reading.

    A feature needs an id.
    """
    is_kind = F.get_json_object("value", "$.type")
    good = is_feature(F.col("value")) if feature else is_document(F.col("value"))
    if kind is not None:
        good = good & (is_kind == kind)
    expected = kind or ("a feature with an id" if feature else "a document with a version")
    value = F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected}, found "), F.coalesce(is_kind, F.lit("nothing")))))
    out = docs.withColumn("value", value)
    return out if feature else out.withColumn("version", parse_version(F.get_json_object("value", "$.version")))


def overlay(header: Column, feature: Column) -> Column:
    """A feature with the header's members below its own; kind and content of the header stay out."""
    kinds = "map<string,string>"
    base = F.map_filter(F.from_json(header, kinds), lambda k, _: ~k.isin(*OWN))
    own = F.map_filter(F.from_json(feature, kinds), lambda k, _: k != "version")
    return F.map_zip_with(base, own, lambda _, a, b: F.coalesce(b, a))


def overlaid(header: Column, feature: Column) -> Column:
    """The same as JSON text: every member keeps its kind. Without a header the feature alone."""
    kinds = "map<string,variant>"
    base = F.coalesce(F.map_filter(F.from_json(header, kinds), lambda k, _: ~k.isin(*OWN)), F.create_map().cast(kinds))
    own = F.map_filter(F.from_json(feature, kinds), lambda k, _: k != "version")
    return F.to_json(F.map_zip_with(base, own, lambda _, a, b: F.coalesce(b, a)))


def root(docs: DataFrame) -> DataFrame:
    """doc_key and the members of each document as JSON texts."""
    return docs.select("doc_key", F.from_json("value", "map<string,string>").alias("m"))


def cityobjects(docs: DataFrame) -> DataFrame:
    """doc_key, cityobject_id, ix (place in the document) and the members of every object."""
    entries = root(docs).select("doc_key", F.posexplode(F.map_entries(F.from_json(F.col("m")["CityObjects"], "map<string,string>"))).alias("ix", "e"))
    geometry = f"array<struct<{','.join(':'.join(c.split(' ', 1)) for c in ('type string', 'lod string', 'boundaries string', 'semantics string', 'material string', 'texture string', 'template int', 'transformationMatrix array<double>'))}>>"
    parsed = entries.withColumn("o", F.from_json("e.value", f"struct<type:string,geographicalExtent:array<double>,attributes:string,parents:array<string>,children:array<string>,geometry:{geometry}>"))
    return parsed.select(
        "doc_key", F.col("e.key").alias("cityobject_id"), "ix", parse_object_type(F.col("o.type")).alias("object_type"), F.col("o.geographicalExtent").alias("geographical_extent"),
        F.col("o.attributes").alias("attributes"), F.col("o.parents").alias("parents"), F.col("o.children").alias("children"), F.col("o.geometry").alias("geometry"),
    )


def relations(objects: DataFrame) -> DataFrame:
    """doc_key, parent_id, child_ordinal, child_id; a child that doesn't exist is an error."""
    edges = objects.select("doc_key", F.col("cityobject_id").alias("parent_id"), F.posexplode("children").alias("child_ordinal", "child_id"))
    there = objects.select("doc_key", F.col("cityobject_id").alias("child_id"), F.lit(True).alias("there"))
    child = F.when(F.col("there"), F.col("child_id")).otherwise(F.raise_error(F.concat(F.lit("unknown object: "), "child_id")))
    return edges.join(there, ["doc_key", "child_id"], "left").select("doc_key", "parent_id", "child_ordinal", child.alias("child_id"))


def geometries(objects: DataFrame) -> DataFrame:
    """doc_key, cityobject_id, geometry_ordinal, type, lod and the boundary as vertex indices and offsets."""
    rows = objects.select("doc_key", "cityobject_id", F.posexplode("geometry").alias("geometry_ordinal", "g"))
    rows = rows.select("doc_key", "cityobject_id", "geometry_ordinal", F.col("g.type").alias("geometry_type"), parse_lod(F.col("g.lod")).alias("lod"), F.col("g.boundaries").alias("b"), "g.template", "g.transformationMatrix")
    names = ["vertex_indices", "line_offsets", "ring_offsets", "surface_offsets", "shell_offsets", "solid_offsets"]
    value = {n: F.lit(None).cast("array<int>") for n in names}
    for kind, depth in GEOMETRY_TYPES.items():
        if not depth:
            continue
        nested = F.from_json("b", "array<" * depth + "int" + ">" * depth)
        flat = flatten_levels(nested, depth)
        own = ["vertex_indices", *(["line_offsets"] if depth == 2 else ["ring_offsets", "surface_offsets", "shell_offsets", "solid_offsets"][: depth - 1])]
        for name, column in zip(own, [flat[0], *flat[1:]], strict=True):
            value[name] = F.when(F.col("geometry_type") == kind, column).otherwise(value[name])
    return rows.select("doc_key", "cityobject_id", "geometry_ordinal", "geometry_type", "lod", *[value[n].alias(n) for n in names], "template", F.col("transformationMatrix").alias("transform_matrix"))


def vertices(docs: DataFrame) -> DataFrame:
    """doc_key, vertex_id, x, y, z in world coordinates."""
    r = root(docs).select("doc_key", F.from_json(F.col("m")["transform"], "struct<scale:array<double>,translate:array<double>>").alias("t"), F.posexplode(F.from_json(F.col("m")["vertices"], "array<array<double>>")).alias("vertex_id", "v"))
    world = [dequantize(F.col("v")[i], F.coalesce(F.col("t.scale")[i], F.lit(1.0)), F.coalesce(F.col("t.translate")[i], F.lit(0.0))).alias(a) for i, a in enumerate("xyz")]
    return r.select("doc_key", F.col("vertex_id").cast("bigint").alias("vertex_id"), *world)


def duplicate_ids(objects: DataFrame) -> DataFrame:
    """Object ids that several items of a sequence have."""
    return objects.groupBy("cityobject_id").agg(F.count_distinct("doc_key").alias("n")).where("n > 1")


def auto_transform(rows: DataFrame, scale: tuple[float, float, float]) -> DataFrame:
    """One row: the given scale, and the least coordinates (0 without any) as translate."""
    return rows.agg(F.array(*[F.lit(float(s)) for s in scale]).alias("scale"), F.array(*[F.coalesce(F.min(a), F.lit(0.0)) for a in "xyz"]).alias("translate"))


def quantized(rows: DataFrame, transform: DataFrame) -> DataFrame:
    """rows with qx, qy, qz by a transform of one row."""
    t = rows.crossJoin(F.broadcast(transform))  # one row
    return t.withColumns({f"q{a}": quantize(F.col(a), F.col("scale")[i], F.col("translate")[i]) for i, a in enumerate("xyz")}).drop("scale", "translate")


def write_sequence(header: DataFrame, features: DataFrame, path: str) -> None:
    """Header (value) first, then features (ix, value) in order, one a line, as one file."""
    lines = header.select(F.lit(-1).cast("bigint").alias("ix"), "value").unionByName(features.select(F.col("ix").cast("bigint"), "value"))
    lines.repartitionByRange(1, "ix").sortWithinPartitions("ix").select("value").write.text(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Each document (value) as a line of text files."""
    docs.select("value").write.text(path)
