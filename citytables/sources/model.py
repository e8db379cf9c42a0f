"""Whole models: documents (or features) as canonical tables, and canonical tables as documents.

Every table has doc_key ahead of its canonical columns; ids are dense within a document. JSON is
parsed and written in the JVM: members whose type is open (attributes, unknown members) pass as variants,
so numbers, strings, lists and nulls keep their kind. A document is one row on both ways; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citytables.functions.arrays import bound, flatten_levels, unflatten
from citytables.functions.spatial import dequantize, parse_lod, parse_object_type, parse_version, quantize
from citytables.functions.values import parse_contact_role, parse_contact_type, parse_image_type, parse_semantic_type, parse_texture_type, parse_wrap_mode
from citytables.schema import GEOMETRY_TYPES, TABLES
from citytables.session import materialised
from citytables.sources.dataset import schema_of

#: Members that the format gives a meaning to; others are kept as extra members.
ROOT = ("type", "version", "id", "transform", "CityObjects", "vertices", "appearance", "geometry-templates", "metadata", "extensions")
OBJECT = ("type", "geographicalExtent", "attributes", "parents", "children", "geometry")
SEMANTIC = ("type", "parent", "children")
METADATA = {"identifier": "identifier", "title": "title", "referenceSystem": "reference_system", "referenceDate": "reference_date"}
MATERIAL = {
    "name": ("name", "string"), "ambientIntensity": ("ambient_intensity", "double"), "diffuseColor": ("diffuse_color", "array<double>"), "emissiveColor": ("emissive_color", "array<double>"),
    "specularColor": ("specular_color", "array<double>"), "shininess": ("shininess", "double"), "transparency": ("transparency", "double"), "isSmooth": ("is_smooth", "boolean"),
}
TEXTURE = {"image": ("image_uri", "string"), "type": ("image_type", "string"), "wrapMode": ("wrap_mode", "string"), "textureType": ("texture_type", "string"), "borderColor": ("border_color", "array<double>")}
OFFSETS = ("vertex_indices", "line_offsets", "ring_offsets", "surface_offsets", "shell_offsets", "solid_offsets")

_VARIANTS = "map<string,variant>"
_GEOMETRY = "type:string,lod:string,boundaries:string,semantics:struct<surfaces:array<map<string,variant>>,values:string>,material:map<string,struct<value:string,values:string>>,texture:map<string,struct<values:string>>,template:bigint,transformationMatrix:array<double>"


#: Objects of a document up to which their geometries are numbered in its row; those of larger ones are numbered by a window.
FEW = 256


class Tables(Mapping):
    """Tables by name. Each is planned, and the steps that it shares with others are written, when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __or__(self, other: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {**self, **other}

    def __ror__(self, other: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {**other, **self}


def _typed(names: dict[str, tuple[str, str]]) -> str:
    return ",".join(f"`{n}`:{kind}" for n, (_, kind) in names.items())


def _extra(members: Column, known) -> Column:
    """JSON of the members that aren't known; null without any."""
    rest = F.map_filter(members, lambda k, _: ~k.isin(*known))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def _indices(text: Column) -> Column:
    """The numbers and nulls of nested arrays, flattened."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(null|-?\d+)"), F.lit(1)), lambda s: s.try_cast("bigint"))


def _fit(values: Column, n: Column, size: Column) -> Column:
    """n values: cut or filled up with nulls; numbers that aren't below size are null."""
    n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))
    known = F.coalesce(F.transform(values, lambda v: _below(v, size)), F.array().cast("array<bigint>"))
    return bound(known, lambda k: F.concat(F.slice(k, F.lit(1), n), F.array_repeat(F.lit(None).cast("bigint"), F.greatest(n - F.size(k), F.lit(0)))))


def _below(value: Column, size: Column) -> Column:
    return F.when((value >= 0) & (value < size), value)


def _boundaries(kind: Column, text: Column) -> Column:
    """The flat boundaries as a struct of OFFSETS, each text parsed once."""
    none = F.lit(None).cast("array<int>")
    out = F.lit(None).cast("struct<" + ",".join(f"{n}:array<int>" for n in OFFSETS) + ">")
    for depth in sorted(set(GEOMETRY_TYPES.values()) - {0}):
        own = ["vertex_indices", *(["line_offsets"] if depth == 2 else ["ring_offsets", "surface_offsets", "shell_offsets", "solid_offsets"][: depth - 1])]

        found = lambda nested: dict(zip(own, flatten_levels(nested, depth), strict=True))  # noqa: B023, E731
        value = bound(F.from_json(text, "array<" * depth + "int" + ">" * depth), lambda nested: F.struct(*[found(nested).get(n, none).alias(n) for n in OFFSETS]))  # noqa: B023
        out = F.when(kind.isin([k for k, d in GEOMETRY_TYPES.items() if d == depth]), value).otherwise(out)
    return out


def _checked_type(kind: Column) -> Column:
    return F.when(kind.isin(*GEOMETRY_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown geometry type: "), F.coalesce(kind, F.lit("null")))))


def _each(rows: DataFrame, columns: list, of: Column | str, pos: str, item: str) -> DataFrame:
    """The columns with the place and item of each member of an array. Outer, then filtered: of a plain posexplode Spark infers filters
    on the array, which it moves below shuffles and works out again, the parsing of the array included."""
    return rows.select(*columns, F.posexplode_outer(of).alias(pos, item)).where(F.col(pos).isNotNull())


def _explicit(name: str, df: DataFrame) -> DataFrame:
    """A table with doc_key and its canonical columns and types."""
    return df.select("doc_key", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(name)])


def _assignments(rows: DataFrame, id_col: str, n_materials: Column, prefix: str) -> dict[str, Callable[[], DataFrame]]:
    """Long-form semantics, materials and ring textures of geometry rows with flat boundaries."""
    depth = F.when(F.col("geometry_type") == "MultiPoint", 1).when(F.col("geometry_type") == "MultiLineString", 2).otherwise(3)
    n = F.when(depth == 1, F.size("vertex_indices")).when(depth == 2, F.size("line_offsets")).otherwise(F.size("surface_offsets"))
    n_semantics = F.coalesce(F.size("g.semantics.surfaces"), F.lit(0))
    semantic = F.transform(_fit(_indices(F.col("g.semantics.values")), n, n_semantics), lambda i: i + F.col("semantic_start"))
    have = rows.where(F.col("g.semantics").isNotNull() & F.col("vertex_indices").isNotNull())
    semantics = cache(lambda: materialised(have.select("doc_key", id_col, depth.alias("depth"), F.posexplode(semantic).alias("ordinal", "semantic_id"))))
    surfaces = rows.where("surface_offsets is not null and size(surface_offsets) > 0")
    themes = surfaces.select("doc_key", id_col, "n_materials", F.size("surface_offsets").alias("n"), F.explode("g.material").alias("theme", "t"))
    no_value = F.raise_error(F.concat(F.lit("material theme without value or values: "), F.col("theme")))
    one = F.col("t.value").try_cast("bigint")
    values = (
        F.when(F.col("t.value").isNotNull(), F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: _below(one, F.col("n_materials"))))
        .when(F.col("t.values").isNotNull(), _fit(_indices(F.col("t.values")), F.col("n"), F.col("n_materials")))
        .otherwise(no_value)
    )
    materials = themes.select("doc_key", id_col, "theme", F.posexplode(values).alias("surface_ordinal", "material_id")).where("material_id is not null")
    # a ring is the innermost list; [null] has no texture
    rings = F.transform(F.regexp_extract_all("t.values", F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda r: F.transform(F.split(r, ","), lambda x: F.trim(x).try_cast("bigint")))
    surface = F.size(F.filter("surface_offsets", lambda s: s <= F.col("ring"))) - 1
    textures = surfaces.select("doc_key", id_col, "surface_offsets", "n_rings", "n_textures", "n_uv", F.explode("g.texture").alias("theme", "t"))
    textures = textures.select("doc_key", id_col, "surface_offsets", "n_rings", "n_textures", "n_uv", "theme", F.posexplode(rings).alias("ring", "r")).where(F.col("r")[0].isNotNull() & (F.col("ring") < F.col("n_rings")))
    bad = (F.col("r")[0] >= F.col("n_textures")) | F.exists(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), lambda x: x.isNull() | (x >= F.col("n_uv")))
    texture = F.when(bad, F.raise_error(F.concat(F.lit("a ring's texture doesn't exist, theme "), F.col("theme")))).otherwise(F.col("r")[0])
    textures = textures.select(
        "doc_key", id_col, surface.alias("surface_ordinal"), (F.col("ring") - F.element_at("surface_offsets", surface + 1)).alias("ring_ordinal"), "theme", texture.alias("texture_id"),
        F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))).alias("uv_indices"),
    )
    if prefix:
        kind = F.when(F.col("depth") == 1, "point").when(F.col("depth") == 2, "linestring").otherwise("surface").alias("primitive_type")
        return {
            "template_geometry_semantics": lambda: semantics().select("doc_key", id_col, kind, F.col("ordinal").alias("primitive_ordinal"), "semantic_id"),
            "template_geometry_materials": lambda: materials.select("doc_key", id_col, F.lit("surface").alias("primitive_type"), F.col("surface_ordinal").alias("primitive_ordinal"), "theme", "material_id"),
            "template_geometry_ring_textures": lambda: textures,
        }
    of = lambda d, name: lambda: semantics().where(F.col("depth") == d).select("doc_key", id_col, F.col("ordinal").alias(name), "semantic_id")
    return {
        "geometry_point_semantics": of(1, "point_ordinal"), "geometry_linestring_semantics": of(2, "linestring_ordinal"), "geometry_surface_semantics": of(3, "surface_ordinal"),
        "geometry_surface_materials": lambda: materials, "geometry_ring_textures": lambda: textures,
    }


def read_models(docs: DataFrame) -> Mapping[str, DataFrame]:
    """The canonical tables of documents or features (doc_key, value), each with doc_key.

    A root without a kind, an unknown version, object or geometry type, a child that isn't there, and a feature
    without an id that names one of its objects are errors while reading the tables that they belong to. A table reads
    only the members that it holds; geometries are parsed once for all of theirs.
    """
    docs = docs.select("doc_key", "value")
    looks = f"struct<materials:array<struct<{_typed(MATERIAL)}>>,textures:array<struct<{_typed(TEXTURE)}>>,`vertices-texture`:array<array<float>>,`default-theme-material`:string,`default-theme-texture`:string>"
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    n_surfaces = lambda all_: F.aggregate(F.coalesce(all_, F.array().cast(f"array<struct<{_GEOMETRY}>>")), F.lit(0).cast("bigint"), lambda n, g: n + size(g["semantics"]["surfaces"]))
    member = lambda name, kind: F.from_json(F.to_json(F.from_json("value", f"struct<`{name}`:variant>")[name]), kind)
    # objects keep their order, which variants don't
    objects = F.map_entries(F.from_json("value", "struct<CityObjects:map<string,string>>")["CityObjects"]).alias("objects")
    entries = _each(docs.select("doc_key", objects), ["doc_key"], "objects", "cityobject_ix", "e")
    look = docs.select("doc_key", member("appearance", looks).alias("a"))
    pools = {"n_materials": size("a.materials"), "n_textures": size("a.textures"), "n_uv": size("a.`vertices-texture`")}

    def metadata() -> DataFrame:
        base = docs.select("doc_key", F.from_json("value", _VARIANTS).alias("m"), objects)
        base = base.select("doc_key", "m", "objects", F.from_json(F.to_json(F.col("m")["appearance"]), looks).alias("a"), F.from_json(F.to_json(F.col("m")["metadata"]), _VARIANTS).alias("meta"))
        text = lambda name: F.col("m")[name].cast("string")
        kind = F.when(text("type").isNotNull(), text("type")).otherwise(F.raise_error(F.lit("a root without a type")))
        is_feature = text("type").endswith("Feature")
        named = F.when(is_feature & ~F.exists("objects", lambda o: o["key"].eqNullSafe(text("id"))), F.raise_error(F.lit("a feature's id names none of its objects"))).otherwise(text("id"))
        meta = lambda name: F.col("meta")[name].cast("string")
        contact = F.from_json(F.to_json(F.col("meta")["pointOfContact"]), "struct<role:string,contactType:string>")
        known_contact = F.struct(parse_contact_role(contact["role"]), parse_contact_type(contact["contactType"])).isNotNull()  # or an error
        return base.select(
            "doc_key", F.coalesce(meta("identifier"), F.lit("citymodel")).alias("citymodel_id"), F.when(is_feature & text("version").isNull(), F.lit(None)).otherwise(parse_version(text("version"))).alias("format_version"),
            kind.alias("citymodel_kind"), F.when(is_feature, named).alias("feature_root_id"), *[meta(n).alias(c) for n, c in METADATA.items()],
            F.from_json(F.to_json(F.col("meta")["geographicalExtent"]), "array<double>").alias("geographical_extent"), F.col("a.`default-theme-material`").alias("default_material_theme"),
            F.col("a.`default-theme-texture`").alias("default_texture_theme"), F.when(known_contact, F.to_json(F.col("meta")["pointOfContact"])).alias("point_of_contact"),
            _extra(F.col("m"), ROOT).alias("root_extra"), _extra(F.col("meta"), (*METADATA, "geographicalExtent", "pointOfContact")).alias("metadata_extra"),
        )

    def extensions() -> DataFrame:
        each = _each(docs, ["doc_key"], F.map_entries(member("extensions", "map<string,struct<url:string,version:string>>")), "pos", "e")
        return each.select("doc_key", F.col("e.key").alias("extension_name"), F.col("e.value.url").alias("uri"), "e.value.version")

    def vertices() -> DataFrame:
        points = _each(docs, ["doc_key", member("transform", "struct<scale:array<double>,translate:array<double>>").alias("transform")], member("vertices", "array<array<double>>"), "vertex_id", "v")
        return points.select("doc_key", "vertex_id", *[dequantize(F.col("v")[i], F.coalesce(F.col("transform.scale")[i], F.lit(1.0)), F.coalesce(F.col("transform.translate")[i], F.lit(0.0))).alias(c) for i, c in enumerate("xyz")])

    def template_vertices() -> DataFrame:
        points = _each(docs, ["doc_key"], member("geometry-templates", "struct<`vertices-templates`:array<array<double>>>")["vertices-templates"], "template_vertex_id", "v")
        return points.select("doc_key", "template_vertex_id", *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")])

    def texture_vertices() -> DataFrame:
        return _each(look, ["doc_key"], "a.`vertices-texture`", "uv_id", "v").select("doc_key", "uv_id", F.col("v")[0].alias("u"), F.col("v")[1].alias("v"))

    def materials() -> DataFrame:
        return _each(look, ["doc_key"], "a.materials", "material_id", "x").select("doc_key", "material_id", *[F.col(f"x.{n}").alias(c) for n, (c, _) in MATERIAL.items()])

    def textures() -> DataFrame:
        known = {"type": parse_image_type, "wrapMode": parse_wrap_mode, "textureType": parse_texture_type}
        return _each(look, ["doc_key"], "a.textures", "texture_id", "x").select("doc_key", "texture_id", *[known.get(n, lambda c: c)(F.col(f"x.{n}")).alias(c) for n, (c, _) in TEXTURE.items()])

    def cityobjects() -> DataFrame:
        rows = entries.select("doc_key", F.col("e.key").alias("cityobject_id"), "cityobject_ix", F.from_json("e.value", _VARIANTS).alias("o"), F.from_json("e.value", "struct<geographicalExtent:array<double>,geometry:array<struct<type:string,lod:string>>>").alias("p"))
        known = F.forall(F.coalesce("p.geometry", F.array().cast("array<struct<type:string,lod:string>>")), lambda g: _checked_type(g["type"]).isNotNull() & (g["lod"].isNull() | parse_lod(g["lod"]).isNotNull()))  # or an error
        return rows.select(
            "doc_key", "cityobject_id", "cityobject_ix", F.when(known, parse_object_type(F.col("o")["type"].cast("string"))).alias("object_type"), F.col("p.geographicalExtent").alias("geographical_extent"),
            F.to_json(F.col("o")["attributes"]).alias("attributes"), _extra(F.col("o"), OBJECT).alias("extra"),
        )

    def cityobject_children() -> DataFrame:
        of = F.from_json("e.value", "struct<children:array<string>>")["children"]
        children = materialised(_each(entries, ["doc_key", F.col("cityobject_ix").alias("parent_cityobject_ix")], of, "child_ordinal", "cityobject_id"))
        there = entries.join(children.select("doc_key").distinct(), "doc_key", "left_semi").select("doc_key", F.col("e.key").alias("cityobject_id"), F.col("cityobject_ix").alias("found"))
        found = F.coalesce("found", F.raise_error(F.concat(F.lit("unknown object: "), F.col("cityobject_id"))))
        return materialised(children.join(there, ["doc_key", "cityobject_id"], "left").select("doc_key", "parent_cityobject_ix", "child_ordinal", found.alias("child_cityobject_ix")))

    def flat(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("geometry_type", _checked_type(F.col("g.type"))).withColumns({"lod": F.when(F.col("g.lod").isNotNull(), parse_lod(F.col("g.lod"))), "b": _boundaries(F.col("geometry_type"), F.col("g.boundaries"))})
        return materialised(rows.select("*", "b.*", size("g.semantics.surfaces").alias("n_surfaces")).drop("b").withColumn("n_rings", size("ring_offsets")))

    # numbers run on through the objects of a document, templates last
    @cache
    def g() -> DataFrame:
        of = lambda text: F.from_json(text, f"struct<geometry:array<struct<{_GEOMETRY}>>>")["geometry"]
        whole = docs.select("doc_key", objects, member("appearance", looks).alias("a")).select("doc_key", "objects", *[c.alias(n) for n, c in pools.items()])
        small = whole.select("doc_key", *pools, F.when(F.size("objects") <= FEW, F.transform("objects", lambda e: of(e["value"]))).alias("of"))
        small = small.withColumns({"geometries": F.transform("of", size), "semantics": F.transform("of", n_surfaces)})
        small = _each(small, ["doc_key", *pools, "geometries", "semantics"], "of", "cityobject_ix", "all")
        ahead = lambda c: F.aggregate(F.slice(c, F.lit(1), F.col("cityobject_ix")), F.lit(0).cast("bigint"), lambda a, n: a + n)
        rows = small.select("doc_key", *pools, "cityobject_ix", "all", ahead("geometries").alias("geometry_start"), ahead("semantics").alias("semantic_base"))
        large = _each(whole, ["doc_key", *pools], F.when(F.size("objects") > FEW, F.col("objects")), "cityobject_ix", "e")
        large = materialised(large.select("doc_key", *pools, "cityobject_ix", of(F.col("e.value")).alias("all")))
        if not large.isEmpty():
            before = Window.partitionBy("doc_key").orderBy("cityobject_ix").rowsBetween(Window.unboundedPreceding, -1)
            counts = large.select("doc_key", "cityobject_ix", size("all").alias("geometries"), n_surfaces(F.col("all")).alias("semantics"))
            starts = counts.select("doc_key", "cityobject_ix", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in (("geometry_start", "geometries"), ("semantic_base", "semantics"))])
            rows = rows.unionByName(large.join(starts, ["doc_key", "cityobject_ix"]))
        rows = _each(rows, ["*"], "all", "geometry_ordinal", "g")
        rows = rows.withColumns({"geometry_id": F.col("geometry_start") + F.col("geometry_ordinal"), "semantic_start": F.col("semantic_base") + n_surfaces(F.slice("all", F.lit(1), F.col("geometry_ordinal")))})
        return flat(rows.drop("all"))

    @cache
    def t() -> DataFrame:
        rows = docs.select("doc_key", "value", member("geometry-templates", f"struct<templates:array<struct<{_GEOMETRY}>>>")["templates"].alias("all"))
        rows = _each(rows, ["doc_key", "value"], F.when(F.size("all") > 0, F.array("all")), "pos", "all")
        rows = materialised(rows.select("doc_key", "all", member("appearance", looks).alias("a")).select("doc_key", "all", *[c.alias(n) for n, c in pools.items()]))
        totals = g().where("n_surfaces > 0").join(rows.select("doc_key"), "doc_key", "left_semi").groupBy("doc_key").agg(F.max(F.col("semantic_start") + F.col("n_surfaces")).alias("semantic_base"))
        rows = rows.join(totals, "doc_key", "left").select("doc_key", *pools, F.coalesce("semantic_base", F.lit(0)).alias("semantic_base"), "all")
        rows = _each(rows, ["*"], "all", "template_geometry_id", "g")
        return flat(rows.withColumn("semantic_start", F.col("semantic_base") + n_surfaces(F.slice("all", F.lit(1), F.col("template_geometry_id")))).drop("all"))

    null = F.lit(None).cast("string").alias("extra")
    plain = lambda: g().where("geometry_type <> 'GeometryInstance'")

    def geometry_instances() -> DataFrame:
        point = F.from_json("g.boundaries", "array<bigint>")[0]
        return g().where("geometry_type = 'GeometryInstance'").select(
            "doc_key", "geometry_id", "cityobject_ix", "geometry_ordinal", "lod", F.col("g.template").alias("template_geometry_id"), point.alias("reference_point_vertex_id"), F.col("g.transformationMatrix").alias("transform_matrix"), null
        )

    @cache
    def assigned(prefix: str) -> dict[str, Callable[[], DataFrame]]:
        return _assignments(t() if prefix else g(), f"{prefix}geometry_id", F.col("n_materials"), prefix)

    def one_semantic() -> DataFrame:
        surfaces = g().select("doc_key", "semantic_start", F.col("g.semantics.surfaces").alias("s")).unionByName(t().select("doc_key", "semantic_start", F.col("g.semantics.surfaces").alias("s")))
        one = surfaces.select("doc_key", "semantic_start", F.size("s").alias("n"), F.posexplode("s").alias("pos", "x"))
        return one.withColumns({"semantic_id": F.col("semantic_start") + F.col("pos"), "parent": _below(F.try_variant_get(F.col("x")["parent"], "$", "bigint"), F.col("n"))})

    def semantics() -> DataFrame:
        return one_semantic().select("doc_key", "semantic_id", parse_semantic_type(F.col("x")["type"].cast("string")).alias("semantic_type"), (F.col("semantic_start") + F.col("parent")).alias("parent_semantic_id"), _extra(F.col("x"), SEMANTIC).alias("attributes"))

    def semantic_children() -> DataFrame:
        links = one_semantic().select("doc_key", F.col("semantic_id").alias("parent_semantic_id"), "semantic_start", "n", F.posexplode(F.try_variant_get(F.col("x")["children"], "$", "array<bigint>")).alias("child_ordinal", "c"))
        return links.where("c >= 0 and c < n").select("doc_key", "parent_semantic_id", "child_ordinal", (F.col("semantic_start") + F.col("c")).alias("child_semantic_id"))

    makers = {f.__name__: f for f in (metadata, extensions, vertices, template_vertices, texture_vertices, semantics, semantic_children, materials, textures, geometry_instances, cityobjects, cityobject_children)}
    makers |= {
        "geometries": lambda: plain().select("doc_key", "geometry_id", "cityobject_ix", "geometry_ordinal", "geometry_type", "lod", null), "geometry_boundaries": lambda: plain().select("doc_key", "geometry_id", *OFFSETS),
        "template_geometries": lambda: t().select("doc_key", "template_geometry_id", "geometry_type", "lod", null), "template_geometry_boundaries": lambda: t().select("doc_key", "template_geometry_id", *OFFSETS),
    }
    prefix_of = lambda name: "template_" if name.startswith("template_") else ""
    made = lambda name: makers[name]() if name in makers else assigned(prefix_of(name))[name]()
    return Tables({name: lambda name=name: _explicit(name, made(name)) for name in TABLES})


def one_model(tables: dict[str, DataFrame], doc_key) -> dict[str, DataFrame]:
    """The tables of one document, without doc_key."""
    return {n: df.where(F.col("doc_key") == doc_key).drop("doc_key") for n, df in tables.items()}


def keyed(tables: dict[str, DataFrame], doc_key) -> dict[str, DataFrame]:
    """The tables of a single model with a doc_key."""
    return {n: df.select(F.lit(doc_key).alias("doc_key"), *df.columns) for n, df in tables.items()}


# -- writing


def _json(text: Column) -> Column:
    return F.parse_json(text)


def _nested(kind: Column) -> Column:
    """The boundary as JSON, nested as its type asks."""
    lines = unflatten(F.col("vertex_indices"), F.col("line_offsets"))
    rings = unflatten(F.col("vertex_indices"), F.col("ring_offsets"))
    surfaces = unflatten(rings, F.col("surface_offsets"))
    shells = unflatten(surfaces, F.col("shell_offsets"))
    solids = unflatten(shells, F.col("solid_offsets"))
    by = {1: F.col("vertex_indices"), 2: lines, 3: surfaces, 4: shells, 5: solids}
    out = F.lit(None).cast("string")
    for name, depth in GEOMETRY_TYPES.items():
        if depth:
            out = F.when(kind == name, F.to_json(by[depth])).otherwise(out)
    return _json(out)


def _by_surface(values: Column) -> Column:
    """One value a surface (point, line), as JSON, nested by shells and solids."""
    shells = unflatten(values, F.col("shell_offsets"))
    solids = unflatten(shells, F.col("solid_offsets"))
    return F.when(F.col("geometry_type") == "Solid", F.to_json(shells)).when(F.col("geometry_type").isin("MultiSolid", "CompositeSolid"), F.to_json(solids)).otherwise(F.to_json(values))


def _by_ring(values: Column) -> Column:
    surfaces = unflatten(values, F.col("surface_offsets"))
    shells = unflatten(surfaces, F.col("shell_offsets"))
    solids = unflatten(shells, F.col("solid_offsets"))
    return F.when(F.col("geometry_type") == "Solid", F.to_json(shells)).when(F.col("geometry_type").isin("MultiSolid", "CompositeSolid"), F.to_json(solids)).otherwise(F.to_json(surfaces))


def _merged_maps(rows: DataFrame, keys: list[str], name: str, value: Column, alias: str) -> DataFrame:
    """A map from name to value for each key; as large as a geometry's themes."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(name), F.to_json(value).alias("v"))))).alias(alias))


def _geometry_json(head: DataFrame, id_col: str, semantics: DataFrame, semantic_rows: DataFrame, children: DataFrame, materials: DataFrame, textures: DataFrame) -> DataFrame:
    """doc_key, id and the geometry as a struct ready for JSON; head has type, lod and flat boundaries."""
    keys = ["doc_key", id_col]
    n = F.when(F.col("geometry_type") == "MultiPoint", F.size("vertex_indices")).when(F.col("geometry_type") == "MultiLineString", F.size("line_offsets")).otherwise(F.size("surface_offsets"))
    used = semantic_rows.where("semantic_id is not null").select(*keys, "semantic_id")
    up = used.join(semantics.select("doc_key", "semantic_id", F.col("parent_semantic_id").alias("other")).where("other is not null"), ["doc_key", "semantic_id"])
    down = used.join(children.select("doc_key", F.col("parent_semantic_id").alias("semantic_id"), F.col("child_semantic_id").alias("other")), ["doc_key", "semantic_id"])
    related = used.unionByName(up.select(*keys, F.col("other").alias("semantic_id"))).unionByName(down.select(*keys, F.col("other").alias("semantic_id"))).distinct()
    kids = children.groupBy("doc_key", F.col("parent_semantic_id").alias("semantic_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("child_ordinal", "child_semantic_id"))), lambda c: c["child_semantic_id"]).alias("kids"))
    local = related.join(semantics, ["doc_key", "semantic_id"]).join(kids, ["doc_key", "semantic_id"], "left")
    pool = local.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("semantic_id", "semantic_type", "parent_semantic_id", "kids", "attributes"))).alias("pool"))
    ids = F.transform("pool", lambda s: s["semantic_id"])
    place = lambda i: F.nullif(F.array_position(ids, i).cast("bigint"), F.lit(0).cast("bigint")) - 1

    shown = F.transform(
        "pool",
        lambda s: F.map_concat(
            F.map_filter(
                F.from_json(F.to_json(F.struct(s["semantic_type"].alias("type"), place(s["parent_semantic_id"]).alias("parent"), F.transform(s["kids"], place).alias("children"))), _VARIANTS),
                lambda _, v: v.isNotNull(),
            ),
            F.coalesce(F.from_json(s["attributes"], _VARIANTS), F.create_map().cast(_VARIANTS)),
        ),
    )
    values = semantic_rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "semantic_id"))).alias("semantic_of"))
    rows = head.join(values, keys, "left").join(pool, keys, "left").withColumn("n", n)
    ordinals = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    semantic_values = F.transform(ordinals, lambda i: place(F.try_element_at("semantic_of", i)))
    semantics_json = F.when(F.col("pool").isNotNull(), F.struct(_json(F.to_json(shown)).alias("surfaces"), _json(_by_surface(semantic_values)).alias("values")))
    sizes = head.select(*keys, "geometry_type", n.alias("n"), "ring_offsets", "surface_offsets", "shell_offsets", "solid_offsets")
    m = materials.groupBy(*keys, "theme").agg(F.map_from_entries(F.collect_list(F.struct("surface_ordinal", "material_id"))).alias("of")).join(sizes, keys)
    m = _merged_maps(m, keys, "theme", F.struct(_json(_by_surface(F.transform(ordinals, lambda i: F.try_element_at("of", i)))).alias("values")), "material")
    ring_values = F.transform(F.sequence(F.lit(0), F.size("ring_offsets") - 1), lambda i: F.coalesce(F.try_element_at("of", i), F.array(F.lit(None).cast("bigint"))))
    ring = F.element_at("surface_offsets", F.col("surface_ordinal") + 1) + F.col("ring_ordinal")
    x = textures.join(sizes.select(*keys, "surface_offsets"), keys).select(*keys, "theme", ring.alias("ring"), F.concat(F.array("texture_id"), F.col("uv_indices")).alias("r"))
    x = x.groupBy(*keys, "theme").agg(F.map_from_entries(F.collect_list(F.struct("ring", "r"))).alias("of")).join(sizes, keys)
    x = _merged_maps(x, keys, "theme", F.struct(_json(_by_ring(ring_values)).alias("values")), "texture")
    rows = rows.join(m, keys, "left").join(x, keys, "left")
    open_map = lambda c: F.transform_values(c, lambda _, v: F.parse_json(v))
    return rows.select(*keys, F.to_json(F.struct(
        F.col("geometry_type").alias("type"), "lod", _nested(F.col("geometry_type")).alias("boundaries"), semantics_json.alias("semantics"), open_map("material").alias("material"), open_map("texture").alias("texture"),
    )).alias("g"))


def _listed(rows: DataFrame, order: str, value: Column, alias: str) -> DataFrame:
    """doc_key and a list of values in order, each a JSON text."""
    return rows.groupBy("doc_key").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), value.alias("v")))), lambda s: F.parse_json(s["v"])).alias(alias))


def write_models(tables: dict[str, DataFrame], scale: tuple[float, float, float] | None = None, version: str = "2.0") -> DataFrame:
    """doc_key and value: each document as JSON text.

    scale: vertices are written as whole numbers of this scale above the least coordinates, with the
    transform; else as they are, without one. Default themes that no assignment has are an error.
    """
    t = {n: tables[n] for n in tables}
    missing = [n for n in TABLES if n not in t]
    some = t["metadata"]
    spark = some.sparkSession
    key_type = some.schema["doc_key"].dataType.simpleString()
    for n in missing:
        t[n] = spark.createDataFrame([], f"doc_key {key_type}, {TABLES[n]}")

    long_form = [
        t["geometry_point_semantics"].select("doc_key", "geometry_id", F.col("point_ordinal").alias("ordinal"), "semantic_id"),
        t["geometry_linestring_semantics"].select("doc_key", "geometry_id", F.col("linestring_ordinal").alias("ordinal"), "semantic_id"),
        t["geometry_surface_semantics"].select("doc_key", "geometry_id", F.col("surface_ordinal").alias("ordinal"), "semantic_id"),
    ]
    head = t["geometries"].join(t["geometry_boundaries"], ["doc_key", "geometry_id"])
    plain = _geometry_json(head, "geometry_id", t["semantics"], reduce(DataFrame.unionByName, long_form), t["semantic_children"], t["geometry_surface_materials"], t["geometry_ring_textures"])
    plain = plain.join(t["geometries"].select("doc_key", "geometry_id", "cityobject_ix", "geometry_ordinal"), ["doc_key", "geometry_id"])
    instance = F.to_json(F.struct(F.lit("GeometryInstance").alias("type"), F.col("template_geometry_id").alias("template"), F.array("reference_point_vertex_id").alias("boundaries"), F.col("transform_matrix").alias("transformationMatrix")))
    instances = t["geometry_instances"].select("doc_key", "geometry_id", instance.alias("g"), "cityobject_ix", "geometry_ordinal")
    of_objects = plain.unionByName(instances).groupBy("doc_key", "cityobject_ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("geometry_ordinal", "g"))), lambda s: F.parse_json(s["g"])).alias("geometry"))

    template_head = t["template_geometries"].join(t["template_geometry_boundaries"], ["doc_key", "template_geometry_id"])
    template_semantics = t["template_geometry_semantics"].select("doc_key", "template_geometry_id", F.col("primitive_ordinal").alias("ordinal"), "semantic_id")
    template_materials = t["template_geometry_materials"].select("doc_key", "template_geometry_id", "theme", F.col("primitive_ordinal").alias("surface_ordinal"), "material_id")
    of_templates = _geometry_json(template_head, "template_geometry_id", t["semantics"], template_semantics, t["semantic_children"], template_materials, t["template_geometry_ring_textures"])
    templates = _listed(of_templates, "template_geometry_id", F.col("g"), "templates")
    template_vertices = _listed(t["template_vertices"], "template_vertex_id", F.to_json(F.array("x", "y", "z")), "vertices-templates")

    ids = t["cityobjects"].select("doc_key", "cityobject_ix", "cityobject_id")
    edges = t["cityobject_children"].join(ids.select("doc_key", F.col("cityobject_ix").alias("child_cityobject_ix"), F.col("cityobject_id").alias("child")), ["doc_key", "child_cityobject_ix"])
    edges = edges.join(ids.select("doc_key", F.col("cityobject_ix").alias("parent_cityobject_ix"), F.col("cityobject_id").alias("parent")), ["doc_key", "parent_cityobject_ix"])
    children = edges.groupBy("doc_key", F.col("parent_cityobject_ix").alias("cityobject_ix")).agg(F.transform(F.sort_array(F.collect_list(F.struct("child_ordinal", "child"))), lambda c: c["child"]).alias("children"))
    parents = edges.groupBy("doc_key", F.col("child_cityobject_ix").alias("cityobject_ix")).agg(F.transform(F.sort_array(F.collect_list(F.struct("parent_cityobject_ix", "parent"))), lambda c: c["parent"]).alias("parents"))
    objects = t["cityobjects"].join(children, ["doc_key", "cityobject_ix"], "left").join(parents, ["doc_key", "cityobject_ix"], "left").join(of_objects, ["doc_key", "cityobject_ix"], "left")
    known = F.from_json(F.to_json(F.struct(F.col("object_type").alias("type"), F.col("geographical_extent").alias("geographicalExtent"), _json(F.col("attributes")).alias("attributes"), "parents", "children", "geometry")), _VARIANTS)
    no_extra = F.create_map().cast(_VARIANTS)
    whole = F.map_concat(known, F.coalesce(F.from_json("extra", _VARIANTS), no_extra))
    entries = objects.select("doc_key", "cityobject_ix", "cityobject_id", F.to_json(whole).alias("o"))
    # object by object as text, so that their order stays
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    city_objects = entries.groupBy("doc_key").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cityobject_ix", F.concat(quoted(F.col("cityobject_id")), F.lit(":"), F.col("o")).alias("e")))), lambda s: s["e"]), ","), F.lit("}")).alias("city_objects"))

    points = t["vertices"]
    least = points.groupBy("doc_key").agg(*[F.min(c).alias(f"t{c}") for c in "xyz"])
    if scale is None:
        shown = F.to_json(F.array("x", "y", "z"))
    else:
        points = points.join(least, "doc_key")
        shown = F.to_json(F.array(*[quantize(F.col(c), float(scale[i]), F.col(f"t{c}")) for i, c in enumerate("xyz")]))
    vertices = _listed(points, "vertex_id", shown, "vertices")

    def pool(name, order, names):
        return _listed(t[name], order, F.to_json(F.struct(*[F.col(c).alias(n) for n, (c, _) in names.items()])), name)

    uv = _listed(t["texture_vertices"], "uv_id", F.to_json(F.array("u", "v")), "vertices-texture")
    extensions = t["extensions"].groupBy("doc_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("extension_name", F.struct(F.col("uri").alias("url"), "version").alias("e"))))).alias("extensions"))
    rows = t["metadata"]
    for part in (city_objects, vertices, pool("materials", "material_id", MATERIAL), pool("textures", "texture_id", TEXTURE), uv, templates, template_vertices, extensions, least, _themes(t, "material"), _themes(t, "texture")):
        rows = rows.join(part, "doc_key", "left")
    themed = lambda name, have: F.when(F.col(name).isNotNull() & ~F.coalesce(F.array_contains(have, F.col(name)), F.lit(False)), F.raise_error(F.concat(F.lit("no assignment has the default theme "), F.col(name)))).otherwise(F.col(name))
    look = F.struct("materials", "textures", F.col("`vertices-texture`"), themed("default_material_theme", "material_themes").alias("default-theme-material"), themed("default_texture_theme", "texture_themes").alias("default-theme-texture"))
    has_look = F.coalesce("materials", "textures", "`vertices-texture`").isNotNull() | F.coalesce("default_material_theme", "default_texture_theme").isNotNull()
    metadata = F.map_concat(
        F.from_json(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in METADATA.items()], F.col("geographical_extent").alias("geographicalExtent"), _json(F.col("point_of_contact")).alias("pointOfContact"))), _VARIANTS),
        F.coalesce(F.from_json("metadata_extra", _VARIANTS), no_extra),
    )
    transform = F.struct(F.array(*[F.lit(float(s)) for s in scale or (1, 1, 1)]).alias("scale"), F.array(*[F.coalesce(f"t{c}", F.lit(0.0)) for c in "xyz"]).alias("translate"))
    none = F.array().cast("array<variant>")
    is_feature = F.col("citymodel_kind").endswith("Feature")
    root = F.struct(
        F.col("citymodel_kind").alias("type"), F.when(~is_feature, F.coalesce("format_version", F.lit(version))).alias("version"), F.col("feature_root_id").alias("id"),
        *([transform.alias("transform")] if scale is not None else []), F.coalesce("vertices", none).alias("vertices"), F.when(has_look, look).alias("appearance"),
        F.when(F.col("templates").isNotNull(), F.struct("templates", F.coalesce("`vertices-templates`", none).alias("vertices-templates"))).alias("geometry-templates"),
        F.when(F.size(metadata) > 0, metadata).alias("metadata"), "extensions",
    )
    members = F.map_concat(F.from_json(F.to_json(root), _VARIANTS), F.coalesce(F.from_json("root_extra", _VARIANTS), no_extra))
    text = F.to_json(members)
    return rows.select("doc_key", F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"CityObjects":'), F.coalesce("city_objects", F.lit("{}")), F.lit("}")).alias("value"))


def _themes(t: Mapping[str, DataFrame], kind: str) -> DataFrame:
    """The themes in use: doc_key with a set; kind: material or texture."""
    plain, of_templates = {"material": ("geometry_surface_materials", "template_geometry_materials"), "texture": ("geometry_ring_textures", "template_geometry_ring_textures")}[kind]
    return t[plain].select("doc_key", "theme").unionByName(t[of_templates].select("doc_key", "theme")).groupBy("doc_key").agg(F.collect_set("theme").alias(f"{kind}_themes"))


def has_theme(t: Mapping[str, DataFrame], kind: str, theme: str) -> DataFrame:
    """doc_key of the models in which a geometry or a template has this theme; kind: material or texture."""
    return _themes(t, kind).where(F.array_contains(f"{kind}_themes", theme)).select("doc_key")


def models_to_text(spark: SparkSession, tables: dict[str, DataFrame], path: str, **options) -> None:
    """Each document as a line of text files, partitioned as the models are."""
    write_models(tables, **options).select("value").write.text(path)


# -- sequences


def root_signature(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_key and a hash of what features of a sequence must share: metadata without extents, extensions, appearance, templates, extra members."""
    empty = tables["metadata"].select("doc_key")
    bare = {n: df for n, df in tables.items() if n not in ("vertices", "cityobjects", "cityobject_children") and not n.startswith("geometr") and n not in ("semantics", "semantic_children")}
    bare["metadata"] = tables["metadata"].withColumns({"geographical_extent": F.lit(None).cast("array<double>"), "citymodel_kind": F.lit("Root"), "feature_root_id": F.lit(None).cast("string"), "default_material_theme": F.lit(None).cast("string"), "default_texture_theme": F.lit(None).cast("string"), "format_version": F.lit(None).cast("string")})
    return write_models(bare).join(empty, "doc_key").select("doc_key", F.sha2("value", 256).alias("signature"))


def checked_features(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a sequence's features. A root that isn't a feature, roots that differ in what they share, and an object id that
    comes twice are errors. Runs at once."""
    if not (other := tables["metadata"].where("feature_root_id is null").limit(1)).isEmpty():
        raise ValueError(f"no feature: {other.first()['doc_key']}")
    if root_signature(tables).agg(F.count_distinct("signature")).first()[0] > 1:
        raise ValueError("the features' roots differ")
    twice = tables["cityobjects"].groupBy("cityobject_id").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"duplicate object: {twice.first()['cityobject_id']}")
    return tables


def features_extent(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the box around all vertices and all extents of objects; null without any."""
    low = lambda c: F.min(c)
    v = tables["vertices"].select(F.array("x", "y", "z", "x", "y", "z").alias("e")).unionByName(tables["cityobjects"].where("geographical_extent is not null").select(F.col("geographical_extent").alias("e")))
    e = F.col("e")
    return v.agg(F.when(F.count("*") > 0, F.array(*[low(e[i]) for i in range(3)], *[F.max(e[i]) for i in range(3, 6)])).alias("geographical_extent"))


def write_feature_sequence(tables: dict[str, DataFrame], path: str, kind: str, scale: tuple[float, float, float] = (0.001, 0.001, 0.001), translate: tuple[float, float, float] | None = None) -> DataFrame:
    """Write features (checked) as a sequence of lines: the header with transform and extent first, then each feature in doc_key order.

    kind: that of the header's root. Without translate the least coordinates are taken. Returns one row: transform, extent, numbers of
    features and objects.
    """
    from citytables.sources.document import write_sequence

    tables = {n: materialised(df) for n, df in checked_features(tables).items()}
    extent = features_extent(tables).first()["geographical_extent"]
    translate = tuple(translate or (extent[:3] if extent else (0.0, 0.0, 0.0)))
    shifted = dict(tables)
    whole = [quantize(F.col(c), float(scale[i]), float(translate[i])).cast("double").alias(c) for i, c in enumerate("xyz")]
    shifted["vertices"] = tables["vertices"].select("doc_key", "vertex_id", *whole)
    shared = ("appearance", "geometry-templates", "metadata", "extensions")
    text = F.from_json("value", _VARIANTS)
    ints = F.from_json("value", "struct<vertices:array<array<double>>>")["vertices"]
    as_ints = F.parse_json(F.to_json(F.transform(ints, lambda p: F.transform(p, lambda x: x.cast("bigint")))))
    features = write_models(shifted).withColumn("m", F.map_concat(F.map_filter(text, lambda k, _: ~k.isin(*shared, "vertices")), F.create_map(F.lit("vertices"), as_ints)))
    order = tables["metadata"].select("doc_key")
    from citytables.operators.merge import dense_ranks

    ranks = dense_ranks(order, ["doc_key"], "ix")
    plain = F.from_json("value", "struct<CityObjects:map<string,string>>")["CityObjects"]
    rest = F.to_json(F.map_filter("m", lambda k, _: k != "CityObjects"))
    objects = F.array_join(F.transform(F.map_entries(plain), lambda e: F.concat(F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ",")
    lines = features.join(ranks, "doc_key").select("ix", F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"CityObjects":{'), objects, F.lit("}}")).alias("value"))

    first = ranks.where("ix = 0").select("doc_key")
    head = {n: df.join(first, "doc_key", "left_semi") for n, df in tables.items() if n in ("metadata", "extensions", "materials", "textures", "texture_vertices", "template_vertices") or n.startswith("template_")}
    box = F.lit(None).cast("array<double>") if extent is None else F.array(*[F.lit(float(x)) for x in extent])
    none = F.lit(None).cast("string")
    head["metadata"] = head["metadata"].withColumns({"citymodel_kind": F.lit(kind), "feature_root_id": none, "geographical_extent": box, "default_material_theme": none, "default_texture_theme": none})
    if "template_geometry_semantics" in head:
        head["semantics"], head["semantic_children"] = (tables[n].join(first, "doc_key", "left_semi") for n in ("semantics", "semantic_children"))
    transform = F.parse_json(F.to_json(F.struct(F.array(*[F.lit(float(x)) for x in scale]).alias("scale"), F.array(*[F.lit(float(x)) for x in translate]).alias("translate"))))
    header = write_models(head).select(F.to_json(F.map_concat(text, F.create_map(F.lit("transform"), transform))).alias("value"))
    spark = header.sparkSession
    if header.isEmpty():
        header = spark.createDataFrame([(kind,)], "type string").select(F.to_json(F.struct("type", F.lit("2.0").alias("version"), transform.alias("transform"), F.create_map().cast("map<string,string>").alias("CityObjects"), F.array().cast("array<int>").alias("vertices"))).alias("value"))
    write_sequence(header, lines, path)
    report = [(list(map(float, scale)), list(map(float, translate)), extent, tables["metadata"].count(), tables["cityobjects"].count())]
    return spark.createDataFrame(report, "scale array<double>, translate array<double>, geographical_extent array<double>, features long, cityobjects long")


def read_feature_sequence(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of a sequence's features (path, line, value): each joined with the header of its file, as doc_key path and line.

    The header is the file's first line; a later line that isn't a feature is an error, and so is a feature that carries a header's members
    of its own where the header has others.
    """
    from citytables.sources.document import is_document, is_feature, overlaid

    at = F.when(is_document(F.col("value")), F.col("line"))
    header = lines.groupBy("path").agg(F.min_by("value", at).alias("header"), F.min("line").alias("first"), F.min(at).alias("header_line"))
    rows = lines.join(header, "path")
    good = F.when(is_feature(F.col("value")), F.col("value")).otherwise(F.raise_error(F.lit("a line that isn't a feature")))
    led = F.when(F.col("header_line").eqNullSafe(F.col("first")), F.col("header")).otherwise(F.raise_error(F.lit("a sequence begins with a header")))
    features = rows.where(F.col("line") != F.coalesce("header_line", F.lit(-1))).select(F.concat_ws("#", "path", F.col("line").cast("string")).alias("doc_key"), overlaid(led, good).alias("value"))
    return read_models(materialised(features))  # the checks see every line as a whole, ahead of any filter on its parts


# -- documents as features


def root_members(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_key, root_id and cityobject_ix: every object that no one has as a child, with all that hangs on it.

    A round for each level of the deepest tree; what is reached twice counts once, so cycles end (objects on a cycle
    without a root belong to no one).
    """
    objects = tables["cityobjects"].select("doc_key", "cityobject_id", "cityobject_ix")
    edges = materialised(tables["cityobject_children"].select("doc_key", F.col("parent_cityobject_ix").alias("cityobject_ix"), F.col("child_cityobject_ix").alias("to")))
    inner = edges.select("doc_key", F.col("to").alias("cityobject_ix"))
    seen = frontier = materialised(objects.join(inner, ["doc_key", "cityobject_ix"], "left_anti").select("doc_key", F.col("cityobject_id").alias("root_id"), "cityobject_ix"))
    while True:
        step = frontier.join(edges, ["doc_key", "cityobject_ix"]).select("doc_key", "root_id", F.col("to").alias("cityobject_ix")).distinct()
        frontier = materialised(step.join(seen, ["doc_key", "root_id", "cityobject_ix"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def split_features(tables: dict[str, DataFrame], kind: str) -> dict[str, DataFrame]:
    """Documents as features, one for each root object: its tree, with vertices numbered anew and only those in use.

    doc_key becomes the document's key and the root's id, joined by #. Appearance, templates and extensions stay with the document's header.
    """
    members = root_members(tables)
    key = F.concat_ws("#", F.col("doc_key").cast("string"), F.col("root_id"))
    of = members.select("doc_key", "cityobject_ix", key.alias("key"))

    def moved(df: DataFrame, on: list[str], by: DataFrame) -> DataFrame:
        columns = [c for c in df.columns if c != "doc_key"]
        return df.join(by, ["doc_key", *on]).select(F.col("key").alias("doc_key"), *columns)

    out = {"cityobjects": moved(tables["cityobjects"], ["cityobject_ix"], of)}
    child = of.select("doc_key", F.col("cityobject_ix").alias("child_cityobject_ix"), F.col("key").alias("child_key"))
    both = tables["cityobject_children"].join(of.withColumnRenamed("cityobject_ix", "parent_cityobject_ix"), ["doc_key", "parent_cityobject_ix"]).join(child, ["doc_key", "child_cityobject_ix"]).where("key = child_key")
    out["cityobject_children"] = both.select(F.col("key").alias("doc_key"), *[c for c in tables["cityobject_children"].columns if c != "doc_key"])
    held = tables["geometries"].select("doc_key", "cityobject_ix", "geometry_id").unionByName(tables["geometry_instances"].select("doc_key", "cityobject_ix", "geometry_id"))
    by_geometry = materialised(held.join(of, ["doc_key", "cityobject_ix"]).select("doc_key", "geometry_id", "key"))
    for name in tables:
        if name == "geometries" or name.startswith("geometry_"):
            out[name] = moved(tables[name], ["geometry_id"], by_geometry)
    used = out["geometry_boundaries"].select("doc_key", F.explode(F.col("vertex_indices").cast("array<bigint>")).alias("vertex_id"))
    used = used.unionByName(out["geometry_instances"].select("doc_key", F.col("reference_point_vertex_id").alias("vertex_id"))).distinct()
    local = materialised(used.withColumn("local", F.row_number().over(Window.partitionBy("doc_key").orderBy("vertex_id")) - 1))
    origin = of.select("doc_key", "key").distinct()
    points = local.join(origin.select(F.col("doc_key").alias("of"), F.col("key").alias("doc_key")), "doc_key").join(tables["vertices"].withColumnRenamed("doc_key", "of"), ["of", "vertex_id"])
    out["vertices"] = points.select("doc_key", F.col("local").cast("bigint").alias("vertex_id"), "x", "y", "z")
    places = out["geometry_boundaries"].select("doc_key", "geometry_id", F.posexplode("vertex_indices").alias("pos", "v")).join(local.withColumnRenamed("vertex_id", "v"), ["doc_key", "v"])
    fresh = places.groupBy("doc_key", "geometry_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "local"))), lambda p: p["local"].cast("int")).alias("fresh"))
    out["geometry_boundaries"] = out["geometry_boundaries"].join(fresh, ["doc_key", "geometry_id"], "left").withColumn("vertex_indices", F.coalesce("fresh", "vertex_indices")).drop("fresh").select("doc_key", *[f.name for f in schema_of("geometry_boundaries")])
    point = out["geometry_instances"].join(local.select("doc_key", F.col("vertex_id").alias("reference_point_vertex_id"), "local"), ["doc_key", "reference_point_vertex_id"])
    out["geometry_instances"] = point.withColumn("reference_point_vertex_id", F.col("local").cast("bigint")).select("doc_key", *[f.name for f in schema_of("geometry_instances")])
    marks = [out[n].select("doc_key", "semantic_id") for n in ("geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics")]
    marks = reduce(DataFrame.unionByName, marks).where("semantic_id is not null").distinct().withColumnRenamed("doc_key", "key").join(origin, "key")
    around = marks.join(tables["semantics"], ["doc_key", "semantic_id"]).select("doc_key", "key", F.col("parent_semantic_id").alias("semantic_id")).where("semantic_id is not null")
    below = marks.join(tables["semantic_children"].withColumnRenamed("parent_semantic_id", "semantic_id"), ["doc_key", "semantic_id"]).select("doc_key", "key", F.col("child_semantic_id").alias("semantic_id"))
    marks = materialised(marks.select("doc_key", "key", "semantic_id").unionByName(around).unionByName(below).distinct())
    out["semantics"] = moved(tables["semantics"], ["semantic_id"], marks)
    out["semantic_children"] = moved(tables["semantic_children"], ["parent_semantic_id"], marks.withColumnRenamed("semantic_id", "parent_semantic_id"))
    null = F.lit(None)
    roots = members.select("doc_key", "root_id", key.alias("key")).distinct().join(tables["metadata"].select("doc_key", "format_version"), "doc_key")
    made = {"citymodel_id": F.col("root_id"), "citymodel_kind": F.lit(kind), "feature_root_id": F.col("root_id"), "format_version": F.col("format_version")}
    out["metadata"] = roots.select(F.col("key").alias("doc_key"), *[made.get(f.name, null).cast(f.dataType).alias(f.name) for f in schema_of("metadata")])
    return out
