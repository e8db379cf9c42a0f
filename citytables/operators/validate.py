"""Geometry rules as queries for their violations: (geometry_id, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citytables.functions.arrays import boundary_type, no_empty_segments, offsets_consistent, ring_layouts

_LEVELS = {"MultiPoint": [], "MultiLineString": ["line"], "MultiSurface": ["ring", "surface"], "CompositeSurface": ["ring", "surface"], "Solid": ["ring", "surface", "shell"], "MultiSolid": ["ring", "surface", "shell", "solid"], "CompositeSolid": ["ring", "surface", "shell", "solid"]}
_CHILD = {"line": "vertex_indices", "ring": "vertex_indices", "surface": "ring_offsets", "shell": "surface_offsets", "solid": "shell_offsets"}


def _rules(there) -> list:
    """(condition, rule) of a row with its boundary."""
    out = [(~there, "boundary is absent")]
    for level, child in _CHILD.items():
        off, n = F.col(f"{level}_offsets"), F.coalesce(F.size(child), F.lit(0))
        filled = off.isNotNull() & (F.size(off) > 0)
        used = there & filled
        out.append((used & ~offsets_consistent(off, n), f"{level} offsets aren't consistent"))
        out.append((used & offsets_consistent(off, n) & ~no_empty_segments(off, n), f"empty {level}"))
        needs = [kind for kind, levels in _LEVELS.items() if level in levels]
        other = [kind for kind in _LEVELS if kind not in needs]
        out.append((there & F.col("geometry_type").isin(*needs) & ~filled, f"{level} level is required"))
        out.append((there & F.col("geometry_type").isin(*other) & filled, f"{level} level is not allowed"))
    kind = boundary_type(*[F.col(f"{x}_offsets") for x in ("line", "ring", "surface", "shell", "solid")])
    return [*out, (there & (F.regexp_replace("geometry_type", "^Composite", "Multi") != kind), "type doesn't match the boundary")]


def violations(geometries: DataFrame, boundaries: DataFrame, vertices: DataFrame) -> DataFrame:
    """All rules of boundaries, for geometries that aren't instances: one join, one pass, and one look for vertices that don't exist."""
    rows = geometries.where("geometry_type <> 'GeometryInstance'").join(boundaries, "geometry_id", "left")
    there = F.col("vertex_indices").isNotNull()
    broken = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(rule)) for condition, rule in _rules(there)]))
    out = rows.select("geometry_id", F.explode(broken).alias("rule"))
    used = boundaries.select("geometry_id", F.explode(F.array_distinct(F.col("vertex_indices").cast("array<bigint>"))).alias("vertex_id"))
    stray = used.join(vertices.select("vertex_id"), "vertex_id", "left_anti").select("geometry_id").distinct()
    return out.unionByName(stray.select("geometry_id", F.lit("vertex doesn't exist").alias("rule")))


def map_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(geometry_id, rule): semantics, materials and textures that don't fit their geometry or point to nothing.

    Semantics stand in the table of the geometry's primitives, each primitive once; materials and textures on surfaces only,
    at most once a theme; a ring's texture has one UV for each vertex of the ring.
    """
    g = tables["geometries"].select("geometry_id", "geometry_type").join(tables["geometry_boundaries"], "geometry_id")
    n = F.when(F.col("geometry_type") == "MultiPoint", F.size("vertex_indices")).when(F.col("geometry_type") == "MultiLineString", F.size("line_offsets")).otherwise(F.size("surface_offsets"))
    kind = F.when(F.col("geometry_type") == "MultiPoint", "point").when(F.col("geometry_type") == "MultiLineString", "linestring").otherwise("surface")
    sizes = g.select("geometry_id", kind.alias("kind"), n.alias("n"))
    named = lambda df, rule: df.select("geometry_id", F.lit(rule).alias("rule")).distinct()
    out = []
    for name in ("point", "linestring", "surface"):
        table = tables.get(f"geometry_{name}_semantics")
        if table is None:
            continue
        rows = table.select("geometry_id", F.col(f"{name}_ordinal").alias("ordinal"), "semantic_id").join(sizes, "geometry_id")
        out.append(named(rows.where(F.col("kind") != name), f"semantics of a {name}, which the geometry has none of"))
        out.append(named(sparse_maps(rows, "geometry_id", "ordinal", sizes, "n"), "semantics don't cover the primitives, each once"))
        out.append(named(dangling(rows, "semantic_id", tables["semantics"], "semantic_id"), "semantic doesn't exist"))
    if "geometry_surface_materials" in tables:
        rows = tables["geometry_surface_materials"].join(sizes, "geometry_id")
        out.append(named(rows.where("kind <> 'surface'"), "material on a geometry without surfaces"))
        out.append(named(rows.where("surface_ordinal < 0 or surface_ordinal >= n"), "material of a surface that doesn't exist"))
        out.append(named(rows.groupBy("geometry_id", "theme", "surface_ordinal").agg(F.count("*").alias("c")).where("c > 1"), "two materials of one theme on a surface"))
        out.append(named(dangling(rows, "material_id", tables["materials"], "material_id"), "material doesn't exist"))
    if "geometry_ring_textures" in tables:
        ring = ring_layouts(g.where("surface_offsets is not null and size(surface_offsets) > 0"), "geometry_id", "vertex_indices", "ring_offsets", "surface_offsets")
        rows = tables["geometry_ring_textures"].join(sizes, "geometry_id")
        out.append(named(rows.where("kind <> 'surface'"), "texture on a geometry without surfaces"))
        placed = rows.join(ring, ["geometry_id", "surface_ordinal", "ring_ordinal"], "left")
        out.append(named(placed.where("kind = 'surface' and len is null"), "texture of a ring that doesn't exist"))
        out.append(named(placed.where(F.size("uv_indices") != F.col("len")), "a ring has another number of UVs than vertices"))
        out.append(named(rows.groupBy("geometry_id", "theme", "surface_ordinal", "ring_ordinal").agg(F.count("*").alias("c")).where("c > 1"), "two textures of one theme on a ring"))
        out.append(named(dangling(rows, "texture_id", tables["textures"], "texture_id"), "texture doesn't exist"))
        uv = rows.select("geometry_id", F.explode(F.array_distinct("uv_indices")).alias("uv_id"))
        out.append(named(dangling(uv, "uv_id", tables["texture_vertices"], "uv_id"), "UV doesn't exist"))
    return reduce(DataFrame.unionByName, out).distinct()


def root_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(geometry_id, rule): vertices of boundaries, and reference points, beyond the document's vertices."""
    used = tables["geometry_boundaries"].select("geometry_id", F.explode(F.array_distinct(F.col("vertex_indices").cast("array<bigint>"))).alias("vertex_id"))
    if "geometry_instances" in tables:
        used = used.unionByName(tables["geometry_instances"].select("geometry_id", F.col("reference_point_vertex_id").alias("vertex_id")))
    return dangling(used, "vertex_id", tables["vertices"], "vertex_id").select("geometry_id", F.lit("vertex doesn't exist").alias("rule")).distinct()


def dangling(rows: DataFrame, key: str, pool: DataFrame, pool_key: str) -> DataFrame:
    """Rows whose reference isn't in the pool; null references are fine."""
    return rows.where(F.col(key).isNotNull()).join(pool.select(F.col(pool_key).alias(key)), key, "left_anti")


def sparse_maps(rows: DataFrame, id_col: str, ordinal: str, sizes: DataFrame, n: str) -> DataFrame:
    """Ids whose assignment ordinals aren't 0 .. n - 1, each once."""
    got = rows.groupBy(id_col).agg(F.count("*").alias("c"), F.count_distinct(ordinal).alias("d"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    j = got.join(sizes, id_col, "left")
    return j.where((F.col("c") != F.coalesce(n, F.lit(-1))) | (F.col("d") != F.col("c")) | (F.col("lo") != 0) | (F.col("hi") != F.col("c") - 1)).select(id_col)


def instance_violations(instances: DataFrame, templates: DataFrame, vertices: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Instances need a template and a reference point, have 16 numbers if any, and no boundary of their own."""
    named = lambda df, rule: df.select("geometry_id", F.lit(rule).alias("rule"))
    out = [
        named(instances.join(templates, "template_geometry_id", "left_anti"), "template doesn't exist"),
        named(instances.join(vertices.select(F.col("vertex_id").alias("reference_point_vertex_id")), "reference_point_vertex_id", "left_anti"), "reference point doesn't exist"),
        named(instances.where("transform_matrix is not null and size(transform_matrix) <> 16"), "matrix isn't 4 x 4"),
        named(instances.join(boundaries, "geometry_id", "left_semi"), "an instance has a boundary"),
    ]
    return reduce(DataFrame.unionByName, out)


def default_themes(metadata: DataFrame, materials: DataFrame, textures: DataFrame) -> DataFrame:
    """Default themes that no assignment has."""
    m = metadata.select(F.col("default_material_theme").alias("theme")).where("theme is not null").join(materials.select("theme"), "theme", "left_anti")
    t = metadata.select(F.col("default_texture_theme").alias("theme")).where("theme is not null").join(textures.select("theme"), "theme", "left_anti")
    return m.withColumn("kind", F.lit("material")).unionByName(t.withColumn("kind", F.lit("texture")))
