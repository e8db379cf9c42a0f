"""Seeded synthetic models, table by table, from ranges and hashes; the same seed gives the same rows on any cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.schema import LODS


@dataclass
class GenerateConfig:
    objects: int = 100
    geometries_per_object: int = 2
    surfaces_per_geometry: int = 4
    children: bool = True
    object_types: tuple[str, ...] = ("Building", "BuildingPart", "CityFurniture", "Road")
    extent: tuple[float, float, float] = (1000.0, 1000.0, 50.0)


def draw(seed: int, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def pick(seed: int, values, *keys) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw(seed, *keys) * len(values)) + 1).cast("int"))


def generate(spark: SparkSession, config: GenerateConfig, seed: int = 42) -> dict[str, DataFrame]:
    """cityobjects, cityobject_children, geometries, geometry_boundaries, vertices, semantics and their assignments."""
    ids = spark.range(config.objects).select(F.col("id").alias("cityobject_ix"))
    kind = pick(seed, config.object_types, F.lit("type"), "cityobject_ix")
    value = (
        F.when(F.pmod(F.xxhash64(F.lit(seed), "cityobject_ix"), F.lit(7)) == 0, F.lit("null"))
        .when(F.pmod("cityobject_ix", F.lit(3)) == 0, F.concat(F.lit('"'), F.hex("cityobject_ix"), F.lit('"')))
        .otherwise(F.round(draw(seed, F.lit("value"), "cityobject_ix") * 100).cast("bigint").cast("string"))
    )
    objects = ids.select(
        F.concat(F.lit("object-"), "cityobject_ix").alias("cityobject_id"), "cityobject_ix", kind.alias("object_type"), F.lit(None).cast("array<double>").alias("geographical_extent"),
        F.concat(F.lit('{"height":'), F.round(draw(seed, F.lit("height"), "cityobject_ix") * 30, 2).cast("string"), F.lit(',"value":'), value, F.lit("}")).alias("attributes"),
        F.lit(None).cast("string").alias("extra"),
    )
    parents = max(1, config.objects // 2)
    n_children = config.objects - parents if config.children else 0
    edges = spark.range(n_children).select(
        F.floor(draw(seed, F.lit("parent"), "id") * parents).cast("bigint").alias("parent_cityobject_ix"), F.col("id").cast("int").alias("child_ordinal"), (F.col("id") + parents).alias("child_cityobject_ix")
    )
    g = spark.range(config.objects * config.geometries_per_object).select(
        F.col("id").alias("geometry_id"), F.expr(f"id div {config.geometries_per_object}").alias("cityobject_ix"), F.expr(f"cast(id % {config.geometries_per_object} as int)").alias("geometry_ordinal")
    )
    geometries = g.select("geometry_id", "cityobject_ix", "geometry_ordinal", F.lit("MultiSurface").alias("geometry_type"), pick(seed, LODS, F.lit("lod"), "geometry_id").alias("lod"), F.lit(None).cast("string").alias("extra"))
    n = config.surfaces_per_geometry
    first = F.col("geometry_id") * (4 * n)
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * 4)
    null = F.lit(None).cast("array<int>")
    boundaries = g.select(
        "geometry_id", F.transform(F.sequence(F.lit(0), F.lit(4 * n - 1)), lambda i: (i + first).cast("int")).alias("vertex_indices"), null.alias("line_offsets"), starts.alias("ring_offsets"),
        F.sequence(F.lit(0), F.lit(n - 1)).alias("surface_offsets"), null.alias("shell_offsets"), null.alias("solid_offsets"),
    )
    at = lambda axis: F.round(draw(seed, F.lit(axis), "id") * config.extent["xyz".index(axis)], 3).alias(axis)
    vertices = spark.range(config.objects * config.geometries_per_object * 4 * n).select(F.col("id").alias("vertex_id"), at("x"), at("y"), at("z"))
    semantics = spark.createDataFrame([(0, "RoofSurface"), (1, "WallSurface"), (2, "GroundSurface")], "semantic_id bigint, semantic_type string").select("*", F.lit(None).cast("bigint").alias("parent_semantic_id"), F.lit(None).cast("string").alias("attributes"))
    surfaces = g.select("geometry_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("surface_ordinal"))
    assigned = surfaces.select("geometry_id", "surface_ordinal", F.floor(draw(seed, F.lit("semantic"), "geometry_id", "surface_ordinal") * 3).cast("bigint").alias("semantic_id"))
    return {"cityobjects": objects, "cityobject_children": edges, "geometries": geometries, "geometry_boundaries": boundaries, "vertices": vertices, "semantics": semantics, "geometry_surface_semantics": assigned}
