"""Filters by object type and level of detail, with diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citytables.functions.spatial import lod_value
from citytables.operators.selection import closure


@dataclass(frozen=True)
class LodSelection:
    """All levels, the highest of each object, or one exact spelling."""

    kind: str = "all"
    value: str | None = None


@dataclass
class FeatureFilter:
    types: list[str] | None = None
    lod: LodSelection = LodSelection()
    by_type: dict[str, LodSelection] = field(default_factory=dict)

    def active(self) -> bool:
        return self.types is not None or self.lod.kind != "all" or any(s.kind != "all" for s in self.by_type.values())


def retained_objects(objects: DataFrame, edges: DataFrame, types: list[str] | None) -> DataFrame:
    """Objects of the types and all their descendants."""
    if types is None:
        return objects
    return objects.join(closure(edges, objects.where(F.col("object_type").isin(*types))), "cityobject_id", "left_semi")


def highest_lod(geometries: DataFrame) -> DataFrame:
    """cityobject_id and its highest level; of equal levels the last geometry's spelling."""
    return geometries.where("lod is not null").groupBy("cityobject_id").agg(F.max_by("lod", F.struct(lod_value(F.col("lod")), F.col("geometry_ordinal"))).alias("lod"))


def _wanted(rule: LodSelection) -> Column:
    if rule.kind == "all":
        return F.lit(True)
    if rule.kind == "highest":
        return F.col("lod") == F.col("highest")
    return F.col("lod") == F.lit(rule.value)


def retained_geometries(objects: DataFrame, geometries: DataFrame, rules: FeatureFilter) -> DataFrame:
    """Geometries that the rule of their object's type lets through."""
    rows = geometries.join(objects.select("cityobject_id", "object_type"), "cityobject_id")
    if any(r.kind == "highest" for r in (rules.lod, *rules.by_type.values())):
        rows = rows.join(highest_lod(geometries).withColumnRenamed("lod", "highest"), "cityobject_id", "left")
    keep = _wanted(rules.lod)
    for kind, rule in rules.by_type.items():
        keep = F.when(F.col("object_type") == kind, _wanted(rule)).otherwise(keep)
    return rows.where(F.coalesce(keep, F.lit(False)))


def apply(objects: DataFrame, edges: DataFrame, geometries: DataFrame, rules: FeatureFilter) -> tuple[DataFrame, DataFrame]:
    """Objects and geometries that are left. With a level rule, objects without such a geometry go."""
    kept = retained_objects(objects, edges, rules.types)
    shown = retained_geometries(kept, geometries, rules)
    if rules.lod.kind != "all" or any(r.kind != "all" for r in rules.by_type.values()):
        kept = kept.join(shown.select("cityobject_id"), "cityobject_id", "left_semi")
    return kept, shown


def diagnostics(objects: DataFrame, geometries: DataFrame, shown: DataFrame) -> DataFrame:
    """Per object type: objects, geometries with a level there and retained, levels there and retained."""
    typed = geometries.join(objects.select("cityobject_id", "object_type"), "cityobject_id").where("lod is not null")
    levels = typed.groupBy("object_type").agg(F.count("*").alias("available"), F.array_join(F.array_sort(F.collect_set("lod")), ",").alias("available_lods"))
    kept = shown.where("lod is not null").groupBy("object_type").agg(F.count("*").alias("retained"), F.array_join(F.array_sort(F.collect_set("lod")), ",").alias("retained_lods"))
    n = objects.groupBy("object_type").agg(F.count("*").alias("objects"))
    joined = n.join(levels, "object_type", "left").join(kept, "object_type", "left")
    return joined.select(
        "object_type", "objects", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("retained", F.lit(0)).alias("retained"),
        F.coalesce("available_lods", F.lit("")).alias("available_lods"), F.coalesce("retained_lods", F.lit("")).alias("retained_lods"),
    )


def lod_failures(objects: DataFrame, geometries: DataFrame, requested: dict[str, str]) -> DataFrame:
    """object_type and lod of the requested levels that no geometry of the type has."""
    spark = objects.sparkSession
    asked = spark.createDataFrame(sorted(requested.items()), "object_type string, lod string")
    there = geometries.join(objects.select("cityobject_id", "object_type"), "cityobject_id").select("object_type", "lod").distinct()
    return asked.join(there, ["object_type", "lod"], "left_anti")


def ensure_lods(objects: DataFrame, geometries: DataFrame, requested: dict[str, str]) -> None:
    missing = lod_failures(objects, geometries, requested).limit(20).collect()
    if missing:
        raise ValueError("no geometry at: " + ", ".join(f"{r['object_type']} {r['lod']}" for r in missing))
