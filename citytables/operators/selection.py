"""Selection algebra over objects and geometries, closures, subsets and extraction.

A selection has one row an object: cityobject_id, whole, geometry_ids (sorted; empty if whole).
objects: cityobject_id, ix, ...; edges: parent_id, child_id; geometries: geometry_id,
cityobject_id, geometry_ordinal, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citytables.session import materialised

_NONE = "cast(array() as array<bigint>)"


def select_objects(objects: DataFrame, predicate: Column) -> DataFrame:
    """Whole objects for which the predicate holds."""
    return objects.where(predicate).select("cityobject_id", F.lit(True).alias("whole"), F.expr(_NONE).alias("geometry_ids"))


def select_geometries(objects: DataFrame, geometries: DataFrame, predicate: Column) -> DataFrame:
    """Parts of objects: their geometries for which the predicate (over both tables' columns) holds."""
    hits = geometries.join(objects, "cityobject_id").where(predicate)
    return hits.groupBy("cityobject_id").agg(F.lit(False).alias("whole"), F.array_sort(F.collect_set(F.col("geometry_id").cast("bigint"))).alias("geometry_ids"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """A whole object absorbs its parts; parts are united."""
    both = a.unionByName(b).groupBy("cityobject_id").agg(F.bool_or("whole").alias("whole"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("geometry_ids")))).alias("g"))
    return both.select("cityobject_id", "whole", F.when(F.col("whole"), F.expr(_NONE)).otherwise(F.col("g")).alias("geometry_ids"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whole with parts gives the parts; disjoint parts drop the object."""
    r = b.select("cityobject_id", F.col("whole").alias("w"), F.col("geometry_ids").alias("g"))
    joined = a.join(r, "cityobject_id")
    ids = F.when(F.col("whole"), F.col("g")).when(F.col("w"), F.col("geometry_ids")).otherwise(F.array_sort(F.array_intersect("geometry_ids", "g")))
    return joined.select("cityobject_id", (F.col("whole") & F.col("w")).alias("whole"), ids.alias("geometry_ids")).where("whole or size(geometry_ids) > 0")


def closure(edges: DataFrame, start: DataFrame, children: bool = True, parents: bool = False) -> DataFrame:
    """Ids reachable from start (cityobject_id), itself included; cycles end, as only new ids go on."""
    ways = []
    if children:
        ways.append(edges.select(F.col("parent_id").alias("cityobject_id"), F.col("child_id").alias("to")))
    if parents:
        ways.append(edges.select(F.col("child_id").alias("cityobject_id"), F.col("parent_id").alias("to")))
    step = materialised(ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1]))  # read in every round
    seen = frontier = materialised(start.select("cityobject_id").distinct())
    while True:
        frontier = materialised(frontier.join(step, "cityobject_id").select(F.col("to").alias("cityobject_id")).distinct().join(seen, "cityobject_id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def include_relatives(selection: DataFrame, edges: DataFrame) -> DataFrame:
    """All parents and children, over and over, as whole objects; what was selected keeps its state."""
    reached = closure(edges, selection, children=True, parents=True).join(selection, "cityobject_id", "left_anti")
    return selection.unionByName(reached.select("cityobject_id", F.lit(True).alias("whole"), F.expr(_NONE).alias("geometry_ids")))


def subset(objects: DataFrame, edges: DataFrame, ids: list[str], exclude: bool = False) -> DataFrame:
    """Rows of the objects with these ids and their descendants, or with exclude all others.

    No ids, or none that exists, is an error; unknown ids beside known ones are ignored.
    """
    if not ids:
        raise ValueError("no ids given")
    start = objects.where(F.col("cityobject_id").isin(*ids))
    if start.isEmpty():
        raise ValueError("none of the ids exists")
    return objects.join(closure(edges, start), "cityobject_id", "left_anti" if exclude else "left_semi")


def pruned(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept."""
    keep = kept.select("cityobject_id")
    return edges.join(keep.withColumnRenamed("cityobject_id", "parent_id"), "parent_id", "left_semi").join(keep.withColumnRenamed("cityobject_id", "child_id"), "child_id", "left_semi")


def extract(objects: DataFrame, edges: DataFrame, geometries: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selected objects, edges among them and their selected geometries; ids that aren't an object's geometry are an error."""
    chosen = materialised(selection)  # one evaluation for objects, edges and geometries
    kept = objects.join(chosen, "cityobject_id", "left_semi")
    own = geometries.join(chosen.where("whole").select("cityobject_id"), "cityobject_id", "left_semi")
    parts = chosen.where("not whole").select(F.col("cityobject_id").alias("__object"), F.explode("geometry_ids").alias("__geometry"))
    # a part that no geometry answers to is found in the same join
    met = parts.join(geometries, (F.col("geometry_id") == F.col("__geometry")) & (F.col("cityobject_id") == F.col("__object")), "left")
    stray = F.when(F.col("geometry_id").isNull(), F.raise_error(F.concat(F.lit("the selection has a geometry that its object doesn't: "), F.col("__geometry").cast("string")))).otherwise(F.col("geometry_id"))
    shown = own.unionByName(met.withColumn("geometry_id", stray).select(geometries.columns))
    return kept, pruned(edges, kept), shown


def reroot(objects: DataFrame, edges: DataFrame, selected: DataFrame, root: str | None) -> str:
    """The root if it is selected, else the first selected object (by ix) without a selected parent; none is an error."""
    if root is not None and not selected.where(F.col("cityobject_id") == root).isEmpty():
        return root
    inner = pruned(edges, selected).select(F.col("child_id").alias("cityobject_id"))
    top = objects.join(selected, "cityobject_id", "left_semi").join(inner, "cityobject_id", "left_anti")
    first = top.agg(F.min_by("cityobject_id", "ix")).first()[0]
    if first is None:
        raise ValueError("no selected object can be the root")
    return first
