"""Appending and merging of models: two policies for objects that both sides have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citytables.functions.spatial import box_union
from citytables.session import materialised

#: Tables with dense ids of their own, and where those ids are referred to.
ID_SPACES = {
    "vertices": ("vertex_id", [("geometry_boundaries", "vertex_indices"), ("geometry_instances", "reference_point_vertex_id")]),
    "template_vertices": ("template_vertex_id", [("template_geometry_boundaries", "vertex_indices")]),
    "texture_vertices": ("uv_id", [("geometry_ring_textures", "uv_indices"), ("template_geometry_ring_textures", "uv_indices")]),
    "semantics": ("semantic_id", [(t, "semantic_id") for t in ("geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics", "template_geometry_semantics")] + [("semantics", "parent_semantic_id"), ("semantic_children", "parent_semantic_id"), ("semantic_children", "child_semantic_id")]),
    "materials": ("material_id", [("geometry_surface_materials", "material_id"), ("template_geometry_materials", "material_id")]),
    "textures": ("texture_id", [("geometry_ring_textures", "texture_id"), ("template_geometry_ring_textures", "texture_id")]),
    "template_geometries": ("template_geometry_id", [(t, "template_geometry_id") for t in ("template_geometry_boundaries", "template_geometry_semantics", "template_geometry_materials", "template_geometry_ring_textures", "geometry_instances")]),
    "geometries": ("geometry_id", [(t, "geometry_id") for t in ("geometry_boundaries", "geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics", "geometry_surface_materials", "geometry_ring_textures", "geometry_instances")]),
}


def _moved(df: DataFrame, column: str, by: int) -> DataFrame:
    if column not in df.columns or not by:
        return df
    kind = dict(df.dtypes)[column]
    if kind.startswith("array"):
        return df.withColumn(column, F.transform(column, lambda i: i + by).cast(kind))
    return df.withColumn(column, (F.col(column) + by).cast(kind))


def append_pools(target: dict[str, DataFrame], source: dict[str, DataFrame], objects: bool = True) -> dict[str, DataFrame]:
    """Union of all tables, the source's ids moved past the target's, with no dedup; ids of objects must differ.

    Without objects, tables that hang on objects aren't united: the source's geometries and instances, moved but for
    their objects' numbers, are there under their name and a plus sign.
    """
    moved = dict(source)
    for table, (own, uses) in ID_SPACES.items():
        if table not in target or table not in source:
            continue
        ids = [target[t].agg(F.max(own)).first()[0] for t in ([table, "geometry_instances"] if table == "geometries" else [table]) if t in target]
        by = max((i + 1 for i in ids if i is not None), default=0)
        for t, c in [(table, own), *uses]:
            if t in moved:
                moved[t] = _moved(moved[t], c, by)
    out = {}
    if objects and "cityobjects" in source:
        by = (target["cityobjects"].agg(F.max("cityobject_ix")).first()[0] if "cityobjects" in target else None)
        by = 0 if by is None else by + 1
        for t, columns in {**_BY_OBJECT, "cityobjects": ["cityobject_ix"]}.items():
            for c in columns if t in moved else ():
                moved[t] = _moved(moved[t], c, by)
        if "cityobjects" in target:
            out["cityobjects"] = append_strict(target["cityobjects"], moved["cityobjects"])
        else:
            out["cityobjects"] = moved["cityobjects"]
    for t in {**target, **source}:
        if t in ("cityobjects", "metadata"):
            continue
        if not objects and t in _BY_OBJECT:
            if t in moved:
                out[f"{t}+"] = moved[t]
            if t in target:
                out[t] = target[t]
            continue
        out[t] = target[t].unionByName(moved[t]) if t in target and t in moved else target.get(t, moved.get(t))
    return out


def merged_attributes(target: Column, source: Column) -> Column:
    """Two JSON objects as one; of equal keys the source's value stays. Every value keeps its kind."""
    a, b = F.from_json(target, "map<string,variant>"), F.from_json(source, "map<string,variant>")
    both = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    return F.when(a.isNull(), source).when(b.isNull(), target).otherwise(F.to_json(both))


def merge_objects(target: DataFrame, source: DataFrame) -> DataFrame:
    """Objects by id: types must agree, attributes of the source win, extents are united, first order stays."""
    s = source.select("cityobject_id", *[F.col(c).alias(f"__{c}") for c in source.columns if c != "cityobject_id"])
    j = target.join(s, "cityobject_id", "full_outer")
    clash = F.col("object_type").isNotNull() & F.col("__object_type").isNotNull() & (F.col("object_type") != F.col("__object_type"))
    kind = F.when(clash, F.raise_error(F.concat(F.lit("types differ for "), "cityobject_id"))).otherwise(F.coalesce("object_type", "__object_type"))
    return j.select(
        "cityobject_id", kind.alias("object_type"), merged_attributes(F.col("attributes"), F.col("__attributes")).alias("attributes"),
        box_union(F.col("geographical_extent"), F.col("__geographical_extent")).alias("geographical_extent"), F.coalesce("cityobject_ix", "__cityobject_ix").alias("cityobject_ix"),
    )


def append_strict(target: DataFrame, source: DataFrame) -> DataFrame:
    """Union of objects; an id on both sides (or twice on one) is an error, found while the rows are read."""
    both = target.unionByName(source)
    n = F.count("*").over(Window.partitionBy("cityobject_id"))
    twice = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate object: "), "cityobject_id"))).otherwise(F.col("cityobject_id"))
    return both.withColumn("cityobject_id", twice)


def duplicate_ids(*sides: DataFrame) -> DataFrame:
    """Ids that occur more than once."""
    both = reduce(DataFrame.unionByName, [s.select("cityobject_id") for s in sides])
    return both.groupBy("cityobject_id").agg(F.count("*").alias("n")).where("n > 1")


def merge_metadata(models: DataFrame) -> DataFrame:
    """One row of models (ix, identifier, title, ..., geographical_extent): first that isn't null, extents united."""
    plain = [c for c in models.columns if c not in ("ix", "geographical_extent")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ix"))).alias(c) for c in plain]
    e = F.col("geographical_extent")
    extent = F.array(*[F.min(e[i]) for i in range(3)], *[F.max(e[i]) for i in range(3, 6)])
    return models.agg(*first, F.when(F.count(e) > 0, extent).alias("geographical_extent"))


def merge_extensions(target: DataFrame, source: DataFrame, strict: bool = False) -> DataFrame:
    """Extensions by name: the source replaces the target; with strict, unlike ones are an error."""
    s = source.select("extension_name", F.col("uri").alias("__uri"), F.col("version").alias("__version"))
    j = target.join(s, "extension_name", "full_outer")
    uri = F.coalesce("__uri", "uri")
    if strict:
        unlike = F.col("uri").isNotNull() & F.col("__uri").isNotNull() & (~F.col("uri").eqNullSafe(F.col("__uri")) | ~F.col("version").eqNullSafe(F.col("__version")))
        uri = F.when(unlike, F.raise_error(F.concat(F.lit("extensions differ: "), "extension_name"))).otherwise(uri)
    return j.select("extension_name", uri.alias("uri"), F.when(F.col("__uri").isNotNull(), F.col("__version")).otherwise(F.col("version")).alias("version"))


def transform_state(models: DataFrame, columns: list[str]) -> DataFrame:
    """One row: 'empty' without a transform, 'present' if all that have one agree, else 'cleared' (and cleared it stays)."""
    some = F.col(columns[0]).isNotNull()
    n = F.count_distinct(F.when(some, F.struct(*columns)))
    return models.agg(F.when(n == 0, "empty").when(n == 1, "present").otherwise("cleared").alias("state"))


def dense_ranks(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in an order, from 0: sorted in ranges, and only the ranges' counts are summed up."""
    ranged = materialised(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__rank", rank).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__rank")).cast("bigint")).drop("__part", "__rank", "__start")


def get_or_insert(resources: DataFrame, columns: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Distinct resources with dense ids by first appearance, and the id of each row of resources.

    Nulls are equal to nulls. The ids come from ranges of the distinct resources, so no task sees all.
    """
    first = resources.groupBy(*columns).agg(F.min(order).alias("__first"))
    pool = dense_ranks(first, ["__first"], "resource_id")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in columns])
    ids = resources.alias("r").join(pool.alias("p"), same).select(f"r.{order}", "p.resource_id")
    return pool.drop("__first"), ids


#: Tables that hang on objects by their number.
_BY_OBJECT = {"geometries": ["cityobject_ix"], "geometry_instances": ["cityobject_ix"], "cityobject_children": ["parent_cityobject_ix", "child_cityobject_ix"]}


def merge_models(target: dict[str, DataFrame], source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two models as one (canonical tables without doc_key): all pools are appended, objects of one id become one.

    An object that both have keeps the target's place; its types must agree, the source's attributes and extra members
    win, extents unite, its geometries stand behind the target's, and so do new children. A document takes in features; other kinds
    must be equal. Extensions of the source replace equal ones; metadata is the first that isn't null.
    """
    out = append_pools(target, {n: df for n, df in source.items() if n not in (*_BY_OBJECT, "cityobjects", "extensions", "metadata")} | {n: source[n] for n in ("geometries", "geometry_instances") if n in source}, objects=False)
    t = target["cityobjects"].select("cityobject_id", F.col("cityobject_ix").alias("t_ix"))
    n_objects = target["cityobjects"].agg(F.coalesce(F.max("cityobject_ix") + 1, F.lit(0)).alias("n"))  # one row
    moved = source["cityobjects"].select("cityobject_id", F.col("cityobject_ix").alias("s_ix")).join(t, "cityobject_id", "left").crossJoin(F.broadcast(n_objects))
    moved = materialised(moved.select("cityobject_id", "s_ix", F.coalesce("t_ix", F.col("n") + F.col("s_ix")).alias("to")))
    mine = source["cityobjects"].drop("cityobject_ix").join(moved, "cityobject_id").withColumnRenamed("to", "cityobject_ix").drop("s_ix")
    objects = merge_objects(target["cityobjects"], mine)
    extra = target["cityobjects"].select("cityobject_id", F.col("extra").alias("__t")).join(source["cityobjects"].select("cityobject_id", F.col("extra").alias("__s")), "cityobject_id", "full_outer")
    out["cityobjects"] = objects.join(extra, "cityobject_id").select("cityobject_id", "cityobject_ix", "object_type", "geographical_extent", "attributes", merged_attributes(F.col("__t"), F.col("__s")).alias("extra"))

    # geometries of the source go behind those of the target
    last = None
    for name in ("geometries", "geometry_instances"):
        if name in target:
            own = target[name].select("cityobject_ix", "geometry_ordinal")
            last = own if last is None else last.unionByName(own)
    last = last.groupBy("cityobject_ix").agg((F.max("geometry_ordinal") + 1).alias("__first"))
    for name in ("geometries", "geometry_instances"):
        if name in source:
            shifted = out[f"{name}+"].join(moved.select(F.col("s_ix").alias("cityobject_ix"), "to"), "cityobject_ix").drop("cityobject_ix").withColumnRenamed("to", "cityobject_ix")
            shifted = shifted.join(last, "cityobject_ix", "left").withColumn("geometry_ordinal", (F.col("geometry_ordinal") + F.coalesce("__first", F.lit(0))).cast("int")).drop("__first")
            out[name] = target[name].unionByName(shifted) if name in target else shifted
        out.pop(f"{name}+", None)

    # children: the target's order first, then those that only the source has
    if "cityobject_children" in target or "cityobject_children" in source:
        sides = []
        if "cityobject_children" in target:
            sides.append(target["cityobject_children"].select("parent_cityobject_ix", F.lit(0).alias("side"), "child_ordinal", "child_cityobject_ix"))
        if "cityobject_children" in source:
            of = lambda c: moved.select(F.col("s_ix").alias(c), F.col("to").alias(f"{c}_to"))
            s = source["cityobject_children"].join(of("parent_cityobject_ix"), "parent_cityobject_ix").join(of("child_cityobject_ix"), "child_cityobject_ix")
            sides.append(s.select(F.col("parent_cityobject_ix_to").alias("parent_cityobject_ix"), F.lit(1).alias("side"), "child_ordinal", F.col("child_cityobject_ix_to").alias("child_cityobject_ix")))
        both = reduce(DataFrame.unionByName, sides).groupBy("parent_cityobject_ix", "child_cityobject_ix").agg(F.min(F.struct("side", "child_ordinal")).alias("at"))
        ordinal = F.row_number().over(Window.partitionBy("parent_cityobject_ix").orderBy("at", "child_cityobject_ix")) - 1
        out["cityobject_children"] = both.select("parent_cityobject_ix", ordinal.cast("int").alias("child_ordinal"), "child_cityobject_ix")
    if "extensions" in source:
        out["extensions"] = merge_extensions(target["extensions"], source["extensions"]) if "extensions" in target else source["extensions"]

    both = target["metadata"].withColumn("ix", F.lit(0)).unionByName(source["metadata"].withColumn("ix", F.lit(1)))
    kinds = target["metadata"].select(F.col("citymodel_kind").alias("a")).crossJoin(F.broadcast(source["metadata"].select(F.col("citymodel_kind").alias("b"))))  # one row each
    fits = (F.col("a") == F.col("b")) | (~F.col("a").endswith("Feature") & F.col("b").endswith("Feature"))
    kind = kinds.select(F.when(fits, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("kinds differ: "), F.col("a"), F.lit(" and "), F.col("b")))).alias("citymodel_kind"))
    extras = both.groupBy().agg(*[F.sort_array(F.collect_list(F.struct("ix", c))).alias(c) for c in ("root_extra", "metadata_extra")])  # two rows
    one = lambda c: merged_attributes(F.col(c)[0][c], F.col(c)[1][c]).alias(c)
    rest = merge_metadata(both.drop("citymodel_kind", "root_extra", "metadata_extra"))
    out["metadata"] = rest.crossJoin(F.broadcast(kind)).crossJoin(F.broadcast(extras.select(one("root_extra"), one("metadata_extra")))).select(*target["metadata"].columns)  # one row each
    return {n: out[n].select(*(target.get(n, source.get(n)).columns)) for n in out}


def merge_all(models: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Models as one, from the first on; every step is written, so that plans don't pile up. No model is an error."""
    if not models:
        raise ValueError("no models to merge")
    out = models[0]
    for m in models[1:]:
        out = {n: materialised(df) for n, df in merge_models(out, m).items()}
    return out


def prefix_offsets(counts: DataFrame, order: str, n: str) -> DataFrame:
    """Start of each model's ids: the sum of the counts before it."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("bigint"))
