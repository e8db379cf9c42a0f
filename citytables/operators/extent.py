"""Extents, summaries and means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citytables.functions.spatial import affine, box, grid_cell, hilbert, identity, overlaps

SIX = [f"{m}_{a}" for m in ("min", "max") for a in "xyz"]


def object_extents(geometries: DataFrame, vertices: DataFrame) -> DataFrame:
    """cityobject_id and its box over the vertices (geometry_id, x, y, z) of its geometries."""
    per_geometry = vertices.groupBy("geometry_id").agg(*box([F.col(c) for c in "xyz"]))
    rows = per_geometry.join(geometries.select("geometry_id", "cityobject_id"), "geometry_id")
    return rows.groupBy("cityobject_id").agg(*[F.min(c).alias(c) for c in SIX[:3]], *[F.max(c).alias(c) for c in SIX[3:]])


def model_extent(extents: DataFrame) -> DataFrame:
    """One row: the box around all boxes; nulls without any."""
    return extents.agg(*[F.min(c).alias(c) for c in SIX[:3]], *[F.max(c).alias(c) for c in SIX[3:]])


def line_ends(points: DataFrame, by: str) -> DataFrame:
    """The points (x, y, z) that can be at an edge of a box after some matrix.

    Of the points on a line along an axis only both ends can: sums and products keep order when they are rounded, so
    results are the same to the last bit. Numbers that aren't finite are kept each.
    """
    points = points.select(by, "x", "y", "z")
    for own in "zyx":
        other = [c for c in "xyz" if c != own]
        odd = F.when(F.col(own).isNull() | F.isnan(own) | (F.abs(own) == float("inf")), F.col(own))
        ends = points.groupBy(by, *other, odd.alias("__odd")).agg(F.min(own).alias("__low"), F.max(own).alias("__high"))
        points = ends.select(by, *other, F.explode(F.array_distinct(F.array("__low", "__high"))).alias(own))
    return points


def instance_extents(instances: DataFrame, template_vertices: DataFrame) -> DataFrame:
    """Box of each instance: its template's vertices, by its matrix, then moved to its (finite) reference point (rx, ry, rz).

    Vertices meet each different matrix of their template once, not each instance: to move a box moves its points, rounded alike.
    """
    placed = instances.withColumn("__m", F.coalesce("transform_matrix", identity()))
    turns = placed.select("template_geometry_id", "__m").distinct().join(line_ends(template_vertices, "template_geometry_id"), "template_geometry_id")
    boxes = turns.groupBy("template_geometry_id", "__m").agg(*box(affine(F.col("__m"), F.col("x"), F.col("y"), F.col("z"))))
    moved = [(f, f"{m}_{a}", F.col(f"{m}_{a}") + F.col(f"r{a}")) for m, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    return placed.join(boxes, ["template_geometry_id", "__m"]).groupBy("geometry_id").agg(*[f(c).alias(n) for f, n, c in moved])


def bbox_query(extents: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose box meets the window."""
    return extents.where(overlaps(F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"), window))


def with_hilbert(extents: DataFrame, order: int = 16, points: DataFrame | None = None) -> DataFrame:
    """Rows with the Hilbert number of their box's centre on a grid over the whole extent.

    points (x, y): what the boxes are around, if at hand; the whole extent is then found without the boxes.
    """
    if points is None:
        points = extents.select(F.inline(F.array(F.struct(F.col("min_x").alias("x"), F.col("min_y").alias("y")), F.struct(F.col("max_x").alias("x"), F.col("max_y").alias("y")))))
    whole = points.agg(F.min("x").alias("__x"), F.min("y").alias("__y"), (F.max("x") - F.min("x")).alias("__w"), (F.max("y") - F.min("y")).alias("__h"))
    cx, cy = (F.col("min_x") + F.col("max_x")) * 0.5, (F.col("min_y") + F.col("max_y")) * 0.5
    joined = extents.crossJoin(F.broadcast(whole))  # one row
    cells = 1 << order
    keyed = joined.withColumn("hilbert", hilbert(grid_cell(cx, F.col("__x"), F.col("__w"), cells), grid_cell(cy, F.col("__y"), F.col("__h"), cells), order))
    return keyed.drop("__x", "__y", "__w", "__h")


def clustered(extents: DataFrame, partitions: int) -> DataFrame:
    """Rows laid out along the Hilbert curve: written so, row groups of near boxes are skipped by a window's min / max filter."""
    return with_hilbert(extents).repartitionByRange(partitions, "hilbert").sortWithinPartitions("hilbert", "cityobject_id")


def mean_coordinates(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("geometry_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in "xyz"])


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the number of rows of each table, each counted by itself from metadata-only scans."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(f"n_{name}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
