"""Nested boundaries, offset arrays and long-form assignments as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it (functions of array members else repeat it for each)."""
    return F.transform(F.array(value), f)[0]


def offsets(parts: Column) -> Column:
    """Start of each part in the flattened array: running sums of the sizes, from 0."""
    sizes = F.transform(parts, lambda p: F.size(p))
    sums = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return F.slice(sums, F.lit(1), F.size(parts))


def flatten_levels(nested: Column, depth: int) -> list[Column]:
    """Vertex indices, then the offsets of each level from the innermost out (rings, surfaces, shells, solids)."""
    levels: list[Column] = []
    for _ in range(depth - 1):
        levels.append(offsets(nested))
        nested = F.flatten(nested)
    return [nested, *reversed(levels)]


def unflatten(children: Column, starts: Column) -> Column:
    """Arrays of children, one for each start; the last ends with the children."""
    ends = lambda c: F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(c)))
    return bound(children, lambda c: F.zip_with(starts, ends(c), lambda a, z: F.slice(c, a + 1, z - a)))


def offsets_consistent(starts: Column, n_children: Column) -> Column:
    """Offsets begin at 0, never fall, and stay within the children."""
    first = F.coalesce(F.try_element_at(starts, F.lit(1)), F.lit(0)) == 0
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(starts) - 1, F.lit(1))), lambda i: (i >= F.size(starts)) | (F.try_element_at(starts, i) <= F.try_element_at(starts, i + 1)))
    return first & rising & F.forall(starts, lambda s: s <= n_children)


def no_empty_segments(starts: Column, n_children: Column) -> Column:
    return F.forall(unflatten(F.sequence(F.lit(1), F.greatest(n_children, F.lit(1))), starts), lambda p: F.size(p) > 0)


def boundary_type(line: Column, ring: Column, surface: Column, shell: Column, solid: Column) -> Column:
    """Kind of boundary by the outermost level that is there."""
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(filled(solid), "MultiSolid").when(filled(shell), "Solid").when(filled(surface) | filled(ring), "MultiSurface").when(filled(line), "MultiLineString").otherwise("MultiPoint")


def ring_layouts(df: DataFrame, id_col: str, vertices: str, rings: str, surfaces: str) -> DataFrame:
    """id, surface_ordinal, ring_ordinal (in its surface), start and len of every ring."""
    n = F.size(vertices)
    ring_rows = df.select(id_col, F.col(surfaces).alias("__s"), n.alias("__n"), F.col(rings).alias("__r"), F.posexplode(rings).alias("__ring", "start"))
    end = F.coalesce(F.try_element_at("__r", F.col("__ring") + 2), F.col("__n"))
    surface = F.size(F.filter("__s", lambda s: s <= F.col("__ring"))) - 1
    return ring_rows.select(id_col, surface.alias("surface_ordinal"), (F.col("__ring") - F.element_at("__s", surface + 1)).alias("ring_ordinal"), "start", (end - F.col("start")).alias("len"))


def fan(ring: Column) -> Column:
    """Triangles of a ring as a fan from its first vertex; none for fewer than three."""
    return F.when(F.size(ring) >= 3, F.transform(F.sequence(F.lit(2), F.size(ring) - 1), lambda i: F.array(ring[0], F.element_at(ring, i), F.element_at(ring, i + 1)))).otherwise(F.array().cast("array<array<int>>"))


def unique_indices(indices: Column) -> Column:
    return F.array_sort(F.array_distinct(indices))


def resized(values: Column, n: Column) -> Column:
    """Values cut to n or filled up with nulls."""
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_element_at(values, i))


def uniform(values: Column) -> Column:
    """Whether all values are one that isn't null."""
    return (F.size(F.array_distinct(values)) == 1) & F.forall(values, lambda v: v.isNotNull())


def remap(indices: Column, offset: Column | int) -> Column:
    return F.transform(indices, lambda i: i + offset)


def localise(df: DataFrame, group: str, index: str) -> DataFrame:
    """Every referenced index with its dense local number in its group."""
    local = Window.partitionBy(group).orderBy(index)
    return df.select(group, index).distinct().withColumn("local_index", (F.row_number().over(local) - 1).cast("bigint"))


def long_form(df: DataFrame, id_col: str, values: str, ordinal: str, value: str) -> DataFrame:
    """One row for each assignment, nulls kept."""
    return df.select(id_col, F.posexplode_outer(values).alias(ordinal, value))


def reassembled(rows: DataFrame, id_col: str, ordinal: str, value: str) -> DataFrame:
    """Arrays from long-form rows; `dense` tells whether the ordinals are 0 .. n - 1, each once."""
    grouped = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(ordinal, value))).alias("__rows"))
    dense = F.transform("__rows", lambda r: r[ordinal].cast("int")) == F.sequence(F.lit(0), F.size("__rows") - 1)
    return grouped.select(id_col, F.transform("__rows", lambda r: r[value]).alias("values"), dense.alias("dense"))
