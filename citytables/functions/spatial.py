"""Coordinates, boxes, grids and level-of-detail values as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citytables.schema import LODS, OBJECT_TYPES, SEMANTIC_TYPES, VERSIONS


def quantize(v: Column, scale: Column | float = 1.0, translate: Column | float = 0.0) -> Column:
    """Whole number nearest to (v - translate) / scale; halves away from zero."""
    return F.round((v - translate) / scale).cast("bigint")


def dequantize(v: Column, scale: Column | float = 1.0, translate: Column | float = 0.0) -> Column:
    return v * scale + translate


def affine(matrix: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The three coordinates of a point after a row-major 4 x 4 matrix; an absent matrix is the identity."""
    one = F.coalesce(matrix, identity())
    at = lambda i: F.element_at(one, i + 1)
    return [at(4 * r) * x + at(4 * r + 1) * y + at(4 * r + 2) * z + at(4 * r + 3) for r in range(3)]


def identity() -> Column:
    return F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])


def box(columns: list[Column]) -> list[Column]:
    """min and max of each coordinate, as aggregates named min_x .. max_z."""
    return [f(c).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a, c in zip("xyz", columns, strict=False)]


def box_union(a: Column, b: Column) -> Column:
    """Union of two boxes of six numbers; a null box leaves the other."""
    low = [F.least(a[i], b[i]) for i in range(3)]
    high = [F.greatest(a[i], b[i]) for i in range(3, 6)]
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array(*low, *high))


def overlaps(min_x: Column, max_x: Column, min_y: Column, max_y: Column, window: tuple[float, float, float, float]) -> Column:
    """Whether a box meets the window (min x, min y, max x, max y), edges included."""
    return (max_x >= window[0]) & (min_x <= window[2]) & (max_y >= window[1]) & (min_y <= window[3])


def grid_cell(value: Column, low: Column, width: Column, cells: int) -> Column:
    """Cell of a value on a grid of so many cells; 0 where the width isn't positive."""
    at = ((value - low) / width * (cells - 1)).cast("bigint")
    return F.when(width > 0, F.least(at, F.lit(cells - 1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def hilbert(gx: Column, gy: Column, order: int = 16) -> Column:
    """Place of a grid cell along the Hilbert curve of the given order; a higher-order function, so it stays in the JVM."""
    bits = F.array(*[F.lit(1 << i).cast("bigint") for i in range(order - 1, -1, -1)])
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def step(s: Column, p: Column) -> Column:
        rx = F.when(s["x"].bitwiseAND(p) > 0, one).otherwise(zero)
        ry = F.when(s["y"].bitwiseAND(p) > 0, one).otherwise(zero)
        turn, flip = ry == 0, (ry == 0) & (rx == 1)
        x = F.when(flip, p - 1 - s["x"]).otherwise(s["x"])
        y = F.when(flip, p - 1 - s["y"]).otherwise(s["y"])
        return F.struct((s["d"] + p * p * (rx * 3).bitwiseXOR(ry)).alias("d"), F.when(turn, y).otherwise(x).alias("x"), F.when(turn, x).otherwise(y).alias("y"))

    start = F.struct(zero.alias("d"), gx.cast("bigint").alias("x"), gy.cast("bigint").alias("y"))
    return F.aggregate(bits, start, step, lambda s: s["d"])


def lod_value(lod: Column) -> Column:
    """Number of a level of detail, for ordering only ("2" and "2.0" are different levels)."""
    return lod.try_cast("double")


def _checked(value: Column, allowed, what: str, extension: bool = False) -> Column:
    good = value.isNull() | value.isin(*allowed)
    if extension:
        good = good | value.startswith("+")
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)))


def parse_lod(lod: Column) -> Column:
    return _checked(lod, LODS, "level of detail")


def parse_object_type(kind: Column) -> Column:
    return _checked(kind, OBJECT_TYPES, "object type", extension=True)


def parse_semantic_type(kind: Column) -> Column:
    return _checked(kind, SEMANTIC_TYPES, "semantic type", extension=True)


def parse_version(version: Column) -> Column:
    """Accepted versions, all as 2.0."""
    return F.when(version.isin(*VERSIONS), F.lit("2.0")).otherwise(F.raise_error(F.concat(F.lit("unsupported version: "), F.coalesce(version, F.lit("none")))))


def decimal_faithful(value: Column) -> Column:
    """A float as the double with the same shortest decimal spelling."""
    return value.cast("float").cast("string").cast("double")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
