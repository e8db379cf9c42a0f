"""City-model views over the star-schema tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.session import table

_KINDS = (
    ("region", "Region", "R", "r_regionkey", None),
    ("nation", "Nation", "N", "n_nationkey", ("R", "n_regionkey")),
    ("customer", "Customer", "C", "c_custkey", ("N", "c_nationkey")),
    ("supplier", "Supplier", "S", "s_suppkey", ("N", "s_nationkey")),
    ("orders", "Order", "O", "o_orderkey", ("C", "o_custkey")),
)
RANK = 10_000_000_000
LOD = ("1", "1.0", "1.2", "2", "2.0", "2.2", "3")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cityobject_id, object_type, parent_id, ix (type by type, key by key)."""
    parts = []
    for i, (name, kind, letter, key, up) in enumerate(_KINDS):
        parent = F.concat(F.lit(up[0]), F.col(up[1]).cast("string")) if up else F.lit(None).cast("string")
        parts.append(table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("cityobject_id"), F.lit(kind).alias("object_type"), parent.alias("parent_id"), (F.lit(i * RANK) + F.col(key)).cast("bigint").alias("ix")))
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).where("parent_id is not null").select("parent_id", F.col("cityobject_id").alias("child_id"))


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each (order, line number): geometry_id, cityobject_id, geometry_ordinal, lod."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    lod = F.element_at(F.array(*[F.lit(x) for x in LOD]), F.col("l_linenumber").cast("int"))
    return lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("geometry_id"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("cityobject_id"), (F.col("l_linenumber") - 1).cast("int").alias("geometry_ordinal"), lod.alias("lod"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a vertex of its geometry."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("geometry_id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.abs("l_discount").alias("z"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue entries: id, feature_id (repeats), source path, length, and bounds from the order of the same key."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("F"), F.col("o_custkey").cast("string")).alias("feature_id"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("total"))


OBJ = "obj AS (" + " UNION ALL ".join(
    f"SELECT '{letter}' || CAST({key} AS VARCHAR) AS cityobject_id, '{kind}' AS object_type, {'NULL' if not up else repr(up[0]) + ' || CAST(' + up[1] + ' AS VARCHAR)'} AS parent_id, CAST({i * RANK} + {key} AS BIGINT) AS ix FROM {name}"
    for i, (name, kind, letter, key, up) in enumerate(_KINDS)
) + "), edge AS (SELECT parent_id, cityobject_id AS child_id FROM obj WHERE parent_id IS NOT NULL)"
GEO = (
    "geo AS (SELECT DISTINCT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS geometry_id, 'O' || CAST(l_orderkey AS VARCHAR) AS cityobject_id, CAST(l_linenumber - 1 AS INTEGER) AS geometry_ordinal, "
    + "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(LOD)) + " END AS lod FROM lineitem), "
    "vtx AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS geometry_id, l_quantity AS x, l_extendedprice AS y, abs(l_discount) AS z FROM lineitem)"
)
