"""The feature catalogue: lookups, pages, freshness and bounds.

sources: id, path, metadata; features: id (row id), feature_id (may repeat), source_id, and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_all(features: DataFrame, sources: DataFrame, feature_id: str) -> DataFrame:
    """All entries of an id with their sources; the filter reaches both scans."""
    return features.where(F.col("feature_id") == feature_id).join(sources.withColumnRenamed("id", "source_id"), "source_id").orderBy("id")


def lookup_first(features: DataFrame, sources: DataFrame, feature_id: str) -> DataFrame:
    """The entry of the smallest row id."""
    return lookup_all(features, sources, feature_id).limit(1)


def first_by_id(features: DataFrame) -> DataFrame:
    """For every id its entry of the smallest row id."""
    return features.groupBy("feature_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def lookup_ordered(features: DataFrame, row_ids: list[int]) -> DataFrame:
    """One row for each asked row id, in order, repeated ids and missing ones (null) included."""
    asked = features.sparkSession.createDataFrame(list(enumerate(row_ids)), "pos long, id long")
    return asked.join(features, "id", "left").orderBy("pos")


def keyset_page(features: DataFrame, after: int | None, limit: int) -> DataFrame:
    """The next rows after a row id."""
    if limit < 1:
        raise ValueError("a page needs one row at least")
    rows = features if after is None else features.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit)


def offset_page(features: DataFrame, offset: int, limit: int) -> DataFrame:
    if limit < 1:
        raise ValueError("a page needs one row at least")
    return features.orderBy("id").offset(offset).limit(limit)


def bbox_page(features: DataFrame, meets: Column, after: int | None, limit: int) -> tuple[DataFrame, bool]:
    """A page of what meets a window, and whether more follows."""
    rows = keyset_page(features.where(meets), after, limit + 1)
    return rows.limit(limit), rows.count() > limit


def page_numbers(features: DataFrame, size: int) -> DataFrame:
    """Every row with its page of a scan in id order.

    Ranks come from ranges: rows are sorted in partitions by id range, and only the partitions'
    counts are summed up, so no task sees all rows.
    """
    if size < 1:
        raise ValueError("a page needs one row at least")
    ranged = features.repartitionByRange("id").withColumn("__part", F.spark_partition_id())
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("id")) - 1
    return ranged.withColumn("__rank", rank).join(F.broadcast(starts), "__part").withColumn("page", F.floor((F.col("__start") + F.col("__rank")) / size).cast("bigint")).drop("__part", "__rank", "__start")


def bounds(features: DataFrame) -> DataFrame:
    """Count and outer bounds; nulls when empty. complete: every row has its z bounds."""
    low = [F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"]
    high = [F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"]
    return features.agg(F.count("*").alias("n"), *low, *high, (F.count_if(F.col("min_z").isNull() | F.col("max_z").isNull()) == 0).alias("complete"))


def counts(sources: DataFrame, features: DataFrame) -> DataFrame:
    f = features.agg(F.count("*").alias("n_features"), F.coalesce(F.sum("cityobject_count"), F.lit(0)).cast("bigint").alias("n_cityobjects"))
    return sources.agg(F.count("*").alias("n_sources")).crossJoin(f)  # one row each


def status(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """path and what is wrong: missing on disk, not indexed, or changed in size or time; rows that agree are left out."""
    i = indexed.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.lit(True).alias("__in"))
    j = current.withColumn("__on", F.lit(True)).join(i, "path", "full_outer")
    issue = (
        F.when(F.col("__on").isNull(), "missing").when(F.col("__in").isNull(), "unindexed")
        .when(~F.col("size").eqNullSafe(F.col("__size")) | ~F.col("mtime").eqNullSafe(F.col("__mtime")), "changed")
    )
    return j.select("path", issue.alias("issue")).where("issue is not null")


def nearest_metadata(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """For each path the metadata directory that is its longest prefix: a join on every ancestor, not on all pairs."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = features.select("path", F.explode(ancestors).alias("dir"))
    return rows.join(metadata.select("dir"), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def representative(features: DataFrame) -> DataFrame:
    """First, middle and last id in order."""
    from citytables.operators.merge import dense_ranks

    ranked = dense_ranks(features.select("feature_id").distinct(), ["feature_id"], "r")
    total = ranked.count()
    return ranked.where(F.col("r").isin(sorted({0, total // 2, max(0, total - 1)}))).select("feature_id")
