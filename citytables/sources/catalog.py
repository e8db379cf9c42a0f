"""The feature catalogue of a folder: built by one scan, stored as two tables.

A folder holds sequences (*.jsonl, each with its header first), or documents (*.json; every root object with its tree is
a feature), or feature files (*.jsonl without headers, below folders with a metadata.json; the nearest one counts).

sources: id, path, metadata (the header line), size, mtime. features: id, feature_id (one row for
each object key of a package), source_id, path, value (the package), cityobject_count, and the
box over the vertices that the package refers to (all of them if it refers to none).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citytables.functions.spatial import dequantize, overlaps
from citytables.operators import index
from citytables.session import materialised
from citytables.sources import model
from citytables.sources.document import is_document, is_feature, overlaid

BOUNDS = [f"{m}_{a}" for m in ("min", "max") for a in "xyz"]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    m = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return lines.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("mtime"), F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")


def referenced(objects: Column) -> Column:
    """Numbers of the vertices in the boundaries of all objects (a map of JSON texts), whatever their nesting."""
    texts = F.transform(F.map_values(objects), lambda o: F.coalesce(F.get_json_object(o, "$.geometry[*].boundaries"), F.lit("")))
    return F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(texts, " "), F.lit(r"\d+"), F.lit(0)), lambda s: s.cast("int")))


def _member(points: str, i: int) -> Column:
    return F.transform(points, lambda p: F.try_element_at(p, F.lit(i + 1)))


def scan_sources(lines: DataFrame) -> DataFrame:
    """One row a file; a file whose first document line is no header has null metadata."""
    header = F.min_by("value", F.when(is_document(F.col("value")), F.col("line")))
    files = lines.groupBy("path").agg(header.alias("metadata"), F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    return files.select(F.xxhash64("path").alias("id"), "path", "metadata", "size", "mtime")


def scan_features(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each object key, with the package's box in world coordinates.

    Ids count the object keys of a part of the scan in order, from part * 2^40 on; a package may have any number.
    """
    rows = lines.where(is_feature(F.col("value"))).select("path", "line", "value")
    rows = rows.join(sources.select("path", F.col("id").alias("source_id"), F.from_json(F.get_json_object("metadata", "$.transform"), "scale array<double>, translate array<double>").alias("t")), "path")
    rows = rows.withColumn("objects", F.from_json(F.get_json_object("value", "$.CityObjects"), "map<string,string>"))
    rows = rows.withColumn("v", F.from_json(F.get_json_object("value", "$.vertices"), "array<array<double>>"))
    rows = rows.withColumn("used", referenced(F.col("objects")))
    shown = F.when(F.size("used") > 0, F.transform("used", lambda i: F.try_element_at("v", i + 1))).otherwise(F.col("v"))
    rows = rows.withColumn("w", shown)
    columns = []
    for name, f in (("min", F.array_min), ("max", F.array_max)):
        for i, a in enumerate("xyz"):
            scale, move = F.coalesce(F.col("t.scale")[i], F.lit(1.0)), F.coalesce(F.col("t.translate")[i], F.lit(0.0))
            columns.append(dequantize(f(_member("w", i)), scale, move).alias(f"{name}_{a}"))
    part = F.shiftright("line", 33)  # monotonically_increasing_id holds it there
    ahead = Window.partitionBy(part).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    first = F.shiftleft(part, 40) + F.coalesce(F.sum(F.coalesce(F.size(F.map_keys("objects")), F.lit(0)).cast("bigint")).over(ahead), F.lit(0))
    rows = rows.where("objects is not null").withColumn("first", first)
    keyed = rows.select("path", "first", "source_id", "value", F.size("objects").cast("bigint").alias("cityobject_count"), *columns, F.posexplode(F.array_sort(F.map_keys("objects"))).alias("__k", "feature_id"))
    return keyed.select((F.col("first") + F.col("__k")).alias("id"), "feature_id", "source_id", "path", "value", "cityobject_count", *BOUNDS)


METADATA = "metadata.json"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and mtime of all files below a folder that aren't empty; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).where("size > 0")


def layout_of(spark: SparkSession, path: str) -> str:
    """sequences, documents or features; none, or more than one, is an error. Runs at once."""
    name = F.element_at(F.split("path", "/"), -1)
    n = files(spark, path).agg(
        F.count_if(name == METADATA).alias("metadata"), F.count_if(name.endswith(".jsonl")).alias("lines"), F.count_if(name.endswith(".json") & (name != METADATA)).alias("documents")
    ).first()
    fits = [k for k, v in (("features", n["metadata"] and n["lines"]), ("sequences", n["lines"] and not n["metadata"]), ("documents", n["documents"])) if v]
    if len(fits) != 1:
        raise ValueError(f"{path} has {'no known layout' if not fits else 'several layouts: ' + ', '.join(fits)}")
    return fits[0]


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    m = F.col("_metadata")
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return texts.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("mtime"), "value")


def _scan_documents(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Sources, and lines of features as a sequence would have them."""
    docs = _whole(spark, path, "*.json").where(is_document(F.col("value")))
    bare = F.map_concat(F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, _: ~k.isin("CityObjects", "vertices", "transform")), F.from_json(F.lit('{"CityObjects":{},"vertices":[]}'), "map<string,variant>"))
    sources = docs.select(F.xxhash64("path").alias("id"), "path", F.to_json(bare).alias("metadata"), "size", "mtime")
    tables = model.read_models(docs.select(F.col("path").alias("doc_key"), "value"))
    split = model.split_features(tables, kind)
    origin = split["metadata"].select("doc_key", F.col("feature_root_id").alias("root"))
    texts = model.write_models(split).join(origin, "doc_key")
    of_file = F.expr("substring(doc_key, 1, length(doc_key) - length(root) - 1)")
    return sources, materialised(texts.select(of_file.alias("path"), F.monotonically_increasing_id().alias("line"), "value"))


def _scan_feature_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sources: the metadata files; lines: the features, each with the path of its metadata file. A feature without one is an error."""
    meta = _whole(spark, path, METADATA)
    sources = meta.select(F.xxhash64("path").alias("id"), "path", F.col("value").alias("metadata"), "size", "mtime")
    lines = _scan(spark, path).withColumnRenamed("path", "file")
    dirs = sources.select(F.expr(f"substring(path, 1, length(path) - {len(METADATA) + 1})").alias("dir"))
    near = index.nearest_metadata(lines.select(F.col("file").alias("path")).distinct(), dirs).select(F.col("path").alias("file"), "dir")
    led = lines.join(near, "file", "left")
    source = F.coalesce(F.concat("dir", F.lit(f"/{METADATA}")), F.raise_error(F.concat(F.lit("no metadata above "), F.col("file"))))
    return sources, materialised(led.select(source.alias("path"), "line", "value"))


def build(spark: SparkSession, path: str, to: str, layout: str | None = None, kind: str = "Feature") -> None:
    """Scan the folder and write the catalogue, replacing an older one.

    kind: that of the features which are made of documents; it ends in Feature.
    """
    layout = layout or layout_of(spark, path)
    if layout == "sequences":
        lines = _scan(spark, path)
        found = scan_sources(lines)
    else:
        found, lines = _scan_documents(spark, path, kind) if layout == "documents" else _scan_feature_files(spark, path)
    found.write.mode("overwrite").parquet(f"{to}/sources")
    sources = spark.read.parquet(f"{to}/sources")
    if sources.isEmpty():
        raise ValueError(f"no sources below {path}")
    scan_features(lines, sources).write.mode("overwrite").parquet(f"{to}/features")


@dataclass
class Catalog:
    """An opened catalogue; every method is a lazy query unless it says otherwise."""

    spark: SparkSession
    path: str

    @property
    def sources(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sources")

    @property
    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/features")

    def lookup(self, feature_id: str) -> DataFrame:
        return index.lookup_all(self.features, self.sources.select("id", "metadata"), feature_id)

    def get(self, feature_id: str) -> str | None:
        """The package (JSON text, its header's members included) of the id's first row; None without one. Runs at once."""
        row = self.lookup(feature_id).limit(1).select(overlaid(F.col("metadata"), F.col("value")).alias("package")).first()
        return row["package"] if row else None

    def with_metadata(self, rows: DataFrame) -> DataFrame:
        """Rows of features with their source's header (metadata) and the package as one text, the header's members included."""
        m = self.sources.select(F.col("id").alias("source_id"), "metadata")
        return rows.join(m, "source_id").withColumn("package", overlaid(F.col("metadata"), F.col("value")))

    def models(self, rows: DataFrame) -> dict[str, DataFrame]:
        """The canonical tables of features, each package once, with its row id as doc_key."""
        one = rows.groupBy("source_id", "value").agg(F.min("id").alias("doc_key"))
        return model.read_models(self.with_metadata(one).select("doc_key", F.col("package").alias("value")))

    def query(self, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
        meets = overlaps(F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"), (min_x, min_y, max_x, max_y))
        return self.features.where(meets)

    def page(self, after: int | None, limit: int) -> DataFrame:
        return index.keyset_page(self.features, after, limit)

    def rows(self, ids: list[int]) -> DataFrame:
        return index.lookup_ordered(self.features, ids)

    def bounds(self) -> DataFrame:
        return index.bounds(self.features)

    def counts(self) -> DataFrame:
        return index.counts(self.sources, self.features)

    def metadata(self) -> DataFrame:
        return self.sources.select("id", "metadata")

    def inspect(self, dataset: str, layout: str = "sequences") -> DataFrame:
        """Source files that are missing, not indexed, or changed since; no row means fresh and covered."""
        name = F.element_at(F.split("path", "/"), -1)
        wanted = {"sequences": name.endswith(".jsonl"), "documents": name.endswith(".json") & (name != METADATA), "features": name == METADATA}[layout]
        current = files(self.spark, dataset).where(wanted).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "size", "mtime")
        return index.status(current, self.sources.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "size", "mtime"))

    def validate(self, dataset: str) -> bool:
        """Whether nothing is wrong. Runs at once."""
        return self.inspect(dataset).isEmpty()
