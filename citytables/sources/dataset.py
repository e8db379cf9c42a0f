"""Dataset folders: one Parquet table for each canonical table, and a manifest; Arrow streams for exchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from citytables.schema import REQUIRED, TABLES


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[name])


def conformed(name: str, df: DataFrame) -> DataFrame:
    """The table's columns in order; a missing or unknown column, or another type, is an error."""
    want = schema_of(name)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    kinds = {f.name: f.dataType.simpleString() for f in want}
    if have != kinds:
        raise ValueError(f"{name}: columns {sorted(set(have.items()) ^ set(kinds.items()))} differ")
    return df.select(*[f.name for f in want])


def validate_manifest(manifest: dict) -> None:
    """Known tables in canonical order, required ones present, relative paths that stay inside."""
    names = [t["name"] for t in manifest["tables"]]
    if unknown := [n for n in names if n not in TABLES]:
        raise ValueError(f"unknown tables: {unknown}")
    if names != [n for n in TABLES if n in names]:
        raise ValueError("tables are not in canonical order, or one comes twice")
    if missing := [n for n in REQUIRED if n not in names]:
        raise ValueError(f"required tables are absent: {missing}")
    for t in manifest["tables"]:
        if t["path"].startswith("/") or ".." in t["path"].split("/"):
            raise ValueError(f"path leaves the dataset: {t['path']}")


def write_dataset(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict:
    """Write all tables, then the manifest, which makes the dataset complete."""
    missing = [n for n in REQUIRED if n not in tables]
    if missing:
        raise ValueError(f"required tables are absent: {missing}")
    entries = []
    for name in TABLES:
        if name not in tables:
            continue
        conformed(name, tables[name]).write.mode("overwrite").parquet(f"{path}/tables/{name}")
        entries.append({"name": name, "path": f"tables/{name}", "rows": spark.read.parquet(f"{path}/tables/{name}").count()})
    manifest = {"version": 1, "tables": entries}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    validate_manifest(manifest)
    return manifest


def read_dataset(spark: SparkSession, path: str, check_rows: bool = True) -> dict[str, DataFrame]:
    """The tables by name, lazily; row counts come from Parquet footers."""
    out = {}
    for t in read_manifest(spark, path)["tables"]:
        df = conformed(t["name"], spark.read.parquet(f"{path}/{t['path']}"))
        if check_rows and df.count() != t["rows"]:
            raise ValueError(f"{t['name']} has other rows than the manifest says")
        out[t["name"]] = df
    return out


def to_arrow_file(df: DataFrame, path: str) -> None:
    """A table as a local Arrow stream, batch by batch through the driver; for exchange of small tables."""
    import pyarrow as pa

    with pa.OSFile(path, "wb") as sink:
        table = df.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)


def from_arrow_file(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    with pa.OSFile(path, "rb") as source:
        return spark.createDataFrame(pa.ipc.open_stream(source).read_all())
