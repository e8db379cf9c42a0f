"""Heterogeneous attributes: typed extraction, keys, and inference by a type lattice with a JSON fallback."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_type(json_text: Column, key: str) -> Column:
    """Kind of a member of a JSON object: null, bool, unsigned, integer, float, string, list, map; null when missing."""
    shown = F.schema_of_variant(F.variant_get(F.parse_json(json_text), f"$.{key}", "variant"))
    value = F.get_json_object(json_text, f"$.{key}")
    return (
        F.when(shown == "BIGINT", F.when(value.startswith("-"), "integer").otherwise("unsigned"))
        .when(shown == "VOID", "null").when(shown == "BOOLEAN", "bool").when(shown.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float")
        .when(shown == "STRING", "string").when(shown.startswith("ARRAY"), "list").when(shown.startswith("OBJECT"), "map")
    )


def extract_column(df: DataFrame, id_col: str, json_col: str, key: str, kind: str) -> DataFrame:
    """id and value of the rows whose member is of exactly this kind (float, integer, unsigned, string); others are left out."""
    to = {"float": "double", "integer": "bigint", "unsigned": "bigint", "string": "string"}[kind]
    rows = df.where(F.col(json_col).isNotNull() & (attribute_type(F.col(json_col), key) == kind))
    return rows.select(id_col, F.get_json_object(json_col, f"$.{key}").cast(to).alias("value"))


def attribute_keys(df: DataFrame, json_col: str) -> DataFrame:
    """Distinct keys over all rows."""
    return df.select(F.explode(F.json_object_keys(json_col)).alias("key")).distinct()


def project_i64(value: Column) -> Column:
    """Whole numbers as bigint; larger ones saturate."""
    return F.least(value.cast("decimal(20,0)"), F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint")


def drop_nulls(json_text: Column) -> Column:
    """A JSON object without its null members, as after a columnar round trip."""
    return F.to_json(F.map_filter(F.from_json(json_text, "map<string,variant>"), lambda _, v: v.isNotNull() & ~F.is_variant_null(v)))


@dataclass
class Spec:
    """An inferred type: kind, nullability, members of a map, items of a list."""

    kind: str = "null"
    nullable: bool = False
    fields: dict[str, Spec] = field(default_factory=dict)
    item: Spec | None = None

    def ddl(self) -> str:
        simple = {"null": "string", "bool": "boolean", "unsigned": "bigint", "integer": "bigint", "float": "double", "string": "string", "json": "string"}
        if self.kind == "map":
            return "struct<" + ",".join(f"`{k}`:{self.fields[k].ddl()}" for k in sorted(self.fields)) + ">"
        if self.kind == "list":
            return f"array<{self.item.ddl()}>"
        return simple[self.kind]

    def to_dict(self) -> dict:
        return {"k": self.kind, "n": self.nullable, "f": {k: v.to_dict() for k, v in self.fields.items()}, "i": self.item.to_dict() if self.item else None}

    @classmethod
    def from_dict(cls, d: dict) -> Spec:
        return cls(d["k"], d["n"], {k: cls.from_dict(v) for k, v in d["f"].items()}, cls.from_dict(d["i"]) if d["i"] else None)


def spec_of(value) -> Spec:
    if value is None:
        return Spec("null", True)
    if isinstance(value, bool):
        return Spec("bool")
    if isinstance(value, int):
        return Spec("unsigned" if value >= 0 else "integer")
    if isinstance(value, float):
        return Spec("float")
    if isinstance(value, str):
        return Spec("string")
    if isinstance(value, list):
        item = Spec()
        for v in value:
            item = join(item, spec_of(v))
        return Spec("list", item=item)
    return Spec("map", fields={k: spec_of(v) for k, v in value.items()})


_NUMBERS = ("unsigned", "integer", "float")


def join(a: Spec, b: Spec) -> Spec:
    """Least type that holds both; unlike kinds fall back to JSON and stay there."""
    nullable = a.nullable or b.nullable
    if a.kind == "null" or b.kind == "null":
        other = b if a.kind == "null" else a
        return Spec(other.kind, nullable, other.fields, other.item)
    if a.kind in _NUMBERS and b.kind in _NUMBERS:
        return Spec(max(a.kind, b.kind, key=_NUMBERS.index), nullable)
    if a.kind != b.kind or a.kind == "json":
        return Spec("json", nullable)
    if a.kind == "list":
        return Spec("list", nullable, item=join(a.item, b.item))
    if a.kind == "map":
        return Spec("map", nullable, fields={k: join_field(a.fields.get(k), b.fields.get(k)) for k in {**a.fields, **b.fields}})
    return Spec(a.kind, nullable)


def join_field(a: Spec | None, b: Spec | None) -> Spec:
    """As join; a member that one side lacks may be null."""
    if a is None or b is None:
        one = a or b
        return Spec(one.kind, True, one.fields, one.item)
    return join(a, b)


def infer(df: DataFrame, json_col: str) -> Spec | None:
    """The type of all rows' attribute maps; None without rows or keys.

    Each task folds its rows into one type, and those are folded in a tree; what moves has the
    size of a type, not of the rows.
    """

    def fold(batches):
        import pyarrow as pa

        out = None
        for b in batches:
            for text in b.column(0).to_pylist():
                if text is not None:
                    own = spec_of(json.loads(text))
                    out = own if out is None else join(out, own)
        if out is not None:
            yield pa.record_batch([pa.array([json.dumps(out.to_dict())])], names=["spec"])

    def merge(batches):
        import pyarrow as pa

        out = None
        for b in batches:
            for text in b.column(0).to_pylist():
                own = Spec.from_dict(json.loads(text))
                out = own if out is None else join(out, own)
        if out is not None:
            yield pa.record_batch([pa.array([json.dumps(out.to_dict())])], names=["spec"])

    parts = df.select(json_col).mapInArrow(fold, "spec string").coalesce(64).mapInArrow(merge, "spec string").collect()
    out = None
    for r in parts:
        own = Spec.from_dict(json.loads(r["spec"]))
        out = own if out is None else join(out, own)
    return out if out is not None and out.fields else None


def project(df: DataFrame, json_col: str, spec: Spec, to: str = "attributes") -> DataFrame:
    """The attributes as a struct of the inferred type; JSON members stay text."""
    return df.withColumn(to, F.from_json(json_col, spec.ddl()))
