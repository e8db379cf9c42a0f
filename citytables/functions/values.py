"""Checked vocabularies, colours and box measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citytables.schema import CONTACT_ROLES, CONTACT_TYPES, IMAGE_TYPES, SEMANTIC_TYPES, TEXTURE_TYPES, WRAP_MODES


def one_of(value: Column, allowed: tuple[str, ...], what: str, extensions: bool = False) -> Column:
    """The value if it is allowed (or null, or with extensions begins with +); else an error while reading."""
    good = value.isNull() | value.isin(*allowed)
    if extensions:
        good = good | value.startswith("+")
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)))


def parse_wrap_mode(value: Column) -> Column:
    return one_of(value, WRAP_MODES, "wrap mode")


def parse_texture_type(value: Column) -> Column:
    return one_of(value, TEXTURE_TYPES, "texture type")


def parse_image_type(value: Column) -> Column:
    return one_of(value, IMAGE_TYPES, "image type")


def parse_contact_role(value: Column) -> Column:
    return one_of(value, CONTACT_ROLES, "role of a contact")


def parse_contact_type(value: Column) -> Column:
    return one_of(value, CONTACT_TYPES, "type of a contact")


def parse_semantic_type(value: Column) -> Column:
    """A known type, or one of an extension."""
    return one_of(F.coalesce(value, F.lit("null")), SEMANTIC_TYPES, "semantic type", extensions=True)


def rgb(color: Column) -> Column:
    """Three components of 0 .. 1 as one struct; any other number of them is an error."""
    bad = F.raise_error(F.lit("a colour has three components"))
    return F.when(color.isNull(), F.lit(None)).when(F.size(color) == 3, F.struct(color[0].alias("r"), color[1].alias("g"), color[2].alias("b"))).otherwise(bad)


def rgba(color: Column) -> Column:
    """Four components; without the last it is 1."""
    last = F.when(F.size(color) == 4, F.element_at(color, 4)).otherwise(F.lit(1.0))
    bad = F.raise_error(F.lit("a colour has three or four components"))
    return F.when(color.isNull(), F.lit(None)).when(F.size(color).isin(3, 4), F.struct(color[0].alias("r"), color[1].alias("g"), color[2].alias("b"), last.alias("a"))).otherwise(bad)


def box_size(box: Column) -> Column:
    """Width, length and height of a box of six numbers."""
    return F.struct((box[3] - box[0]).alias("width"), (box[4] - box[1]).alias("length"), (box[5] - box[2]).alias("height"))


def box_center(box: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.element_at(box, i + 1) + F.element_at(box, i + 4)) * 0.5)


def line_spans(text: Column) -> Column:
    """The lines of a text with the byte at which each starts; line ends (also two-byte ones) are left out, blank lines too."""
    lines = F.split(text, "\n")
    with_start = F.aggregate(
        lines,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,line:string>>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).cast("bigint").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.rtrim(x, F.lit("\r")).alias("line")))).alias("out")),
    )["out"]
    return F.filter(with_start, lambda s: F.trim(s["line"]) != "")
