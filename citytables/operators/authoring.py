"""Authoring: models built row by row on the driver, then handed over as tables.

For the sizes that people write by hand; generated or imported models never pass through here.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.schema import GEOMETRY_TYPES, LODS, OBJECT_TYPES
from citytables.sources.dataset import schema_of

Point = tuple[float, float, float]
_MOST = 2**32 - 1


@dataclass
class Draft:
    """A geometry before it is in a model: its type, level, and nested points (new ones, or numbers of vertices)."""

    geometry_type: str
    lod: str | None
    nested: list
    semantics: list[int | None] | None = None
    materials: dict[str, list[int | None]] = field(default_factory=dict)
    template: int | None = None
    matrix: list[float] | None = None


def multi_point(lod: str | None, points: Iterable) -> Draft:
    return Draft("MultiPoint", lod, list(points))


def multi_line_string(lod: str | None, lines: Iterable[Sequence]) -> Draft:
    return Draft("MultiLineString", lod, [list(x) for x in lines])


def multi_surface(lod: str | None, surfaces: Iterable[Sequence[Sequence]]) -> Draft:
    """Each surface is its outer ring and then its holes."""
    return Draft("MultiSurface", lod, [list(s) for s in surfaces])


def composite_surface(lod: str | None, surfaces: Iterable[Sequence[Sequence]]) -> Draft:
    return Draft("CompositeSurface", lod, [list(s) for s in surfaces])


def solid(lod: str | None, outer: Sequence, inners: Iterable[Sequence] = ()) -> Draft:
    return Draft("Solid", lod, [list(outer), *map(list, inners)])


def multi_solid(lod: str | None, solids: Iterable[Sequence]) -> Draft:
    return Draft("MultiSolid", lod, [list(s) for s in solids])


def composite_solid(lod: str | None, solids: Iterable[Sequence]) -> Draft:
    return Draft("CompositeSolid", lod, [list(s) for s in solids])


def instance(template: int, reference_point, matrix: list[float] | None = None) -> Draft:
    return Draft("GeometryInstance", None, [reference_point], template=template, matrix=matrix)


def _levels(nested: list, depth: int) -> list[list]:
    """Innermost items, then the starts of each level from the innermost out; an empty part is an error."""
    starts = []
    for _ in range(depth - 1):
        at, own, inner = 0, [], []
        for part in nested:
            if not len(part):
                raise ValueError("a part of the geometry is empty")
            own.append(at)
            at += len(part)
            inner += list(part)
        starts.append(own)
        nested = inner
    return [nested, *reversed(starts)]


class ModelBuilder:
    """Rows of a model in the making; tables() hands them over."""

    def __init__(self, kind: str, identifier: str | None = None):
        self.rows: dict[str, list[tuple]] = {n: [] for n in ("extensions", "vertices", "template_vertices", "texture_vertices", "semantics", "materials", "textures", "template_geometries", "template_geometry_boundaries", "geometries", "geometry_boundaries", "geometry_instances", "geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics", "geometry_surface_materials")}
        self.objects: dict[str, list] = {}
        self.edges: list[tuple[str, str]] = []
        self.meta = {"citymodel_kind": kind, "identifier": identifier, "format_version": "2.0", "default_material_theme": None, "default_texture_theme": None}
        self.n_geometries = 0
        self.next_place = 0
        self.places: dict[str, int] = {}  # of objects in the order in which they came
        self.attached: dict[str, int] = {}

    def _add(self, table: str, *values) -> int:
        n = len(self.rows[table])
        if n > _MOST:
            raise OverflowError(f"{table} is full")
        self.rows[table].append((n, *values))
        return n

    def add_vertex(self, point: Point) -> int:
        return self._add("vertices", *map(float, point))

    def add_vertices(self, points: Iterable[Point]) -> range:
        first = len(self.rows["vertices"])
        for p in points:
            self.add_vertex(p)
        return range(first, len(self.rows["vertices"]))

    def add_template_vertex(self, point: Point) -> int:
        return self._add("template_vertices", *map(float, point))

    def add_uv(self, u: float, v: float) -> int:
        return self._add("texture_vertices", float(u), float(v))

    def add_semantic(self, kind: str, parent: int | None = None, attributes: str | None = None) -> int:
        return self._add("semantics", kind, parent, attributes)

    def get_or_insert_semantic(self, kind: str, parent: int | None = None, attributes: str | None = None) -> int:
        """An equal semantic that is there, else a new one."""
        same = [r[0] for r in self.rows["semantics"] if r[1:] == (kind, parent, attributes)]
        return same[0] if same else self.add_semantic(kind, parent, attributes)

    def add_material(self, name: str, **payload) -> int:
        names = [f.name for f in schema_of("materials")][2:]
        if unknown := set(payload) - set(names):
            raise ValueError(f"unknown members of a material: {sorted(unknown)}")
        return self._add("materials", name, *[payload.get(n) for n in names])

    def add_texture(self, uri: str, image_type: str, wrap_mode: str | None = None, texture_type: str | None = None, border_color: list[float] | None = None) -> int:
        return self._add("textures", uri, image_type, wrap_mode, texture_type, border_color)

    def add_object(self, object_id: str, kind: str, attributes: str | None = None, parents: Iterable[str] = ()) -> None:
        if object_id in self.objects:
            raise ValueError(f"duplicate object: {object_id}")
        if kind not in OBJECT_TYPES and not kind.startswith("+"):
            raise ValueError(f"unknown object type: {kind}")
        self.objects[object_id] = [kind, attributes]
        self.places[object_id] = self.next_place
        self.next_place += 1
        self.edges += [(p, object_id) for p in parents]

    def remove_object(self, object_id: str) -> None:
        """The object goes with its links; its geometries stay in the pool until clean-up."""
        del self.objects[object_id], self.places[object_id]
        self.attached.pop(object_id, None)
        self.edges = [e for e in self.edges if object_id not in e]

    def clear_objects(self) -> None:
        self.objects.clear()
        self.places.clear()
        self.attached.clear()
        self.edges.clear()

    def set_default_themes(self, material: str | None = None, texture: str | None = None) -> None:
        self.meta |= {"default_material_theme": material, "default_texture_theme": texture}

    def _numbers(self, points: list, template: bool) -> list[int]:
        add, pool = (self.add_template_vertex, "template_vertices") if template else (self.add_vertex, "vertices")
        out = []
        for p in points:
            if isinstance(p, int):
                if not 0 <= p < len(self.rows[pool]):
                    raise ValueError(f"vertex {p} doesn't exist")
                out.append(p)
            else:
                out.append(add(p))
        return out

    def _checked(self, draft: Draft) -> int:
        depth = GEOMETRY_TYPES.get(draft.geometry_type)
        if depth is None:
            raise ValueError(f"unknown geometry type: {draft.geometry_type}")
        if draft.lod is not None and draft.lod not in LODS:
            raise ValueError(f"unknown level of detail: {draft.lod}")
        return depth

    def _offsets(self, levels: list[list], depth: int) -> tuple:
        line = levels[1] if depth == 2 else None
        rest = (levels[1:] if depth > 2 else []) + [None] * 4
        return line, rest[0], rest[1], rest[2], rest[3]

    def add_geometry(self, object_id: str, draft: Draft) -> int:
        """Checked, flattened, and attached to its object."""
        depth = self._checked(draft)
        if object_id not in self.objects:
            raise ValueError(f"unknown object: {object_id}")
        ix, ordinal = self.places[object_id], self.attached.get(object_id, 0)
        number = self.n_geometries
        if draft.geometry_type == "GeometryInstance":
            if not 0 <= draft.template < len(self.rows["template_geometries"]):
                raise ValueError(f"template {draft.template} doesn't exist")
            if draft.matrix is not None and len(draft.matrix) != 16:
                raise ValueError("a matrix has 16 numbers")
            point = self._numbers(draft.nested, False)[0]
            self.rows["geometry_instances"].append((number, ix, ordinal, draft.lod, draft.template, point, draft.matrix, None))
            return self._attached(object_id)
        levels = _levels(draft.nested, depth)
        primitives = len(levels[0]) if depth == 1 else len(levels[1]) if depth == 2 else len(levels[2])
        for name, values in [("semantics", draft.semantics), *draft.materials.items()]:
            if values is not None and len(values) != primitives:
                raise ValueError(f"{name}: {len(values)} values for {primitives} primitives")
        vertices = self._numbers(levels[0], False)
        self.rows["geometries"].append((number, ix, ordinal, draft.geometry_type, draft.lod, None))
        self.rows["geometry_boundaries"].append((number, vertices, *self._offsets(levels, depth)))
        if draft.semantics is not None:
            table = {1: "geometry_point_semantics", 2: "geometry_linestring_semantics"}.get(depth, "geometry_surface_semantics")
            self.rows[table] += [(number, i, s) for i, s in enumerate(draft.semantics)]
        for theme, values in draft.materials.items():
            if depth < 3:
                raise ValueError("only surfaces have materials")
            self.rows["geometry_surface_materials"] += [(number, i, theme, m) for i, m in enumerate(values) if m is not None]
        return self._attached(object_id)

    def _attached(self, object_id: str) -> int:
        """Count a geometry that was added, and give its number."""
        self.attached[object_id] = self.attached.get(object_id, 0) + 1
        self.n_geometries += 1
        return self.n_geometries - 1

    def add_template(self, draft: Draft) -> int:
        depth = self._checked(draft)
        if not depth:
            raise ValueError("an instance can't be a template")
        levels = _levels(draft.nested, depth)
        number = self._add("template_geometries", draft.geometry_type, draft.lod, None)
        self.rows["template_geometry_boundaries"].append((number, self._numbers(levels[0], True), *self._offsets(levels, depth)))
        return number

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All tables; a link to an object that isn't there is an error."""
        ix = self.places
        for edge in self.edges:
            if missing := [e for e in edge if e not in ix]:
                raise ValueError(f"unknown object: {missing[0]}")
        out = {n: spark.createDataFrame(rows, schema_of(n)) for n, rows in self.rows.items()}
        out["cityobjects"] = spark.createDataFrame([(o, ix[o], kind, None, attributes, None) for o, (kind, attributes) in self.objects.items()], schema_of("cityobjects"))
        seen: dict[str, int] = {}
        children = []
        for p, c in self.edges:
            children.append((ix[p], seen.setdefault(p, 0), ix[c]))
            seen[p] += 1
        out["cityobject_children"] = spark.createDataFrame(children, schema_of("cityobject_children"))
        fields = [f.name for f in schema_of("metadata")]
        meta = self.meta | {"citymodel_id": self.meta["identifier"] or "citymodel"}
        out["metadata"] = spark.createDataFrame([tuple(meta.get(f) for f in fields)], schema_of("metadata"))
        return out


def cleanup(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Without geometries that no object has, what hangs on them, and semantics that nothing is assigned to (nor a relative of one)."""
    out = dict(tables)
    objects = tables["cityobjects"].select("cityobject_ix")
    for t in ("geometries", "geometry_instances"):
        if t in out:
            out[t] = out[t].join(objects, "cityobject_ix", "left_semi")
    kept = out["geometries"].select("geometry_id")
    for t in list(out):
        if t.startswith("geometry_") and t != "geometry_instances":
            out[t] = out[t].join(kept, "geometry_id", "left_semi").select(tables[t].columns)
    if "semantics" in out:
        from citytables.operators.selection import closure

        used = None
        for t in ("geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics", "template_geometry_semantics"):
            if t in out:
                own = out[t].where("semantic_id is not null").select(F.col("semantic_id").cast("string").alias("cityobject_id"))
                used = own if used is None else used.unionByName(own)
        if used is not None:
            links = out["semantics"].where("parent_semantic_id is not null").select(F.col("parent_semantic_id").cast("string").alias("parent_id"), F.col("semantic_id").cast("string").alias("child_id"))
            reached = closure(links, used, children=True, parents=True).select(F.col("cityobject_id").cast("bigint").alias("semantic_id"))
            out["semantics"] = out["semantics"].join(reached, "semantic_id", "left_semi").select(tables["semantics"].columns)
    return {n: df.select(tables[n].columns) for n, df in out.items()}


def resolved_boundaries(tables: dict[str, DataFrame]) -> DataFrame:
    """geometry_id, vertex_indices and whether they are template vertices: own boundaries, or an instance's template's."""
    own = tables["geometry_boundaries"].select("geometry_id", "vertex_indices", F.lit(False).alias("of_template"))
    if "geometry_instances" not in tables or "template_geometry_boundaries" not in tables:
        return own
    t = tables["geometry_instances"].join(tables["template_geometry_boundaries"], "template_geometry_id")
    return own.unionByName(t.select("geometry_id", "vertex_indices", F.lit(True).alias("of_template")))


def boundary_coordinates(boundaries: DataFrame, vertices: DataFrame, unique: bool = False) -> DataFrame:
    """geometry_id, pos, x, y, z of the vertices in order of occurrence, or of the distinct ones; unknown vertices are passed over."""
    rows = boundaries.select("geometry_id", F.posexplode(F.array_sort(F.array_distinct("vertex_indices")) if unique else F.col("vertex_indices")).alias("pos", "v"))
    return rows.join(vertices, F.col("v") == F.col("vertex_id")).select("geometry_id", "pos", "x", "y", "z")


def interned(values: DataFrame, value: str, order: str) -> DataFrame:
    """Dictionary of the distinct values with dense numbers by first appearance."""
    from citytables.operators.merge import get_or_insert

    return get_or_insert(values, [value], order)[0].withColumnRenamed("resource_id", "symbol_id")
