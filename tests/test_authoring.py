"""Models built by hand: flattening, checks, clean-up, coordinates."""

import pytest

from citytables.operators import authoring as a
from citytables.operators import validate
from citytables.sources import dataset

SQUARE = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]


def built():
    m = a.ModelBuilder("Town", identifier="m")
    m.add_object("b", "Building")
    m.add_object("p", "BuildingPart", parents=["b"])
    roof, wall = m.add_semantic("RoofSurface"), m.add_semantic("WallSurface")
    m.add_semantic("Door", parent=wall)
    unused = m.add_semantic("Window")
    red = m.add_material("red", shininess=0.5)
    g = a.multi_surface("2.2", [[SQUARE], [[0, 1, (5.0, 5.0, 5.0)]]])
    g.semantics, g.materials = [roof, wall], {"day": [red, None]}
    m.add_geometry("b", g)
    m.add_geometry("p", a.solid("1", [[[0, 1, 2]], [[1, 2, 3]]]))
    m.add_geometry("p", a.multi_line_string(None, [[0, 1], [2, 3, 0]]))
    t = m.add_template(a.multi_point("1", SQUARE))
    m.add_geometry("p", a.instance(t, (9.0, 9.0, 9.0)))
    return m, unused


def test_tables(spark, tmp_path):
    m, unused = built()
    tables = m.tables(spark)
    b = {r["geometry_id"]: r for r in tables["geometry_boundaries"].collect()}
    assert (b[0]["vertex_indices"], b[0]["ring_offsets"], b[0]["surface_offsets"]) == ([0, 1, 2, 3, 0, 1, 4], [0, 4], [0, 1])
    assert (b[1]["shell_offsets"], b[1]["surface_offsets"], b[2]["line_offsets"]) == ([0], [0, 1], [0, 2])
    assert validate.violations(tables["geometries"], tables["geometry_boundaries"], tables["vertices"]).isEmpty()
    dataset.write_dataset(spark, tables, f"{tmp_path}/m")
    assert dataset.read_dataset(spark, f"{tmp_path}/m")["materials"].count() == 1
    clean = a.cleanup(tables)
    assert unused not in {r["semantic_id"] for r in clean["semantics"].collect()} and clean["semantics"].count() == 3
    m.remove_object("p")
    assert a.cleanup(m.tables(spark))["geometries"].count() == 1
    shown = a.resolved_boundaries(tables)
    assert {r["geometry_id"]: r["of_template"] for r in shown.collect()} == {0: False, 1: False, 2: False, 3: True}
    assert a.boundary_coordinates(tables["geometry_boundaries"], tables["vertices"], unique=True).where("geometry_id = 0").count() == 5


@pytest.mark.parametrize("draft", [a.multi_surface("9", [[SQUARE]]), a.multi_surface("1", [[[]]]), a.multi_point("1", [77]), a.instance(5, (0, 0, 0)), a.Draft("Ball", None, [])])
def test_errors(draft):
    m, _ = built()
    with pytest.raises(ValueError):
        m.add_geometry("b", draft)


def test_object_errors(spark):
    m, _ = built()
    for call in (lambda: m.add_object("b", "Building"), lambda: m.add_object("x", "Castle"), lambda: m.add_geometry("zz", a.multi_point("1", SQUARE))):
        with pytest.raises(ValueError):
            call()
    m.add_object("q", "Road", parents=["nowhere"])
    with pytest.raises(ValueError):
        m.tables(spark)
    assert m.get_or_insert_semantic("RoofSurface") == 0 and m.get_or_insert_semantic("FloorSurface") == 4
