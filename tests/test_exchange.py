"""Records, typed fields, tables and header variables of exchange files."""

import pytest

from plumbline.sources import dxf


def drawing(sections: dict[str, list], version: str = "AC1027") -> str:
    out = ["0", "SECTION", "2", "HEADER", "9", "$ACADVER", "1", version, "9", "$INSUNITS", "70", "     4", "9", "$LTSCALE", "40", "2.5", "9", "$EXTMIN", "10", "1.0", "20", "2.0", "30", "3.0", "9", "$LIMMAX", "10", "420.0", "20", "297.0", "0", "ENDSEC"]
    for name, pairs in sections.items():
        out += ["0", "SECTION", "2", name, *[str(v) for p in pairs for v in p], "0", "ENDSEC"]
    return "\n".join([*out, "0", "EOF"]) + "\n"


def entity(kind, handle, *pairs, extra=()):
    return [(0, kind), (5, handle), (102, "{ACAD_REACTORS"), (330, "AAA"), (102, "}"), (330, "1F"), (100, "AcDbEntity"), *extra, (8, "Walls"), (100, "AcDbX"), *pairs, (330, "BBB")]


ENTITIES = [
    *entity("ELLIPSE", "10", (10, 100.0), (20, 100.0), (30, 0.0), (11, -50.0), (21, -50.0), (31, 0.0), (40, 0.4242640687119287), (41, 0.0), (42, 6.283185307179586), extra=[(62, 3), (420, 255)]),
    *entity("SPLINE", "11", (70, 5), (71, 3), (42, 1e-7), *[(40, k) for k in (0, 0, 1, 1)], (41, 1.0), (41, 2.0), (10, 1.0), (20, 2.0), (30, 3.0), (10, 4.0), (20, 5.0), (30, 6.0)),
    *entity("INSERT", "12", (2, "Door"), (10, 1.0), (20, 2.0), (41, 2.0), (50, 90.0)),
    *entity("INSERT", "13", (2, "Grid"), (10, 0.0), (20, 0.0), (70, 3), (71, 2), (44, 5.0), (45, 6.0)),
    *entity("DIMENSION", "14", (2, "*D1"), (10, 1.0), (20, 1.0), (70, 33), (1, "<>"), (42, 12.5), (13, 0.0), (23, 7.0)),
    *entity("MTEXT", "15", (10, 0.0), (20, 0.0), (40, 5.0), (3, "first "), (3, "second "), (1, "last")),
    *entity("LWPOLYLINE", "16", (90, 3), (70, 1), (10, 0.0), (20, 0.0), (42, 0.5), (10, 1.0), (20, 0.0), (40, 0.1), (41, 0.2), (10, 1.0), (20, 1.0)),
    *entity("3DFACE", "17", (10, 0.0), (20, 0.0), (30, 0.0), (11, 1.0), (21, 0.0), (31, 0.0), (12, 1.0), (22, 1.0), (32, 0.0), (13, 0.0), (23, 1.0), (33, 9.0), extra=[(67, 1)]),
    *entity("ATTRIB", "18", (10, 0.0), (20, 0.0), (40, 1.0), (1, "42"), (2, "ROOM"), (70, 0)),
    *entity("LEADER", "19", (3, "Standard"), (71, 1), (10, 0.0), (20, 0.0), (30, 0.0), (10, 3.0), (20, 4.0), (30, 0.0)),
    *entity("CIRCLE", "1A", (10, "none"), (20, ""), (40, "x")),
]
TABLES = [
    (0, "TABLE"), (2, "LAYER"), (5, "2"), (0, "LAYER"), (5, "20"), (2, "Walls"), (70, 0), (62, 7), (6, "Continuous"), (0, "LAYER"), (5, "21"), (2, "Off"), (70, 5), (62, -3), (0, "ENDTAB"),
    (0, "TABLE"), (2, "BLOCK_RECORD"), (5, "1"), (0, "BLOCK_RECORD"), (5, "1F"), (2, "*Model_Space"), (0, "BLOCK_RECORD"), (5, "2A"), (2, "Door"), (0, "ENDTAB"),
]
BLOCKS = [
    (0, "BLOCK"), (5, "30"), (2, "*Model_Space"), (0, "ENDBLK"), (5, "31"), (0, "BLOCK"), (5, "32"), (2, "Door"),
    (0, "LINE"), (5, "33"), (8, "0"), (10, 0.0), (20, 0.0), (11, 1.0), (21, 1.0), (0, "ENDBLK"), (5, "34"),
]


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("dxf")
    (at / "all.dxf").write_text(drawing({"TABLES": TABLES, "BLOCKS": BLOCKS, "ENTITIES": ENTITIES}))
    return dxf.pairs(spark, str(at)).cache()


def one(pair, kind):
    (row,) = dxf.fields(dxf.records(pair), kind).collect()
    return row


def test_records_have_owner_colours_and_space(pair):
    rows = {r.handle: r for r in dxf.records(pair).collect()}
    assert len(rows) == 11 and {r.owner for r in rows.values()} == {0x1F} and {r.layer for r in rows.values()} == {"Walls"}
    assert (rows[0x10].color_index, rows[0x10].true_color, rows[0x10].paper) == (3, 255, False)
    assert rows[0x17].paper and rows[0x11].color_index is None
    assert {(r.handle, r.owner) for r in dxf.entities(pair).collect()} == {(h, 0x1F) for h in rows}


def test_fields_of_curves(pair):
    e = one(pair, "ELLIPSE")
    assert tuple(e.center) == (100.0, 100.0, 0.0) and tuple(e.major_axis) == (-50.0, -50.0, 0.0) and e.ratio == 0.4242640687119287 and (e.start_angle, e.end_angle) == (0.0, 6.283185307179586)
    assert e.extrusion is None
    s = one(pair, "SPLINE")
    assert s.knots == [0, 0, 1, 1] and s.weights == [1, 2] and [tuple(p) for p in s.control_points] == [(1, 2, 3), (4, 5, 6)] and s.fit_points == []
    assert (s.degree, s.closed, s.periodic, s.rational, s.knot_tolerance) == (3, True, False, True, 1e-7)
    p = one(pair, "LWPOLYLINE")
    assert p.closed and [tuple(v) for v in p.points] == [(0, 0, 0, 0, 0.5), (1, 0, 0.1, 0.2, 0), (1, 1, 0, 0, 0)]
    assert [tuple(v) for v in one(pair, "LEADER").points] == [(0, 0, 0), (3, 4, 0)]
    c = one(pair, "CIRCLE")
    assert c.center is None and c.radius is None


def test_fields_of_references_and_texts(pair):
    i = one(pair, "INSERT")
    assert (i.name, i.sx, i.sy, i.sz, i.rotation, i.n_rows) == ("Door", 2.0, 1.0, 1.0, 90.0, 1)
    m = one(pair, "MINSERT")
    assert (m.name, m.dxftype, m.n_columns, m.n_rows, m.column_spacing, m.row_spacing) == ("Grid", "MINSERT", 3, 2, 5.0, 6.0)
    d = one(pair, "DIMENSION")
    assert (d.block, d.dimtype, d.measurement, d.text) == ("*D1", "ALIGNED", 12.5, "<>") and (d.p13.x, d.p13.y) == (0.0, 7.0) and d.p14 is None
    assert one(pair, "MTEXT").text == "first second last"
    a = one(pair, "ATTRIB")
    assert (a.tag, a.text) == ("ROOM", "42")
    assert tuple(one(pair, "3DFACE").p4) == (0.0, 1.0, 9.0)
    assert dxf.fields(dxf.records(pair), "HATCH").count() == 0


def test_every_type_has_a_schema(pair):
    record = dxf.records(pair)
    for kind in dxf.FIELDS:
        assert set(dxf.FIELDS[kind]) <= set(dxf.fields(record, kind).columns)


def test_tables_and_blocks(pair):
    rows = {r.name: r for r in dxf.layers(pair).collect()}
    assert set(rows) == {"Walls", "Off"} and (rows["Walls"].handle, rows["Walls"].color_index, rows["Walls"].off) == (0x20, 7, False)
    assert (rows["Off"].color_index, rows["Off"].off, rows["Off"].frozen, rows["Off"].locked) == (3, True, True, True)
    assert {(r.handle, r.name) for r in dxf.block_headers(pair).collect()} == {(0x1F, "*Model_Space"), (0x2A, "Door")}
    assert [(r.handle, r.block) for r in dxf.block_members(pair).orderBy("ord").collect()] == [(0x30, "*Model_Space"), (0x31, "*Model_Space"), (0x32, "Door"), (0x33, "Door"), (0x34, "Door")]


def test_header_variables(spark, pair, tmp_path):
    (row,) = dxf.header_variables(pair).collect()
    assert (row.version, row.insunits, row.ltscale, tuple(row.extmin), row.limmax.x, row.limmax.z, row.lunits, row.extmax) == ("AC1027", 4, 2.5, (1, 2, 3), 420.0, None, None, None)
    (tmp_path / "old.dxf").write_text(drawing({}, "AC1014"))
    (old,) = dxf.header_variables(dxf.pairs(spark, str(tmp_path))).collect()
    assert old.version == "AC1014" and old.insunits is None and old.extmin is None
