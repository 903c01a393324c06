"""Polygon shapefiles, and archives of facilities with their cross-checks."""

import struct
import zipfile

from netledger.operators import spatial
from netledger.sources import files


def shapefile(kind, bodies):
    records = b"".join(struct.pack(">ii", i + 1, (4 + len(b)) // 2) + struct.pack("<i", k) + b for i, (k, b) in enumerate(bodies))
    return struct.pack(">i", 9994) + b"\0" * 20 + struct.pack(">i", (100 + len(records)) // 2) + struct.pack("<ii", 1000, kind) + b"\0" * 64 + records


def test_polygon_shapefiles(spark, tmp_path):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (1, 1)]
    points = outer + hole
    body = struct.pack("<4d", 0, 0, 4, 4) + struct.pack("<ii", 2, len(points)) + struct.pack("<ii", 0, len(outer)) + b"".join(struct.pack("<dd", *p) for p in points)
    (tmp_path / "a.shp").write_bytes(shapefile(5, [(5, body), (0, b"")]))
    got = files.shape_polygons(spark, str(tmp_path / "a.shp"))
    row = got.first()
    assert got.count() == 1 and [[(p.x, p.y) for p in r] for r in row.rings] == [outer[:-1], hole[:-1]]
    named = got.selectExpr("'a' AS polygon", "0 AS ord", "rings")
    inside = spatial.point_in_polygon(spark.createDataFrame([(1, 3.0, 3.0), (2, 1.2, 1.7), (3, 9.0, 9.0)], "pid int, x double, y double"), named)
    assert {r.pid for r in inside.collect()} == {1}


XML = """<ksj:Dataset xmlns:ksj="k" xmlns:gml="g" xmlns:xlink="l">%s%s</ksj:Dataset>"""


def archive(path, points, offices, shape=None, rows=None, crs="GEOGCS[JGD2000]"):
    p = "".join(f'<gml:Point gml:id="{i}"><gml:pos>{pos}</gml:pos></gml:Point>' for i, pos in points)
    cells = "".join(f"<ksj:{f}>v</ksj:{f}>" for f in files.OFFICE_FIELDS if f != "position")
    o = "".join(f'<ksj:PostOffice gml:id="{i}"><ksj:position xlink:href="#{at}"/>{cells if whole else ""}</ksj:PostOffice>' for i, at, whole in offices)
    at = [tuple(map(float, pos.split()))[::-1] for _, pos in points if pos != "bad"] if shape is None else shape
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("d/x.xml", XML % (p, o))
        z.writestr("d/x.shp", shapefile(1, [(1, struct.pack("<dd", *c)) for c in at]))
        z.writestr("d/x.dbf", b"\3\0\0\0" + struct.pack("<I", len(offices) if rows is None else rows) + b"\0" * 24)
        if crs:
            z.writestr("d/x.prj", crs)


def test_archives_are_checked_across_their_parts(spark, tmp_path):
    archive(tmp_path / "good.zip", [("a", "35 139"), ("b", "36 140")], [("1", "a", True), ("2", "b", True)])
    archive(tmp_path / "bad.zip", [("a", "35 139"), ("a", "35 139"), ("b", "bad"), ("c", "36 140")], [("1", "a", True), ("2", "b", True), ("3", "c", False), ("4", "c", True), ("4", "c", True)], [(139.0, 35.0), (139.0, 35.5)], 9, None)
    offices, problems = files.facility_archive(spark, str(tmp_path))
    assert {(r.file.rsplit("/", 1)[1], r.office, r.lat, r.lon) for r in offices.collect()} == {("good.zip", "1", 35.0, 139.0), ("good.zip", "2", 36.0, 140.0)}
    assert {(r.file.rsplit("/", 1)[1], r.id, r.problem) for r in problems.collect()} == {
        ("bad.zip", "prj", "member_missing"), ("bad.zip", "a", "duplicate_point"), ("bad.zip", "b", "invalid_point"), ("bad.zip", "4", "duplicate_office"), ("bad.zip", "3", "missing_required_field"), ("bad.zip", "1", "unresolved_point"),
        ("bad.zip", "2", "unresolved_point"), ("bad.zip", "a", "shp_xml_coordinate_mismatch"), ("bad.zip", None, "dbf_xml_count_mismatch"), ("bad.zip", None, "shp_xml_count_mismatch"),
    }
