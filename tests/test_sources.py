import struct
import zipfile

import pytest

from netledger.sources import bundle, files, html


def test_jsonl_skips_blank_lines_and_rejects_other_values(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r.a for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "a int").orderBy("a").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a":1}\n[1]\n')
    with pytest.raises(Exception, match="not an object"):
        files.jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    (tmp_path / "c.jsonl").write_text('{"a":"many"}\n')
    with pytest.raises(Exception):
        files.jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()


def test_event_bundles_report_what_they_exclude(spark, tmp_path):
    for day, n in (("2024-01-01", 2), ("2024-02-01", 1)):
        (tmp_path / day).mkdir()
        (tmp_path / day / "events.jsonl").write_text('{"e":1}\n' * n)
    rows, out = files.event_bundles(spark, str(tmp_path), "e int", ["2024-02-01"])
    assert rows.count() == 2 and [tuple(r) for r in out.collect()] == [("2024-02-01", 1)]


def test_zipped_csv_reads_cp932_by_column_code(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("x.txt", "KEY,T1,T2\n,男,女\n1,5,東\n2,-,京\n".encode("cp932"))
    out = files.zipped_csv(spark, str(tmp_path / "t.zip"), ["KEY", "T2"], skip=1).orderBy("line").collect()
    assert [(r.KEY, r.T2) for r in out] == [("1", "東"), ("2", "京")]


def test_archive_problems_names_unsafe_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../up.txt", "x")
        z.writestr("zeros", "0" * 1_000_000)
    assert {(r.member, r.problem) for r in files.archive_problems(spark, str(tmp_path / "t.zip")).collect()} == {("../up.txt", "unsafe_path"), ("zeros", "expansion")}


def test_shape_points(spark, tmp_path):
    body = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", 1, 139 + i, 35.5) for i in range(3))
    head = struct.pack(">i", 9994) + b"\0" * 20 + struct.pack(">i", (100 + len(body)) // 2) + b"\0" * 72
    (tmp_path / "p.shp").write_bytes(head + body)
    assert [(r.ord, r.x) for r in files.shape_points(spark, str(tmp_path / "p.shp")).orderBy("ord").collect()] == [(0, 139.0), (1, 140.0), (2, 141.0)]


def test_notice_changes_pair_lines(spark, tmp_path):
    (tmp_path / "n.txt").write_text("変更前 000001 甲\nH24.10.19 移転\n変更後 000001 乙\n変更前 000002 丙\nno date\n")
    out = files.notice_changes(spark, str(tmp_path / "n.txt")).orderBy("line").collect()
    assert (str(out[0].day), out[0].reason, out[0].before, out[0].after, out[0].problem) == ("2012-10-19", "移転", "000001 甲", "000001 乙", None)
    assert out[1].problem == "unpaired"


def test_register_rows_carry_their_section(spark, tmp_path):
    (tmp_path / "r.txt").write_text("【東京】\n 1 000001 中央 東京都 営業中\nnoise\n\f 2 000002A 西 東京都 一時閉鎖\n【大阪】\n 1 100000 北 大阪府 営業中\n")
    out = files.register_rows(spark, str(tmp_path / "r.txt")).orderBy("page", "line").collect()
    assert [(r.section, r.serial, r.official_identifier, r.status) for r in out] == [("東京", 1, "000001", "営業中"), ("東京", 2, "000002a", "一時閉鎖"), ("大阪", 1, "100000", "営業中")]


def test_html_tables_match_exactly_one_header(spark):
    page = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x <b>y</b></td></tr><tr><td>2</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, page + page)], "id int, html string")
    out = {(r.id, r.row, tuple(r.cells or ()), r.problem) for r in html.table_rows(df, "id", "html", ["a", "b"]).collect()}
    assert out == {(1, 0, ("1", "x y"), None), (1, 1, ("2",), "row_width"), (2, None, (), "no_table"), (3, None, (), "several_tables")}


def test_bundle_verifies_and_finds_changes(spark, tmp_path):
    path = str(tmp_path / "b")
    bundle.seal(spark.range(10), path, "numbers")
    assert bundle.verify(spark, path).count() == 0
    assert bundle.open_sealed(spark, path, "numbers").count() == 10
    with pytest.raises(ValueError):
        bundle.open_sealed(spark, path, "letters")
    spark.range(3).write.mode("append").parquet(f"{path}/data")
    assert {r.problem for r in bundle.verify(spark, path).collect()} == {"extra"}


def test_bundle_names_the_code_that_made_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    bundle.seal(spark.range(3), path, "numbers")
    assert bundle.open_sealed(spark, path, "numbers", strict_code=True).count() == 3
    assert spark.read.parquet(f"{path}/_manifest").first()["code"] == bundle.code_hash()
    monkeypatch.setattr(bundle, "code_hash", lambda: "other")
    assert bundle.open_sealed(spark, path, "numbers").count() == 3
    with pytest.raises(ValueError, match="other code"):
        bundle.open_sealed(spark, path, "numbers", strict_code=True)


def test_sealing_raises_when_files_change_meanwhile(spark, tmp_path, monkeypatch):
    hashes, n = bundle._hashes, []

    def meddled(s, path):
        n.append(1)
        if len(n) == 2:
            s.range(2).write.mode("append").parquet(f"{path}/data")
        return hashes(s, path)

    monkeypatch.setattr(bundle, "_hashes", meddled)
    with pytest.raises(ValueError, match="extra"):
        bundle.seal(spark.range(3), str(tmp_path / "b"), "numbers")


def test_qa_summary_counts_malformed_lines_as_errors(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text('{"kind":"error"}\n{"kind":"info"}\nnot json\n')
    assert tuple(bundle.qa_summary(spark, str(tmp_path / "qa.jsonl")).first()) == (2, 1)


def test_canonical_lines_and_fixed_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.5)], "b int, a string, c double")
    bundle.canonical_jsonl(df, str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":null,"b":1,"c":2.5}']
    bundle.fixed_csv(df, str(tmp_path / "c"), {"c": 3})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["c"] == "2.500"


def test_dbf_rows_check_their_fields(spark, tmp_path):
    fields = [("ID", "C", 3), ("NAME", "C", 8)]
    head = struct.pack("<BBBBIHH", 3, 24, 1, 1, 3, 32 + 32 * 2 + 1, 12) + b"\0" * 20
    head += b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, t, w in fields) + b"\r"
    body = b" 001" + "東京".encode("cp932").ljust(8) + b"*002" + b"gone".ljust(8) + b" 003" + b"x".ljust(8)
    (tmp_path / "t.dbf").write_bytes(head + body + b"\x1a")
    assert [(r.ID, r.NAME) for r in files.dbf_rows(spark, str(tmp_path / "t.dbf"), fields).orderBy("ord").collect()] == [("001", "東京"), ("003", "x")]
    with pytest.raises(Exception, match="fields are"):
        files.dbf_rows(spark, str(tmp_path / "t.dbf"), [("ID", "C", 3)]).collect()


def test_offices_meet_their_points(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        '<root><pt id="a"><pos>35.0 139.0</pos></pt><pt id="b"><pos>36.0 140.0</pos></pt><pt id="b"><pos>1.0 2.0</pos></pt>'
        '<office id="1"><name>x</name><position>#a</position></office><office id="2"><name>y</name><position>#b</position></office></root>'
    )
    good, bad = files.referenced_points(spark, str(tmp_path / "p.xml"), "pt", "office")
    assert [tuple(r) for r in good.collect()] == [("1", "x", 35.0, 139.0)]
    assert {tuple(r) for r in bad.collect()} == {("b", "duplicate_point"), ("2", "no_point")}
