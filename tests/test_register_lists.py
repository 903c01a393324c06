"""Register lists with blank cells and drifting columns."""

from netledger.functions.text import mark_state
from netledger.sources import register_lists
from pyspark.sql import functions as F


def row(serial, ident, name, address, simple="", area="", services=("○", "×", "-", "", "○"), related="", notes="", status="営業中"):
    """Marks close together, as no printed list has them."""
    tail = related + ("|" + notes if notes else "")
    return f"{serial:>4} {ident:<7} {name:<14}{simple:>2}  {address:<21}  {area:>1} {' '.join(services):<35}{tail:<20}{status}"


def read(spark, *pages):
    lines = [("f", p, i, text) for p, page in enumerate(pages, 1) for i, text in enumerate(page, 1)]
    rows, problems = register_lists.list_rows(spark.createDataFrame(lines, "file string, page int, line int, text string"))
    rows = rows.withColumn("kinds", F.transform("services", mark_state))
    return rows.orderBy("page", "line").collect(), [tuple(r)[1:] for r in problems.orderBy("page", "line", "code").collect()]


def test_rows_of_both_sections(spark):
    rows, problems = read(
        spark,
        ["別記様式第一号（郵便局）", "通番 整理番号 名称 所在地", row(1, "000010", "東京郵便局", "東京都千代田区１－１", "○", "○", related="関連銀行", notes="注記")],
        ["別記様式第一号（会社の営業所）", None, row(1, "０１０１６０Ａ", "会社郵便局", "東京都府中市２－２", services=("", "", "", "", ""), status="一時閉鎖")],
    )
    a, b = rows
    assert (a.page, a.line, a.section, a.serial, a.ident, a.name, a.simple, a.address, a.area, a.related, a.notes) == (1, 3, "postal_office", 1, "000010", "東京郵便局", "○", "東京都千代田区１－１", "○", "関連銀行", "注記")
    assert a.kinds == ["yes", "no", "not_applicable", "blank", "yes"]
    assert (b.page, b.section, b.ident, b.ident_raw, b.address, b.status, b.services, b.confidence) == (2, "company_office", "010160a", "０１０１６０Ａ", "東京都府中市２－２", "一時閉鎖", [""] * 5, "high")


def test_printed_layouts(spark):
    hospital = " 869 317810 石川県立中央病院内簡易郵便局    ○ 石川県金沢市鞍月東２－１                ○     ○     ×     ○     ○                         営業中"
    uneven = "908 010540 檜原郵便局            東京都西多摩郡檜原村４６７       ○   ○     ○     ○    ○         ○                      営業中"
    rows, problems = read(spark, ["（会社の営業所）", hospital], ["（郵便局）", uneven])
    assert (rows[0].name, rows[0].simple, rows[0].address) == ("石川県立中央病院内簡易郵便局", "○", "石川県金沢市鞍月東２－１")
    assert rows[1].kinds == ["yes"] * 5 and rows[1].area == "○" and rows[1].address == "東京都西多摩郡檜原村４６７" and rows[1].confidence == "high"


def test_lines_that_are_no_rows_are_named(spark):
    good = row(1, "000010", "甲郵便局", "東京都港区１", services=("",) * 5)
    rows, problems = read(spark, ["before any section", "（郵便局）", good, "予期しない継続行", "※ note", row(2, "12", "乙郵便局", "東京都港区１"), row(3, "000030", "丙郵便局", "東京都港区１", status="休業"), "4 000040 丁郵便局 町１ 営業中", good, row(5, "000050", "局", "東京都港区１", services=("",) * 5), ""])
    assert problems == [(1, 1, "outside_section"), (1, 4, "unparsed_line"), (1, 6, "invalid_identifier"), (1, 7, "missing_status"), (1, 8, "missing_address"), (1, 9, "duplicate_identifier"), (1, 10, "name_column_boundary_suspect")]
    assert [r.serial for r in rows] == [1, 1, 5]
    assert read(spark, [""]) == ([], [])
