"""Change notices with wrapped cells."""

from netledger.sources import notices
from pyspark.sql import functions as F


def row(side, section, ident, name, address, services="○ ○ ○ ○ ○", simple="○"):
    return f"{side} {section} {ident} {name} {simple} {address} - {services} -"


GONE = ("変更前", "営業所", "-", "-", "-", "- - - - -", "-")


def test_notices_of_several_shapes(spark, tmp_path):
    """One file per shape, read at once."""
    lines = {
        "plain": [
            row(*GONE), "R8.6.27 契約締結", row("変更後", "営業所", "010160a", "新簡易局", "東京都港区１－１", "○ ○ × ○ ○"),
            row("変更前", "営業所", "010160a", "旧簡易局", "東京都港区１－１"), "R8.7.1 契約解除", row("変更後", "-", "-", "-", "-", "- - - - -", "-"),
        ],
        "unknown": [row("変更前", "郵便局", "000010", "局", "東京都港区１－１", simple="-"), "R8.6.27 未知変更", row("変更後", "郵便局", "000010", "局", "東京都港区１－２", simple="-")],
        "bad": [row("変更前", "郵便局", "000010", "局", "東京都港区１"), "R8.13.27 移転・業務変更", row("変更後", "郵便局", "000010", "局", "東京都港区２")],
        # the address ends in a dash, or in its column; what follows is not part of it
        "wrapped": [
            "    " + row("変更前", "郵便局", "000010", "甲", "東京都港区４６６６－"), "                 ３５５０", "R8.6.27 移転", "    " + row("変更後", "郵便局", "000010", "甲", "東京都府中市４６６６－３５５"), "                      ０", "      footnote text", "別表",
        ],
        # a reason around the line of its date, left of the rows
        "reason": ["          " + row("変更前", "郵便局", "000010", "甲", "東京都港区１"), "過疎地区", "R8.6.27", "分の変更", "          " + row("変更後", "郵便局", "000010", "甲", "東京都港区１")],
        # the address of the row stands on the line before it; the marks of the next one on the line after it
        "banked": [row("変更前", "郵便局", "000010", "甲", "東京都港区１"), "R8.6.27 移転", "", "東京都港区２－", "３", "変更後 郵便局 000010 甲 ○ - ○ ○ ○ ○ ○"],
        "pending": ["変更前 郵便局 000010 甲 ○ 東京都港区１ - ○", " ○ ○", "○ ○ -", "R8.6.27 移転", row("変更後", "郵便局", "000010", "甲", "東京都港区２")],
        "loose": [row("変更後", "郵便局", "000010", "甲", "東京都港区１"), row("変更前", "郵便局", "000020", "乙", "東京都港区１"), row("変更後", "郵便局", "000020", "乙", "東京都港区２"), row("変更前", "郵便局", "000030", "丙", "東京都港区１"), "R8.6.27 移転", "変更前 支店 000040 丁 ○ 東京都港区１ - ○ ○ ○ ○ ○ -"],
        "empty": [""],
    }
    for name, texts in lines.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(texts))
    out = {}
    for r in notices.notice_events(notices.notice_lines(spark, str(tmp_path))).orderBy("file", "page", "line").collect():
        out.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append(r)
    first, second = out["plain"]
    assert (first.planned.isoformat(), first.kinds, first.before.ident, first.after.ident, first.after.name, first.after.address) == ("2026-06-27", ["contract_concluded"], "-", "010160a", "新簡易局", "東京都港区１－１")
    assert first.after.services == ["○", "○", "×", "○", "○"] and (first.after.simple, first.after.area, first.problems) == ("○", "-", [])
    assert (second.kinds, second.after.ident, second.after.services) == (["contract_terminated"], "-", ["-"] * 5)
    assert [r.problems for r in out["unknown"]] == [["unknown_reason"]] and out["unknown"][0].after.simple == "-"
    assert [(r.problems, r.kinds) for r in out["bad"]] == [(["invalid_change_date"], ["relocation", "service_change"])]
    (r,) = out["wrapped"]
    assert (r.before.address, r.after.address, r.problems) == ("東京都港区４６６６－３５５０", "東京都府中市４６６６－３５５０", [])
    (r,) = out["reason"]
    assert (r.reason, r.kinds, r.problems) == ("過疎地区分の変更", ["disadvantaged_area_change"], [])
    assert (out["banked"][0].after.address, out["banked"][0].problems) == ("東京都港区２－３", [])
    assert (out["pending"][0].before.address, out["pending"][0].before.services, out["pending"][0].problems) == ("東京都港区１", ["○"] * 5, [])
    assert [r.problems for r in out["loose"]] == [["after_without_before"], ["unmatched_pair_date_or_reason"], ["unpaired"], ["unpaired", "state_row_parse_error"]]
    assert "empty" not in out


def test_pages_number_lines_and_marks_are_read(spark, tmp_path):
    lines = ["head\f注 note", row("変更前", "郵便局", "000010", "甲", "東京都港区１", "○ × - ○ ○"), "R8.6.27 移転", row("変更後", "郵便局", "000010", "甲", "東京都港区２")]
    (tmp_path / "n.txt").write_text("\n".join(lines))
    out = notices.notice_events(notices.notice_lines(spark, str(tmp_path / "n.txt")))
    r = out.select("page", "line", notices.marks(F.col("before")).alias("m")).first()
    assert (r.page, r.line) == (2, 2) and tuple(r.m) == ("yes", "not_applicable", ["yes", "no", "not_applicable", "yes", "yes"])
