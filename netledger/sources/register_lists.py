"""Register lists in fixed layout: rows of facilities with marks of services in columns that blanks leave empty.

Blank cells print nothing and columns drift from page to page, so marks can't be counted. The columns of a section
are a pattern of distances; every row fits it to its own marks. Of all places of the pattern the one counts at
which most marks lie within SLACK of a column, and of those the nearest; a mark serves one column. Rows are independent
of each other but for the section, which is carried along the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.text import address_start, mark_state
from netledger.sources.notices import _cut, _let

#: Columns of the area and the five services, from that of the first service, by section; how
#: far they stand before the status where marks don't fit; and where the texts of sections are printed.
PATTERNS = {"postal_office": (-4, 0, 6, 12, 17, 27), "company_office": (-4, 0, 6, 12, 18, 24)}
BEFORE_STATUS = {"postal_office": (-54, -50, -44, -38, -33, -23), "company_office": (-54, -50, -44, -38, -32, -26)}
HEADERS = {"postal_office": "[（(]郵便局[）)]", "company_office": "[（(]会社の営業所[）)]"}
#: Marks, what a name ends in, statuses, and lines that are no rows.
MARK = r"[○〇×\-‐‑‒–—−－―─]"
NAME_END = "(郵便局|分室|出張所)$"
STATUS = "(一時閉鎖|営業中)\\s*$"
SKIPPED = "通番|法第６条|別記様式|番号|中の別|^\\s*$|^\\s*(注|※|「関連銀行」)|当該郵便局又は当該営業所|関連銀行又は関連保険会社"
HEADINGS = "整理|名称|所在地|業務|営業中|一時閉鎖"
_WIDE = "０１２３４５６７８９" + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_PLAIN = "0123456789" + "abcdefghijklmnopqrstuvwxyz" * 2

#: Columns a mark may stand off, how far the pattern is moved beyond the marks, and the widest gap of marks that stand close together.
SLACK, SHIFT, CLOSE = 2, 8, 3


def _of(section: Column, values: dict[str, tuple[int, ...]]) -> Column:
    out = F.lit(None).cast("array<int>")
    for name, numbers in values.items():
        out = F.when(section == name, F.array(*map(F.lit, numbers))).otherwise(out)
    return out


def fitted(marks: Column, pattern: Column) -> Column:
    """(taken, at): how many marks (rising places) fit the pattern at its best place, and the mark of each column, -1
    where there is none. Null without marks."""
    none = F.array().cast("array<int>")

    def place(anchor: Column) -> Column:
        def column(held: Column, offset: Column) -> Column:
            far = lambda m: F.abs(m - anchor - offset)
            near = F.filter(marks, lambda m: (far(m) <= SLACK) & ~F.array_contains(held["at"], m))
            return _let(F.array_min(F.transform(near, lambda m: F.struct(far(m).alias("d"), m.alias("m")))), lambda best: F.struct(F.array_append(held["at"], F.coalesce(best["m"], F.lit(-1))).alias("at"), (held["d"] + F.coalesce(best["d"], F.lit(0))).alias("d")))

        found = F.aggregate(pattern, F.struct(none.alias("at"), F.lit(0).alias("d")), column)
        return _let(found, lambda f: F.struct(F.size(F.filter(f["at"], lambda x: x >= 0)).alias("taken"), (-f["d"]).alias("near"), (-anchor).alias("first"), f["at"].alias("at")))

    best = F.array_max(F.transform(F.sequence(F.array_min(marks) - SHIFT, F.array_max(marks) + SHIFT), place))
    return F.when(F.size(marks) > 0, best)


def list_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (file, page, line, section, serial, ident, ident_raw, name, simple, address, area, services, related, notes, status,
    confidence) of ``lines`` (file, page, line, text), and problems (file, page, line, code).

    A row is a serial number, an identifier of six digits and a letter or none, a name with the mark of simple offices, an
    address (from the name of a prefecture, or else the first wide gap), marks in columns, other texts (split at ``|``
    into related office and notes), and a status. If marks are left that fit no column, the row has low confidence: its
    marks are read at fixed distances before the status, or by order if they stand close together.

    Problems: outside_section, invalid_identifier, missing_status, missing_address, layout_untrusted, unknown_cell_value,
    name_column_boundary_suspect, duplicate_identifier, unparsed_line. Headers and notes are skipped, null lines too.
    """
    t = lines.select("file", "page", "line", F.coalesce("text", F.lit("")).alias("text"))
    header = F.when(F.col("text").rlike(HEADERS["postal_office"]), "postal_office").when(F.col("text").rlike(HEADERS["company_office"]), "company_office")
    along = Window.partitionBy("file").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("section", F.last(header, ignorenulls=True).over(along)).filter(~F.col("text").rlike(SKIPPED))
    row = r"^\s*([0-9]+)\s+(\S+)\s+(.*)$"
    part = lambda i: F.regexp_extract("text", row, i)
    t = t.withColumns({"is_row": F.col("text").rlike(row), "ident_raw": part(2), "ident": F.lower(F.translate(part(2), _WIDE, _PLAIN)), "body": part(3)})
    t = t.withColumn("until", F.regexp_instr("body", F.lit(STATUS)) - 1).withColumn("status", F.regexp_extract("body", STATUS, 1)).withColumn("head", F.rtrim(_cut(F.col("body"), 0, F.greatest("until", F.lit(0)))))
    gap = F.regexp_instr("head", F.lit(r"\s{2,}"))
    t = t.withColumn("start", F.coalesce(address_start(F.col("head")), F.when(gap > 0, gap - 1 + F.length(F.regexp_extract("head", r"\s{2,}", 0)))).cast("int"))
    fault = (
        F.when(F.col("section").isNull(), "outside_section").when(~F.col("is_row"), F.when(~F.col("text").rlike(HEADINGS) & header.isNull(), "unparsed_line").otherwise("none"))
        .when(~F.col("ident").rlike("^[0-9]{6}[a-z]?$"), "invalid_identifier").when(F.col("status") == "", "missing_status").when(F.col("start").isNull(), "missing_address")
    )
    t = t.withColumn("fault", F.when(F.col("section").isNull() & header.isNotNull(), "none").otherwise(fault))

    r = t.filter("fault IS NULL").withColumn("chars", F.filter(F.split("head", ""), lambda c: c != ""))
    marked = F.transform("chars", lambda c, i: F.when(c.rlike(MARK) & (i > F.col("start")) & F.get("chars", i - 1).rlike(r"\s"), i))
    r = r.withColumn("marks", F.array_compact(marked)).withColumn("fit", fitted(F.col("marks"), _of(F.col("section"), PATTERNS)))
    loose = F.coalesce(F.col("fit.taken") < F.size("marks"), F.lit(False))
    glyph = lambda at: F.coalesce(F.when(at >= 0, F.get("chars", at)), F.lit(""))
    targets = F.transform(_of(F.col("section"), BEFORE_STATUS), lambda x: x + F.col("until").cast("int"))
    cell = lambda at: F.coalesce(F.try_element_at(F.filter(F.transform(F.sequence(at - SLACK, at + SLACK), glyph), lambda c: c.rlike(MARK)), F.lit(1)), F.lit(""))
    r = r.withColumns({"loose": loose, "targets": targets, "by_fit": F.transform("fit.at", glyph)}).withColumn("by_status", F.transform("targets", cell))
    # marks that stand close together are told by their order
    rest = F.when(F.get("by_status", F.lit(0)) != "", F.slice("marks", 2, F.size("marks"))).otherwise(F.col("marks"))
    r = r.withColumn("rest", rest)
    gaps = F.transform(F.slice("rest", 2, F.size("rest")), lambda m, i: m - F.get("rest", i))
    slot = lambda m: F.bround((m - F.get("rest", F.lit(0))) / 2).cast("int")
    ordered = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: glyph(F.coalesce(F.try_element_at(F.filter("rest", lambda m: slot(m) == i), F.lit(-1)), F.lit(-1))))
    close = F.coalesce(F.array_max(gaps) <= CLOSE, F.lit(False))
    area = F.when(F.col("loose"), F.get("by_status", F.lit(0))).otherwise(F.coalesce(F.get("by_fit", F.lit(0)), F.lit("")))
    services = F.when(F.col("loose") & close, ordered).when(F.col("loose"), F.slice("by_status", 2, 5)).otherwise(F.coalesce(F.slice("by_fit", 2, 5), F.array_repeat(F.lit(""), 5)))
    end = F.coalesce(F.get("marks", F.lit(0)), F.get("targets", F.lit(1)) - 3)
    tail = F.coalesce(F.array_max("marks") + 1, F.get("targets", F.lit(5)) + 4)
    before = F.rtrim(_cut(F.col("head"), 0, F.col("start")))
    simple = before.rlike("[○〇]$")
    texts = F.trim(_cut(F.col("head"), tail))
    r = r.select(
        "file", "page", "line", "section", part(1).cast("long").alias("serial"), "ident", "ident_raw", F.when(simple, F.rtrim(_cut(before, 0, F.length(before) - 1))).otherwise(before).alias("name"), F.when(simple, "○").otherwise("").alias("simple"),
        F.rtrim(_cut(F.col("head"), F.col("start"), F.greatest(end, F.col("start")))).alias("address"), area.alias("area"), services.alias("services"), F.trim(F.split_part(texts, F.lit("|"), F.lit(1))).alias("related"),
        F.when(texts.contains("|"), F.trim(F.regexp_replace(texts, r"^[^|]*\|", ""))).otherwise("").alias("notes"), "status", F.when(F.col("loose"), "low").otherwise("high").alias("confidence"),
    )
    twice = Window.partitionBy("ident").orderBy("file", "page", "line")
    unknown = F.exists(F.concat(F.array("area"), "services"), lambda m: mark_state(m) == "unknown")
    found = F.array_compact(F.array(F.when(F.col("confidence") == "low", "layout_untrusted"), F.when(unknown, "unknown_cell_value"), F.when(~F.col("name").rlike(NAME_END), "name_column_boundary_suspect"), F.when(F.row_number().over(twice) > 1, "duplicate_identifier")))
    problems = t.filter("fault <> 'none'").select("file", "page", "line", F.col("fault").alias("code")).unionByName(r.select("file", "page", "line", found.alias("codes")).select("file", "page", "line", F.explode("codes").alias("code")))
    return r, problems
