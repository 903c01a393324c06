"""Change notices in fixed layout: rows of states, dates with reasons, and cells that wrap over lines.

A notice is a table whose records are a row of 変更前, a line with a date and a reason, and a row of 変更後. Cells
are as wide as their column; what doesn't fit stands on lines of its own around the row, in the column's place. A
file is cut into stretches: a row, a date or a line of page furniture, and the plain lines after it. Windows over
the stretches of a file tell the record of each and hand plain lines that no row took to the next row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netledger.functions.text import CIRCLES, address_start, era_date, event_types, mark_state

#: Dashes that may end a wrapped address, and marks of a cell.
WRAPPED = "-‐‑‒–—−－"
MARKS = CIRCLES + "×✕✖" + WRAPPED
#: Sections as they are printed.
SECTIONS = {"郵便局": "postal_office", "営業所": "company_office", "-": "blank"}
#: Reasons as they are printed, the more specific before those that they contain.
REASONS = {
    "契約締結": "contract_concluded", "契約解除": "contract_terminated", "廃止": "abolished", "移転": "relocation", "住居表示変更": "address_change", "住所表示変更": "address_change", "改称": "renamed",
    "業務変更": "service_change", "局種変更": "office_type_change", "一時閉鎖": "temporarily_closed", "再開": "reopened", "新設": "established", "過疎地区分の変更": "disadvantaged_area_change",
    "過疎地区分変更": "disadvantaged_area_change", "過疎地変更": "disadvantaged_area_change", "過疎地該否の修正": "disadvantaged_area_correction",
}
#: Phrases of repeated headers and footnotes.
FURNITURE = (
    "６条第２項", "第６条第２項", "法第６条", "郵便局及び法", "変更年月日", "郵便局又は当該営業所", "当該郵便局又は当該営業所", "関連銀行又は関連保険会", "業所の別", "業所の", "社の営", "局・会", "(1)郵便", "整理", "簡易郵便局」の欄", "別紙",
)

DATE = r"([MTSHRmtshr]?\s*[0-9]{1,4}[.．年][0-9]{1,2}[.．月][0-9]{1,2}日?)"
#: The same for classes of regular expressions.
_DASH = r"\-" + WRAPPED[1:]
_MARK = rf"(?<=\s)[{MARKS.replace('-', '')}\-]"
#: Characters of a wrapped end of an address at most, and the columns that it may stand before the address.
TAIL, SLIP = 12, 2
#: Plain lines before a row that may belong to it.
BANKED = 3
SERVICES = 5


def notice_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, line, text) of texts whose pages end in form feeds, counted from 1."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    pages = texts.select("file", F.posexplode(F.split("value", "\f")).alias("page", "body"))
    return pages.select("file", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _cut(text: Column, start: Column | int, end: Column | None = None) -> Column:
    """The characters from ``start`` to before ``end``, counted from 0."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(text, start + 1, F.length(text) if end is None else end - start)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def state_row(text: Column) -> Column:
    """The state that a row of 変更前 or 変更後 gives; null if it isn't whole.

    Section and identifier come first; the address starts at the name of a prefecture, or else after the first wide gap;
    behind it stand the mark of the area and five of services. An identifier of ``-`` is no facility, and all its
    cells are ``-``.
    """
    group = lambda i: F.regexp_extract(text, r"(?s)^\s*(?:変更前|変更後)\s+(\S+)\s+(\S+)\s+(.*)$", i)
    section, ident, body = group(1), group(2), group(3)
    named = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])

    def parts(body: Column) -> Column:
        gap = F.regexp_instr(body, F.lit(r"\s{2,}"))
        start = F.coalesce(address_start(body), F.when(gap > 0, gap - 1 + F.length(F.regexp_extract(body, r"\s{2,}", 0))))
        head = F.rtrim(_cut(body, 0, start))
        marked = head.rlike(rf"[{CIRCLES}\-]$")
        rest = _cut(body, start)
        values = F.regexp_extract_all(rest, F.lit(_MARK), F.lit(0))
        address = F.rtrim(_cut(rest, 0, F.regexp_instr(rest, F.lit(_MARK)) - 1))
        address = F.regexp_replace(address, rf"([{_DASH}])\s+(?=[0-9０-９])", "$1")
        after = F.trim(F.regexp_extract(rest, rf"(?s)^(?:.*?{_MARK}){{{1 + SERVICES}}}(.*)$", 1))
        state = F.struct(
            F.try_element_at(named, section).alias("section"), ident.alias("ident"), F.when(marked, F.rtrim(_cut(head, 0, F.length(head) - 1))).otherwise(head).alias("name"), address.alias("address"),
            F.when(marked, F.substring(head, -1, 1)).otherwise("").alias("simple"), F.get(values, F.lit(0)).alias("area"), F.slice(values, 2, SERVICES).alias("services"), after.alias("rest"),
        )
        return F.when(start.isNotNull() & (F.size(values) > SERVICES), state)

    dash = F.lit("-")
    gone = F.struct(F.try_element_at(named, section).alias("section"), dash.alias("ident"), dash.alias("name"), dash.alias("address"), dash.alias("simple"), dash.alias("area"), F.array_repeat(dash, SERVICES).alias("services"), dash.alias("rest"))
    known = section.isin(*SECTIONS)
    return F.when(known & (ident == "-"), gone).when(known & ident.rlike("^[0-9]{6}[A-Za-z]?$"), _let(body, parts))


def _with_banked(row: Column, banked: Column) -> Column:
    """A row with plain lines that came before it put in: behind its first mark if it has no address, else before it."""
    first = F.regexp_instr(row, F.lit(_MARK))
    at = F.when(first == 0, F.length(row)).when(address_start(row).isNull(), first).otherwise(first - 1)
    return F.when(banked == "", row).otherwise(F.concat(_cut(row, 0, at), banked, _cut(row, at)))


def _continued(address: Column, lines: Column, column: Column, after: Column) -> Column:
    """(address, taken): an address with the plain lines that continue it, and how many of them do.

    A line continues an address that is blank or ends in a dash, and, behind a row of 変更後, also one in whose column
    it stands if it is short and holds only digits, dashes and wide characters. The first that doesn't ends it.
    """
    short = lambda line: after & column.isNotNull() & (F.length(F.trim(line)) <= TAIL) & (F.length(line) - F.length(F.ltrim(line)) >= column - SLIP) & F.trim(line).rlike(rf"^[0-9０-９{_DASH}\x{{2E81}}-\x{{10FFFF}}]+$")

    def step(held: Column, line: Column) -> Column:
        fits = held["open"] & ((held["address"] == "") | held["address"].rlike(rf"[{_DASH}]$") | short(line))
        return F.struct(F.when(fits, F.concat(held["address"], F.trim(line))).otherwise(held["address"]).alias("address"), (held["taken"] + F.when(fits, 1).otherwise(0)).alias("taken"), fits.alias("open"))

    return F.aggregate(lines, F.struct(address.alias("address"), F.lit(0).alias("taken"), F.lit(True).alias("open")), step)


def notice_events(lines: DataFrame) -> DataFrame:
    """(file, page, line, event_id, date_raw, planned, reason, kinds, before, after, problems), one row per record.

    ``lines`` (file, page, line, text). States are those of ``state_row``, with wrapped addresses joined. A row that is
    not whole takes plain lines before it, or else those after it. A reason that isn't on the line of the date is put
    together from what stands left of the rows' first column in the record. Problems are, in this order:
    after_without_before, unpaired (no 変更後), state_row_parse_error, unmatched_pair_date_or_reason,
    invalid_change_date, unknown_reason. Null and blank lines count as page furniture; no lines give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text)
    furniture = (bare == "") | bare.startswith("別") | bare.startswith("注")
    for phrase in FURNITURE:
        furniture = furniture | text.contains(phrase)
    side = F.regexp_extract(text, r"^\s*(変更前|変更後)\s", 1)
    kind = F.when(furniture, "none").when(text.rlike(DATE), "date").when(side == "変更前", "before").when(side == "変更後", "after").otherwise("plain")
    t = lines.select("file", "page", "line", text.alias("text"), kind.alias("kind"))
    along = Window.partitionBy("file").orderBy("page", "line")
    t = t.withColumn("stretch", F.sum(F.when(F.col("kind") != "plain", 1).otherwise(0)).over(along))
    plain = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "plain", F.struct("page", "line", "text")))), lambda x: x["text"])  # lines up to the next row or date
    head = F.min(F.when(F.col("kind") != "plain", F.struct("page", "line", "kind", "text")))
    s = t.groupBy("file", "stretch").agg(head.alias("h"), plain.alias("plain")).select("file", "stretch", "h.*", "plain")

    order = Window.partitionBy("file").orderBy("stretch")
    row = F.col("kind").isin("before", "after")
    # rows that are whole take what continues their address; the rest is banked for the row that follows
    own = F.when(row, state_row(F.col("text")))
    s = s.withColumn("own", own).withColumn("column", address_start(F.col("text")))
    s = s.withColumn("grown", F.when(F.col("own").isNotNull() & (F.col("own.ident") != "-"), _continued(F.col("own.address"), F.col("plain"), F.col("column"), F.col("kind") == "after")))
    left = F.when(row & F.col("own").isNull(), F.slice("plain", 1, 0)).otherwise(F.slice("plain", F.coalesce("grown.taken", F.lit(0)) + 1, F.size("plain")))
    banked = F.lag(left).over(order)
    banked = F.slice(banked, F.greatest(F.size(banked) - BANKED + 1, F.lit(1)), BANKED)
    s = s.withColumn("banked", F.coalesce(F.array_join(F.transform(banked, lambda x: F.trim(x)), ""), F.lit("")))
    # of a row without an address the banked lines are the address; another row takes them if it isn't whole without
    s = s.withColumn("filled", _with_banked(F.col("text"), F.col("banked")))
    first = F.when((F.col("banked") != "") & F.col("column").isNull(), F.col("filled")).otherwise(F.col("text"))
    s = s.withColumn("whole", F.when(row, F.coalesce(state_row(first), state_row(F.col("filled")))))
    third = F.when(row & F.col("whole").isNull(), state_row(F.concat_ws(" ", F.array(F.col("filled")), F.transform("plain", lambda x: F.trim(x)))))
    grows = F.col("whole").isNotNull() & (F.col("whole.ident") != "-")
    s = s.withColumn("later", F.when(grows, _continued(F.col("whole.address"), F.col("plain"), F.coalesce("column", address_start(F.col("filled"))), F.col("kind") == "after")))
    state = F.coalesce(F.when(F.col("later").isNotNull(), F.col("whole").withField("address", F.col("later.address"))), "whole", third)

    s = s.withColumn("state", state).withColumn("record", F.sum(F.when(F.col("kind") == "before", 1).otherwise(0)).over(order))
    place = F.regexp_instr("text", F.lit("変更前|変更後")) - 1
    s = s.withColumn("edge", F.last(F.when(row, place), ignorenulls=True).over(order))
    fragments = F.filter(F.transform("plain", lambda x: F.trim(_cut(x, 0, F.col("edge")))), lambda x: (x != "") & ~x.rlike(DATE))
    s = s.withColumn("fragments", F.when(F.col("edge") > 0, fragments))
    said = F.trim(F.regexp_extract("text", rf"(?s){DATE}(.*)$", 2))
    dated = F.when(F.col("kind") == "date", F.struct("stretch", F.trim(F.regexp_extract("text", DATE, 1)).alias("raw"), said.alias("reason")))
    rows = lambda k: F.min(F.when(F.col("kind") == k, F.struct("stretch", "page", "line", "state")))
    r = s.groupBy("file", "record").agg(
        rows("before").alias("b"), rows("after").alias("a"), F.max(dated).alias("d"), F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("stretch", "fragments"))), lambda x: F.coalesce(x["fragments"], F.array().cast("array<string>")))), "").alias("pieces"))
    r = r.filter("b IS NOT NULL OR a IS NOT NULL")
    reason = F.when(F.regexp_replace("d.reason", rf"[\s{_DASH}]", "") != "", F.col("d.reason")).otherwise(F.col("pieces"))
    r = r.select("file", F.coalesce("b.page", "a.page").alias("page"), F.coalesce("b.line", "a.line").alias("line"), F.col("d.raw").alias("date_raw"), F.when(F.col("d").isNotNull(), reason).alias("reason"), "b", "a")
    planned = era_date(F.translate("date_raw", "．", "."))
    named = F.when(F.col("b.state.ident") != "-", F.col("b.state.ident")).otherwise(F.col("a.state.ident"))
    problems = F.array_compact(F.array(
        F.when(F.col("b").isNull(), "after_without_before"), F.when(F.col("b").isNotNull() & F.col("a").isNull(), "unpaired"),
        F.when((F.col("b").isNotNull() & F.col("b.state").isNull()) | (F.col("a").isNotNull() & F.col("a.state").isNull()), "state_row_parse_error"),
        F.when(F.col("b").isNotNull() & F.col("a").isNotNull() & F.col("date_raw").isNull(), "unmatched_pair_date_or_reason"), F.when(F.col("date_raw").isNotNull() & planned.isNull(), "invalid_change_date"),
        F.when(F.col("date_raw").isNotNull() & (F.size(event_types(F.col("reason"), REASONS)) == 0), "unknown_reason"),
    ))
    basis = F.concat_ws("|", "file", "page", "line", "date_raw", "reason", named)
    return r.select(
        "file", "page", "line", F.sha2(basis, 256).alias("event_id"), "date_raw", planned.alias("planned"), "reason", event_types(F.col("reason"), REASONS).alias("kinds"),
        F.col("b.state").alias("before"), F.col("a.state").alias("after"), problems.alias("problems"),
    )


def marks(state: Column) -> Column:
    """What the marks of a state mean: simple, area, and the services in order."""
    return F.struct(mark_state(state["simple"]).alias("simple"), mark_state(state["area"]).alias("area"), F.transform(state["services"], mark_state).alias("services"))
