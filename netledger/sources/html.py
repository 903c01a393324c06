"""Pages: links, tables, URL and robots policies, and safety findings."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, Window, functions as F


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, text, n): distinct links with the text of the first, in document order, and counts."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    each = pages.select(key, F.posexplode(found).alias("pos", "tag"))
    href = F.regexp_extract("tag", r'(?is)href\s*=\s*"([^"]*)"', 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("tag", r"(?is)^<a[^>]*>(.*)</a>$", 1), "<[^>]*>", ""), r"\s+", " "))
    return each.select(key, href.alias("href"), F.struct("pos", text.alias("text")).alias("t")).groupBy(key, "href").agg(F.min("t")["text"].alias("text"), F.count(F.lit(1)).alias("n"))


#: A comment, a script or style with what it holds, or a tag; quoted attribute values may hold ``>``.
_IN_TAG = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
TAG = rf"(?is)<!--.*?-->|<(script|style)\b{_IN_TAG}>.*?(?:</\1\s*>|\z)|</?[a-z]{_IN_TAG}>"
_ATTRIBUTE = r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?"""


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def unescaped(text: Column) -> Column:
    """``text`` with character references resolved: numbers, and all names of the standard that end in ``;``."""
    names = F.create_map(*[F.lit(x) for name, value in html5.items() if name.endswith(";") for x in (name, value)])

    def one(piece: Column) -> Column:
        number = F.when(piece.rlike("^&#[xX]"), F.conv(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]{1,8})", 1), 16, 10)).otherwise(F.regexp_extract(piece, "^&#([0-9]{1,10})", 1)).cast("long")
        return F.when(piece.rlike("^&#"), _character(number)).when(piece.rlike("^&.+;$"), F.coalesce(F.try_element_at(names, F.substring(piece, 2, 64)), piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#[0-9]{1,10};?|&#[xX][0-9a-fA-F]{1,8};?|&[a-zA-Z][a-zA-Z0-9]{1,40};|[^&]++|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def css_decoded(css: Column) -> Column:
    """CSS in lower case without escapes, comments and blanks."""
    joined = F.regexp_replace(css, r"\\(?:\r\n|[\n\r\f])", "")

    def one(piece: Column) -> Column:
        code = F.conv(F.regexp_extract(piece, r"^\\([0-9a-fA-F]{1,6})", 1), 16, 10).cast("long")
        return F.when(piece.rlike(r"^\\[0-9a-fA-F]"), _character(code)).when(piece.rlike(r"(?s)^\\."), F.substring(piece, 2, 2)).otherwise(piece)

    pieces = F.regexp_extract_all(joined, F.lit(r"(?s)\\[0-9a-fA-F]{1,6}[ \t\r\n\f]?|\\.|[^\\]++|\\"), F.lit(0))
    plain = F.when(joined.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(joined)
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"(?s)/\*.*?\*/", ""), r"\s+", ""))


def _name(token: Column) -> Column:
    """``table`` of an opening tag, ``/table`` of a closing one, empty for anything else."""
    return F.lower(F.regexp_extract(token, r"^<(/?[a-zA-Z][^\s/>]*)", 1))


def _attributes(tag: Column) -> Column:
    """Array of (name, value) of a tag, with names in lower case and values decoded."""
    inside = F.regexp_extract(tag, rf"(?s)^<[a-zA-Z][^\s/>]*({_IN_TAG})>", 1)
    names, values = (F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2))
    bare = lambda v: F.when(v.rlike("""(?s)^".*"$|^'.*'$"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("name"), unescaped(bare(v)).alias("value")))


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells): rows of all tables of each page. ``table`` is the place of its opening tag among the
    page's tags and texts, ``row`` counts from 0, and ``cells`` are structs (text, href of the last link).

    Pages become a stream of tags and texts. Running sums give the depth in tables, so that what stands in an inner table
    belongs to that alone; within a table running counts give rows and cells. Cells may lack their closing tags.
    Scripts, styles and comments are left out, and character references resolved.
    """
    tokens = F.regexp_extract_all(F.col(html), F.lit(TAG + r"|[^<]++|<"), F.lit(0))
    t = pages.select(key, F.posexplode(tokens).alias("pos", "token")).withColumn("name", _name(F.col("token")))
    t = t.filter(~F.col("name").isin("script", "style") & ~F.col("token").startswith("<!--"))
    page = Window.partitionBy(key).orderBy("pos")
    t = t.withColumn("sum", F.sum(F.when(F.col("name") == "table", 1).when(F.col("name") == "/table", -1).otherwise(0)).over(page))
    t = t.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(page))).filter("depth > 0")
    opened = F.last(F.when(F.col("name") == "table", F.col("pos")), ignorenulls=True)
    t = t.withColumn("table", opened.over(Window.partitionBy(key, "depth").orderBy("pos")))
    inside = Window.partitionBy(key, "table").orderBy("pos")
    t = t.withColumn("row", F.sum(F.when(F.col("name") == "tr", 1).otherwise(0)).over(inside) - 1).filter("row >= 0")
    mark = F.when(F.col("name").isin("td", "th"), F.col("pos")).when(F.col("name").isin("tr", "/tr", "/td", "/th"), -1)
    t = t.withColumn("cell", F.last(mark, ignorenulls=True).over(inside))
    href = F.when(F.col("name") == "a", F.element_at(F.transform(F.filter(_attributes(F.col("token")), lambda a: a["name"] == "href"), lambda a: a["value"]), 1))
    pieces = F.sort_array(F.collect_list(F.when(F.col("name") == "", F.struct("pos", "token"))))  # of one cell
    text = F.trim(F.regexp_replace(unescaped(F.array_join(F.transform(pieces, lambda p: p["token"]), "")), r"\s+", " "))
    cells = t.groupBy(key, "table", "row", "cell").agg(text.alias("text"), F.max(F.when(href.isNotNull(), F.struct("pos", href.alias("href"))))["href"].alias("href"))
    rows = cells.groupBy(key, "table", "row").agg(F.sort_array(F.collect_list(F.when(F.col("cell") >= 0, F.struct("cell", "text", "href")))).alias("c"))  # of one row
    return rows.select(key, "table", "row", F.transform("c", lambda c: F.struct(c["text"].alias("text"), c["href"].alias("href"))).alias("cells"))


def table_rows(pages: DataFrame, key: str, html: str, header: list[str]) -> DataFrame:
    """(key, row, cells, problem): rows of the one table with exactly this header.

    Pages with no such table, or several, give one row with a problem; rows of another width or with
    an empty first cell are reported, not dropped. See ``table_cells`` for what counts as a table.
    """
    found = table_cells(pages, key, html).withColumn("cells", F.transform("cells", lambda c: c["text"]))
    heads = found.filter((F.col("row") == 0) & (F.col("cells") == F.array(*[F.lit(h) for h in header])))
    heads = heads.groupBy(key).agg(F.min("table").alias("table"), F.count(F.lit(1)).alias("n"))
    body = found.filter("row > 0").join(heads.filter("n = 1").select(key, "table"), [key, "table"]).select(key, (F.col("row") - 1).cast("int").alias("row"), "cells")
    problem = F.when(F.size("cells") != len(header), "row_width").when(F.get("cells", F.lit(0)) == "", "required_cell_empty")
    none = pages.select(key).join(heads, key, "left").filter("n IS NULL OR n > 1").select(
        key, F.lit(None).cast("int").alias("row"), F.lit(None).cast("array<string>").alias("cells"), F.when(F.col("n").isNull(), "no_table").otherwise("several_tables").alias("problem"))
    return body.withColumn("problem", problem).unionByName(none)


def allowed_url(url: Column, hosts: list[str], path: str) -> Column:
    """https, a listed host, no port or user, and a path that matches; null and malformed ones aren't allowed."""
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts) & F.try_parse_url(url, F.lit("PATH")).rlike(path)
    plain = F.try_parse_url(url, F.lit("AUTHORITY")) == F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(ok & plain, F.lit(False))


def robots_allows(paths: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """(path, allowed): the longest rule (prefix, allow) that fits decides; at equal length all must allow.
    A path that no rule fits is allowed, and a null one, too.

    With a column ``agent`` the rules are those of the groups that name the first word of ``agent``, or,
    if no group does, those for ``*``. In a rule ``*`` stands for any characters and a ``$`` at the end for
    the end of the path. The part of a rule before these is met by equality with prefixes of the path,
    up to the longest such part; only what meets is matched in full.
    """
    if "agent" in rules.columns:
        own = F.lower("agent") == agent.split("/", 1)[0].split(" ", 1)[0].lower()
        named = rules.withColumn("own", F.coalesce(own, F.lit(False))).filter(F.col("own") | (F.col("agent") == "*"))
        rules = named.crossJoin(F.broadcast(named.agg(F.max("own").alias("any_own")))).filter(F.col("own") == F.col("any_own")).select("prefix", "allow")  # one row
    plain = F.regexp_replace("prefix", r"([\\.\[\]{}()+?^|$#&~])", r"\\$1")
    pattern = F.concat(F.lit("(?s)^"), F.regexp_replace(F.replace(plain, F.lit("*"), F.lit(".*")), r"\\\$$", r"\$"))
    rules = rules.filter("prefix <> ''").select(F.col("prefix").alias("rule"), "allow", F.regexp_extract("prefix", r"^(.*?)(?:\*.*|\$)?$", 1).alias("head"), pattern.alias("pattern"))
    longest = rules.agg(F.coalesce(F.max(F.length("head")), F.lit(0)).alias("longest"))
    cuts = F.transform(F.sequence(F.lit(0), F.least(F.length("path"), F.col("longest"))), lambda n: F.substring(F.col("path"), F.lit(1), n))
    met = paths.crossJoin(F.broadcast(longest)).select("path", F.explode(cuts).alias("head")).join(rules, "head").filter(F.regexp_like("path", F.col("pattern")))
    best = met.groupBy("path", F.length("rule").alias("n")).agg(F.bool_and("allow").alias("allow")).groupBy("path").agg(F.max_by("allow", "n").alias("allow"))
    return paths.join(best, "path", "left").select("path", F.coalesce("allow", F.lit(True)).alias("allowed"))


#: Elements that must not stand in a published page.
ACTIVE = ("script", "iframe", "object", "embed", "form", "link", "meta", "base")


#: Attributes that hold addresses, schemes that must not stand in them, and what styles must not hold.
ADDRESSES = ("href", "src", "xlink:href", "action", "formaction")
SCHEMES = ("javascript:", "vbscript:", "data:")
REMOTE_CSS = ("url(", "@import", "expression(")


def safety_findings(html: Column) -> Column:
    """Sorted findings in a page: active elements, event attributes, script URLs, remote CSS, refreshes.

    Tags are told from texts, comments and the contents of scripts first. Addresses are tested with their character
    references resolved and without blanks and control characters, styles without escapes and comments.
    """
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: t.rlike("^<[a-zA-Z]"))
    found = F.transform(tags, lambda t: F.struct(_name(t).alias("name"), _attributes(t).alias("a"), F.when(t.rlike("(?i)^<style[\\s>]"), F.regexp_extract(t, rf"(?s)^<[a-zA-Z]+{_IN_TAG}>(.*?)(?:</[a-zA-Z]+\s*>)?$", 1)).alias("css")))

    def of_tag(t: Column) -> Column:
        remote = lambda css: _any(css_decoded(css), REMOTE_CSS)
        address = lambda a: F.lower(F.regexp_replace(a["value"], r"[\x00-\x20\x7f]+", ""))
        refresh = (t["name"] == "meta") & F.exists(t["a"], lambda a: (a["name"] == "http-equiv") & (F.lower(a["value"]) == "refresh"))
        return F.array(
            F.when(t["name"].isin(*ACTIVE), F.concat(F.lit("element_"), t["name"])),
            F.when(F.exists(t["a"], lambda a: a["name"].startswith("on")), "event_attribute"),
            F.when(F.exists(t["a"], lambda a: a["name"].isin(*ADDRESSES) & address(a).rlike("^(?:" + "|".join(SCHEMES) + ")")), "script_url"),
            F.when(F.exists(t["a"], lambda a: (a["name"] == "style") & remote(a["value"])) | F.coalesce(remote(t["css"]), F.lit(False)), "css_remote"),
            F.when(refresh, "meta_refresh"),
        )

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(found, of_tag)))))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for part in parts:
        test = test | text.contains(part)
    return test
