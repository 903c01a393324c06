"""Queries of contracts, text functions and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.functions import text as tx
from netledger.operators import contracts as ct
from netledger.plans.common import lat, lon, rounded, table
from netledger.sources import html


def identifier_contract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 97 != 0, F.concat(F.lit("x"), F.floor(F.col("doc_id") * 0.995))).otherwise(" ").alias("identifier"))
    return ct.identifier_problems(d, "identifier")


def _coordinates(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 13 != 0, lat(k) + F.when(k % 17 == 0, 30).otherwise(0)).alias("lat"), F.when((k % 13 != 0) | (k % 2 == 0), lon(k)).alias("lon"),
        F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, "epsg:4326").otherwise("EPSG: 6668").alias("crs"), F.when(k % 29 == 0, "street").when(k % 13 == 0, "unmatched").otherwise("town").alias("accuracy"),
    )


def coordinate_contract(spark, sf_dir):
    c = _coordinates(spark, sf_dir)
    return ct.problems(c, ct.coordinate_tests(F.col("lat"), F.col("lon"), F.col("crs"), F.col("accuracy"), 6668), "id")


def mark_summary(spark, sf_dir):
    k = F.col("c_custkey")
    marks = F.array(F.lit("○"), F.lit("×"), F.lit("-"), F.lit(" "), F.lit("☆"))
    c = table(spark, sf_dir, "customer").select(tx.tri_bool(tx.mark_state(F.get(marks, (k % 5).cast("int")))).alias("simple"), tx.tri_bool(tx.mark_state(F.get(marks, (k % 3).cast("int")))).alias("remote"))
    return ct.mark_summary(c, ["simple", "remote"])


def id_hashes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type"), 256).alias("id"))


def ascii_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.ascii_normalized(F.col("text"))).alias("digest"))


def nfkc_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.normalized(F.col("text"))).alias("digest"), F.length(tx.folded_name(F.col("text"))).alias("n"))


def regex_extracts(spark, sf_dir):
    """Parts of prefecture-like names, EPSG codes, and numbers, from texts made of keys."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        k, F.concat(F.element_at(F.array(*map(F.lit, ("東京都", "大阪府", "北海道", "神奈川県", "none"))), (k % 5 + 1).cast("int")), k.cast("string"), F.lit("区")).alias("a"),
        F.concat(F.element_at(F.array(*map(F.lit, ("EPSG:", "epsg:  ", "CRS "))), (k % 3 + 1).cast("int")), (k + 4000).cast("string")).alias("b"), F.concat((k % 7).cast("string"), F.when(k % 2 == 0, "x").otherwise("")).alias("c"),
    )
    return s.select("s_suppkey", F.regexp_extract("a", tx.PREFECTURE, 1).alias("prefecture"), tx.epsg(F.col("b")).alias("epsg"), tx.safe_int(F.col("c")).alias("number"))


def strict_dates(spark, sf_dir):
    """Dates with days that some months lack: strict dates, and month ends."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return o.select("o_orderkey", tx.iso_date(text).cast("string").alias("day"), tx.month_end(text).cast("string").alias("month_end"))


def era_dates(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.element_at(F.array(*map(F.lit, ("H", "R", "S", "M", ""))), (k % 5 + 1).cast("int")), (k % 60 + 1).cast("string"), F.lit("."), (k % 13).cast("string"), F.lit("."), (k % 31 + 1).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"), tx.era_date(text).cast("string").alias("day"))


def link_discovery(spark, sf_dir):
    out = html.links(table(spark, sf_dir, "pages"), "page_id", "html")
    return out.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.sum("n").alias("n_tags"), F.md5(F.array_join(F.array_sort(F.collect_list("href")), " ")).alias("digest"))


def html_safety(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(html.safety_findings(F.col("html")), ",").alias("findings"))


def _planted(spark, sf_dir):
    """Pages with tables inside tables, and with references and escapes that hide what they are."""
    hidden = F.array(*[F.lit(x) for x in _HIDDEN])
    number = F.col("page_id").cast("string")
    inner = F.concat(F.lit("<table><tr><th>k</th><th>v</th></tr><tr><td>"), number, F.lit("</td><td>in &amp; <b>out</b></td></tr></table>"))
    outer = F.concat(F.lit("<table><tr><th>a<th>b</tr><tr><td>&#49;<td>"), F.when(F.col("page_id") % 3 == 0, inner).otherwise("<a href='x'>plain</a>"), F.lit("</tr><script>'<tr><td>'</script><tr><td></td><td>z</td></tr></table>"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.get(hidden, (F.col("page_id") % len(_HIDDEN)).cast("int")), F.when(F.col("page_id") % 4 != 0, outer).otherwise("")).alias("html"))


def html_hidden_findings(spark, sf_dir):
    return _planted(spark, sf_dir).select("page_id", F.array_join(html.safety_findings(F.col("html")), ",").alias("findings"))


def html_table_rows(spark, sf_dir):
    """Rows of the outer and of the inner tables, each found by its header."""
    p = _planted(spark, sf_dir)
    both = [html.table_rows(p, "page_id", "html", header).withColumn("header", F.lit(",".join(header))) for header in (["a", "b"], ["k", "v"])]
    return both[0].unionByName(both[1]).withColumn("cells", F.array_join("cells", "|"))


def allowed_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hosts = ["www.example.com", "m.ththth.example.net", "ththre.example.com"]
    return p.select("page_id", html.allowed_url(F.col("url"), hosts, "^/(en|fr|de|es)/").alias("allowed"))


def robots_paths(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.try_parse_url("url", F.lit("PATH")).alias("path")).filter("path IS NOT NULL").distinct()
    rules = spark.createDataFrame([("/en/", False), ("/en/1", True), ("/fr", True), ("/fr", False), ("/de/", True)], "prefix string, allow boolean")
    return html.robots_allows(paths, rules)


def reason_types(spark, sf_dir):
    """Types of the events that a part's name words stand for."""
    reasons = {"STEEL": "created", "BRASS": "closed", "COPPER": "moved", "PROMO": "renamed", "LARGE": "created"}
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(tx.event_types(F.col("p_type"), reasons), ",").alias("types"))


def outlier_verdict(spark, sf_dir):
    """Five-way verdict from three tests, counted."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select((k % 5 != 0).alias("known"), F.when(k % 7 != 0, k % 2 == 0).alias("now"), (k % 3 == 0).alias("then"))
    verdict = F.when(~F.col("known"), "unknown_code").when(F.col("now").isNull(), "not_evaluable").when(F.col("now") & F.col("then"), "both").when(F.col("now") != F.col("then"), "one").otherwise("neither")
    return c.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_contract(spark, sf_dir):
    """Problems of rows that carry a digest of their other columns: repeated keys, ranges, wrong digests."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.floor(F.col("o_orderkey") * 0.999).alias("entity"), F.col("o_custkey").alias("grid"), F.when(F.col("o_orderkey") % 41 == 0, -1).otherwise(F.col("o_orderkey") % 7).alias("population"))
    good = ct.row_digest("entity", "grid", "population")
    rows = rows.withColumn("row_sha256", F.when(F.col("entity") % 53 == 0, F.lit("0" * 64)).otherwise(good))
    repeated = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("_n"))
    tests = {"repeated": F.col("_n") > 1, "negative_population": F.col("population") < 0, "digest_wrong": F.col("row_sha256") != good}
    return ct.problems(rows.join(repeated, "entity"), tests, "entity")


def geodesic_distance(spark, sf_dir):
    """Ellipsoidal lengths between successive customers' places."""
    from netledger.functions import geo

    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, geo.geodesic(lat(k), lon(k), lat(k + 1), lon(k + 1)).alias("metres"))
    return rounded(c, "metres", digits=3)


def layout_widths(spark, sf_dir):
    """Display widths of names with wide characters, and their first columns."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.repeat(F.lit("東"), (F.col("s_suppkey") % 5).cast("int")), F.lit("ab"), F.lit("京")).alias("t"))
    return s.select("s_suppkey", tx.display_width(F.col("t")).cast("long").alias("width"), tx.slice_columns(F.col("t"), 0, 4).alias("head"))


QUERIES = {
    f.__name__: f
    for f in (
        identifier_contract, coordinate_contract, mark_summary, id_hashes, ascii_normalize, nfkc_normalize, regex_extracts, strict_dates, era_dates,
        link_discovery, html_safety, html_hidden_findings, html_table_rows, allowed_urls, robots_paths, reason_types, outlier_verdict, snapshot_contract, geodesic_distance, layout_widths,
    )
}

#: What pages are given by their number, and the findings in it.
_HIDDEN = {
    "<p>javascript: url( onclick=1</p>": "", r"<p style='background:u\72l(x)'>": "css_remote", "<a href='java&#115;cript&colon;x'>": "script_url", "<a href='java\nscript:x'>": "script_url",
    "<style>@\\69mport 'x'</style>": "css_remote", "<style>a{width:ex/* */pression(1)}</style>": "css_remote", "<p title='a>b' oncut=x>": "event_attribute", "<!-- <iframe onload=x> -->": "",
    "<script>'<embed>'</script>": "element_script", "<META http-equiv=Refresh>": "element_meta,meta_refresh", "<p title='onclick=1 href=data:x'>": "",
}

_COORDINATES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 13 <> 0 THEN 20 + (c_custkey * 37 % 2600) / 100 + CASE WHEN c_custkey % 17 = 0 THEN 30 ELSE 0 END END AS lat,
  CASE WHEN c_custkey % 13 <> 0 OR c_custkey % 2 = 0 THEN 122 + (c_custkey * 91 % 3200) / 100 END AS lon,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 4326 ELSE 6668 END AS code,
  CASE WHEN c_custkey % 29 = 0 THEN 'street' WHEN c_custkey % 13 = 0 THEN 'unmatched' ELSE 'town' END AS accuracy FROM customer"""

_FINDINGS = ", ".join(
    [f"CASE WHEN regexp_matches(h, '<{e}[\\s/>]', 'i') THEN 'element_{e}' END" for e in html.ACTIVE]
    + [
        "CASE WHEN regexp_matches(h, '<[a-z][^>]*\\son[a-z]+\\s*=', 'is') THEN 'event_attribute' END",
        "CASE WHEN regexp_matches(h, '(href|src)\\s*=\\s*[\"'']?\\s*javascript:', 'i') THEN 'script_url' END",
        "CASE WHEN regexp_matches(h, '<style[^>]*>[^<]*(@import|url\\()', 'is') THEN 'css_remote' END",
    ]
)

ORACLE_SQL = {
    "identifier_contract": """
WITH d AS (SELECT nullif(trim(CASE WHEN doc_id % 97 <> 0 THEN 'x' || floor(doc_id * 0.995)::BIGINT ELSE ' ' END), '') AS identifier FROM documents)
SELECT CASE WHEN identifier IS NULL THEN 'blank' ELSE 'duplicate' END AS problem, identifier, count(*) AS n FROM d GROUP BY identifier HAVING identifier IS NULL OR count(*) > 1""",
    "coordinate_contract": f"""
WITH c AS ({_COORDINATES}), p AS (
  SELECT 'crs_missing' AS code, id FROM c WHERE code IS NULL UNION ALL SELECT 'crs_wrong', id FROM c WHERE code <> 6668 UNION ALL SELECT 'half_missing', id FROM c WHERE (lat IS NULL) <> (lon IS NULL)
  UNION ALL SELECT 'outside', id FROM c WHERE lat < 20 OR lat > 46 OR lon < 122 OR lon > 154 UNION ALL SELECT 'accuracy_unknown', id FROM c WHERE accuracy = 'street'
  UNION ALL SELECT 'accuracy_contradicts', id FROM c WHERE (accuracy = 'unmatched') <> (lat IS NULL AND lon IS NULL))
SELECT code, count(*) AS n, array_to_string((list(id ORDER BY id))[1:5], ',') AS sample FROM p GROUP BY 1""",
    "mark_summary": """
WITH c AS (SELECT CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS simple, CASE c_custkey % 3 WHEN 0 THEN true ELSE false END AS remote FROM customer)
SELECT 'simple' AS field, count(*) FILTER (simple) AS yes, count(*) FILTER (NOT simple) AS no, count(*) FILTER (simple IS NULL) AS unknown FROM c
UNION ALL SELECT 'remote', count(*) FILTER (remote), count(*) FILTER (NOT remote), count(*) FILTER (remote IS NULL) FROM c""",
    "id_hashes": "SELECT event_id, sha256(event_id || '|' || user_id || '|' || event_type) AS id FROM events",
    "html_safety": f"""
WITH t AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS h FROM pages), f AS (SELECT page_id, unnest([{_FINDINGS}]) AS finding FROM t)
SELECT page_id, coalesce(string_agg(finding, ',' ORDER BY finding), '') AS findings FROM f GROUP BY 1""",
    "html_hidden_findings": f"""
WITH t AS (SELECT page_id, page_id % 4 <> 0 AS outer_table, regexp_replace(html, '<!--.*?-->', '', 'gs') AS h FROM pages),
f AS (SELECT page_id, unnest([{_FINDINGS}] || CASE WHEN outer_table THEN ['element_script'] ELSE [] END || string_split(([{", ".join(f"'{x}'" for x in _HIDDEN.values())}])[page_id % {len(_HIDDEN)} + 1], ',')) AS finding FROM t)
SELECT page_id, coalesce(string_agg(DISTINCT finding, ',' ORDER BY finding) FILTER (finding <> ''), '') AS findings FROM f GROUP BY 1""",
    "html_table_rows": """
WITH p AS (SELECT page_id, page_id % 4 <> 0 AS has_outer, page_id % 4 <> 0 AND page_id % 3 = 0 AS has_inner FROM pages)
SELECT page_id, 0 AS row, '1|' || CASE WHEN has_inner THEN '' ELSE 'plain' END AS cells, NULL AS problem, 'a,b' AS header FROM p WHERE has_outer
UNION ALL SELECT page_id, 1, '|z', 'required_cell_empty', 'a,b' FROM p WHERE has_outer UNION ALL SELECT page_id, NULL, NULL, 'no_table', 'a,b' FROM p WHERE NOT has_outer
UNION ALL SELECT page_id, 0, page_id || '|in & out', NULL, 'k,v' FROM p WHERE has_inner UNION ALL SELECT page_id, NULL, NULL, 'no_table', 'k,v' FROM p WHERE NOT has_inner""",
    "ascii_normalize": rf"SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), '{tx.DASHES}', '{'-' * len(tx.DASHES)}'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS digest FROM documents",
    "regex_extracts": """
WITH s AS (SELECT s_suppkey, (['東京都', '大阪府', '北海道', '神奈川県', 'none'])[s_suppkey % 5 + 1] AS p, s_suppkey % 3 AS m FROM supplier)
SELECT s_suppkey, CASE WHEN p = 'none' THEN '' ELSE p END AS prefecture, CASE WHEN m < 2 THEN (s_suppkey + 4000)::INT END AS epsg, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_suppkey % 7 END AS number FROM s""",
    "strict_dates": """
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS s FROM orders), d AS (SELECT o_orderkey, try_cast(s AS DATE) AS d FROM t)
SELECT o_orderkey, d::VARCHAR AS day, CASE WHEN d = last_day(d) THEN d::VARCHAR END AS month_end FROM d""",
    "era_dates": """
WITH t AS (SELECT s_suppkey, (['H', 'R', 'S', 'M', ''])[s_suppkey % 5 + 1] AS e, s_suppkey % 60 + 1 AS y, s_suppkey % 13 AS m, s_suppkey % 31 + 1 AS d FROM supplier)
SELECT s_suppkey, e || y || '.' || m || '.' || d AS text, CASE WHEN e <> 'M' THEN try_cast((y + CASE e WHEN 'H' THEN 1988 WHEN 'R' THEN 2018 WHEN 'S' THEN 1925 ELSE 2000 END) || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE)::VARCHAR END AS day FROM t""",
    "link_discovery": r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1)) AS href FROM pages), g AS (SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL)
SELECT page_id, count(*) AS n_links, sum(n)::BIGINT AS n_tags, md5(string_agg(href, ' ' ORDER BY href)) AS digest FROM g GROUP BY 1""",
    "allowed_urls": """
SELECT page_id, coalesce(regexp_matches(url, '^https://(www\\.example\\.com|m\\.ththth\\.example\\.net|ththre\\.example\\.com)/(en|fr|de|es)/'), false) AS allowed FROM pages""",
    "robots_paths": r"""
WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)?', 1) AS path FROM pages),
r(prefix, allow) AS (VALUES ('/en/', false), ('/en/1', true), ('/fr', true), ('/fr', false), ('/de/', true)),
m AS (SELECT path, length(prefix) AS n, bool_and(allow) AS allow FROM p JOIN r ON starts_with(path, prefix) GROUP BY ALL)
SELECT path, coalesce((SELECT arg_max(allow, n) FROM m WHERE m.path = p.path), true) AS allowed FROM p""",
    "reason_types": """
WITH t AS (SELECT p_partkey, list_distinct(list_filter([CASE WHEN contains(p_type, 'STEEL') OR contains(p_type, 'LARGE') THEN 'created' END, CASE WHEN contains(p_type, 'BRASS') THEN 'closed' END,
  CASE WHEN contains(p_type, 'COPPER') THEN 'moved' END, CASE WHEN contains(p_type, 'PROMO') THEN 'renamed' END], lambda x: x IS NOT NULL)) AS l FROM part)
SELECT p_partkey, array_to_string(list_sort(l), ',') AS types FROM t""",
    "outlier_verdict": """
WITH c AS (SELECT c_custkey % 5 <> 0 AS known, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS now, c_custkey % 3 = 0 AS past FROM customer)
SELECT CASE WHEN NOT known THEN 'unknown_code' WHEN now IS NULL THEN 'not_evaluable' WHEN now AND past THEN 'both' WHEN now <> past THEN 'one' ELSE 'neither' END AS verdict, count(*) AS n FROM c GROUP BY 1""",
    "snapshot_contract": """
WITH r AS (SELECT floor(o_orderkey * 0.999)::BIGINT AS entity, CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE o_orderkey % 7 END AS population FROM orders),
c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM r),
p AS (SELECT 'repeated' AS code, entity FROM c WHERE n > 1 UNION ALL SELECT 'negative_population', entity FROM c WHERE population < 0 UNION ALL SELECT 'digest_wrong', entity FROM c WHERE entity % 53 = 0)
SELECT code, count(*) AS n, array_to_string((list(entity ORDER BY entity))[1:5], ',') AS sample FROM p GROUP BY 1""",
    "layout_widths": """
SELECT s_suppkey, 2 * (s_suppkey % 5) + 4 AS width, CASE s_suppkey % 5 WHEN 0 THEN 'ab京' WHEN 1 THEN '東ab' ELSE '東東' END AS head FROM supplier""",
}
