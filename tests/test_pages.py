"""Tables and safety of pages."""

from pyspark.sql import functions as F

from netledger.operators import spatial
from netledger.sources import html


def rows(spark, page):
    df = spark.createDataFrame([(1, page)], "id int, html string")
    out = {}
    for r in html.table_cells(df, "id", "html").orderBy("table", "row").collect():
        out.setdefault(r.table, []).append([(c.text, c.href) for c in r.cells])
    return list(out.values())


def test_a_table_in_a_table_is_a_table_of_its_own(spark):
    page = "<table><tr><td>1<table><tr><td>q</td><td>r</td></tr></table>2</td><td>x</td></tr><tr><td>y</td></tr></table><table><TR><TH>after</TH></TR></table>"
    assert rows(spark, page) == [[[("12", None), ("x", None)], [("y", None)]], [[("q", None), ("r", None)]], [[("after", None)]]]


def test_scripts_references_links_and_open_cells(spark):
    page = "<p></table>stray<table class='a>b'><!-- <tr><td>no</td></tr> --><script>'<td>'</script><tr><th>a &lt;b&gt;\n &#x41;&#66;&nosuch;</th><td><a href='/x?a=1&amp;b=2'>go</a> on<td></tr><tr></tr></table>"
    assert rows(spark, page) == [[[("a <b> AB&nosuch;", None), ("go on", "/x?a=1&b=2"), ("", None)], []]]
    assert rows(spark, "") == rows(spark, "<table></table>") == []


FOUND = [
    (r"<style>a{background:u\72l(https://evil.test/x)}</style>", ["css_remote"]), (r"<p style='background:\000075rl(x)'>", ["css_remote"]), (r"<style>@im\port 'x'</style>", ["css_remote"]), ("<style>a{b:u/**/rl(x)}</style>", ["css_remote"]),
    ("<a href='java&#115;cript:alert(1)'>", ["script_url"]), ("<a href='java\nscript:alert(1)'>", ["script_url"]), ("<a href='java\tscript:x'>", ["script_url"]), ("<a xlink:href=VBScript:x>", ["script_url"]), ("<img src='data:x'>", ["script_url"]),
    ("<p ONclick=x>", ["event_attribute"]), ("<p title='>' onclick = 'x'>", ["event_attribute"]), ("<script>1</script>", ["element_script"]), ("<meta HTTP-EQUIV='refresh'>", ["element_meta", "meta_refresh"]), ("<iframe/>", ["element_iframe"]),
    ("<p>javascript: url(x) onclick=1</p>", []), ("<p title='onclick=1'>", []), ("<!-- <script> -->", []), ("<p style='color:red'>", []), ("<a href='/data:x'>", []), ("", []), (None, None),
]


def test_findings_see_through_escapes(spark):
    df = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(FOUND)], "i int, h string")
    assert [r.f for r in df.select("i", html.safety_findings(F.col("h")).alias("f")).orderBy("i").collect()] == [found for _, found in FOUND]


def test_neighbours_end_on_repeated_ids(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, "p")] * 3 + [(2, 1.0, 0.0, "p"), (3, 5.0, 0.0, "p"), (4, 5.0, 0.0, "q")], "id int, x double, y double, g string")
    out = {(r.src, r.dst, r.distance) for r in spatial.knn_edges(points, 10, 1.0, ["g"]).collect()}
    assert out == {(1, 2, 1.0), (2, 1, 1.0), (1, 3, 5.0), (3, 1, 5.0), (2, 3, 4.0), (3, 2, 4.0)}
    assert spatial.knn_edges(points.filter("id = 1"), 10, 1.0, ["g"]).count() == 0
