"""Robots rules of any length, with wildcards and groups of agents."""

from netledger.sources import html


def test_rules_longer_than_256_characters_apply(spark):
    long = "/" + "a" * 400
    rules = spark.createDataFrame([("/", True), (long, False)], "prefix string, allow boolean")
    paths = spark.createDataFrame([(long + "/x",), (long[:-1],), ("",), (None,)], "path string")
    got = {r.path: r.allowed for r in html.robots_allows(paths, rules).collect()}
    assert got == {long + "/x": False, long[:-1]: True, "": True, None: True}
    assert all(r.allowed for r in html.robots_allows(paths, rules.limit(0)).collect())


def test_wildcards_ends_and_groups(spark):
    rows = [("*", "/", True), ("*", "/a*/x", False), ("*", "/end$", False), ("*", "/p.q", False), ("Bot", "/only", False), ("other", "/", False)]
    rules = spark.createDataFrame(rows, "agent string, prefix string, allow boolean")
    paths = spark.createDataFrame([(p,) for p in ("/abc/x/1", "/a/y", "/end", "/end/", "/pxq", "/p.q1", "/only/1")], "path string")
    got = lambda agent: {r.path for r in html.robots_allows(paths, rules, agent).collect() if not r.allowed}
    assert got("*") == got("nobody/1.0") == {"/abc/x/1", "/end", "/p.q1"}
    assert got("bot/2.0 (x)") == {"/only/1"}
