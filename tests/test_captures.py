"""Capture indexes of all three forms, and their audit."""

import json

from pyspark.sql import functions as F

from netledger.operators import graph
from netledger.sources import captures

HOST = "www.facilities.example"
PAGE = f"https://{HOST}/news/"


def entry(name, at, digest="A", **more):
    return {"original": PAGE + name, "timestamp": at, "digest": digest, "length": "1", "mime": "text/html", "status": "200", **more}


def audit(spark, folder):
    records, problems = captures.audit_captures(captures.read_captures(spark, str(folder)), [HOST], "^/news/", "2024-01-01")
    return records.collect(), sorted((p.code, p.url) for p in problems.collect())


def test_forms_give_the_same_rows(spark, tmp_path):
    rows = [entry("a", "20240101000000"), entry("b", "20240102000000", "B", redirect=None), {"original": "x", "timestamp": "bad", "digest": "d2"}]
    names = list(rows[0])
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "objects.json").write_text(" [ " + " ,\n".join(map(json.dumps, rows)) + " ]\n")
    (tmp_path / "lists.json").write_text(json.dumps([names, *[[r.get(n) for n in names] for r in rows]]))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "nothing.json").write_text("")
    read = captures.read_captures(spark, str(tmp_path)).orderBy("file", "ord").collect()
    found = {}
    for r in read:
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.malformed, r.original, r.timestamp, r.digest, r.length))
    assert set(found) == {"lines.json", "objects.json", "lists.json"}
    assert found["lines.json"] == found["objects.json"] == found["lists.json"]
    assert [r[1] for r in found["lists.json"]] == [PAGE + "a", PAGE + "b", "x"]
    assert captures.capture_rows(spark, str(tmp_path)).count() == 6


def test_unreadable_rows_are_reported(spark, tmp_path):
    (tmp_path / "lists.json").write_text('[["original","timestamp"],["u]v","20240101000000"],["w","20240101000000"]]')
    (tmp_path / "lines.json").write_text('{"original": 1\n[1]\n"text"\n')
    read = captures.read_captures(spark, str(tmp_path)).collect()
    assert sum(r.malformed for r in read if r.file.endswith("lines.json")) == 3
    assert [r.original for r in read if r.file.endswith("lists.json") and not r.malformed] == ["w"]
    assert any(r.malformed for r in read if r.file.endswith("lists.json"))


def test_audit_links_versions_and_refuses_conflicts(spark, tmp_path):
    rows = [entry("a", "20240101000000"), entry("a", "20240102000000", "B"), entry("a", "20240103000000", "B"), entry("b", "20240101000000"), entry("b", "20240101000000", "C"),
            entry("c?q", "20240101000000"), entry("c", "20240199000000"), entry("c", "20240101000000", ""), entry("c", "20240101000000", length="-2"), entry("c", "20240101000000", redirect=PAGE + "a")]
    for order in (rows, rows[::-1]):
        (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, order)))
        records, problems = audit(spark, tmp_path)
        assert [p[0] for p in problems] == ["conflicting_capture", "duplicate_capture", "invalid_length", "invalid_redirect", "invalid_timestamp", "invalid_url", "missing_fields"]
        assert {r.url for r in records} == {PAGE + "a"}
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    assert {(r.captured_at, r.supersedes) for r in audit(spark, tmp_path)[0]} == {("20240101000000", None), ("20240102000000", "20240101000000")}


def test_audit_follows_redirects(spark, tmp_path):
    to = lambda a, b: entry(a, "20240101000000", status="301", redirect=PAGE + b)
    rows = [to("a", "b"), to("b", "c"), entry("c", "20240101000000"), to("d", "e"), to("e", "gone"), to("p", "q"), to("q", "r"), to("r", "q"), to("s", "s")]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    records, problems = audit(spark, tmp_path)
    assert len(records) == 9
    assert problems == [("redirect_cycle", PAGE + n) for n in "pqrs"] + [("redirect_target_missing", PAGE + n) for n in "de"]


def test_audit_of_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    assert audit(spark, tmp_path) == ([], [])


def test_chain_ends_of_a_long_chain(spark):
    chain = spark.range(3000).select("id", (F.col("id") + 1).alias("to")).unionByName(spark.createDataFrame([(-1, -2), (-2, -1), (-3, -1)], "id long, to long"))
    ends = {r.id: r.end for r in graph.chain_ends(chain).collect()}
    assert len(ends) == 3003 and all(ends[i] == 3000 for i in range(3000)) and {ends[i] for i in (-1, -2, -3)} == {None}
