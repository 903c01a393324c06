"""The audit of capture indexes, on captures made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.plans.common import table
from netledger.sources import captures

_HOST, _PATH = "www.facilities.example", "^/news/"
#: Of every ten addresses, 0 to 5 lead along a chain whose end is there, or not; 6 to 8 in a circle.
_NEXT = "CASE WHEN k % 10 <= 4 THEN k + 1 WHEN k % 10 IN (6, 7) THEN k + 1 WHEN k % 10 = 8 THEN k - 2 END"


def capture_audit(spark, sf_dir):
    """Every record and every problem of captures that the events of users give: the user is the address,
    the value the digest; records have no code."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS k", "ts", "event_id % 29 AS h")
    address = lambda k: F.concat(F.lit(f"https://{_HOST}/news/"), k.cast("string"))
    ahead = F.expr(_NEXT)
    turned = (F.col("h") < 9) & ahead.isNotNull()
    text = lambda c: c.cast("string")
    rows = e.select(
        F.lit("events").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("event_id").alias("pos")).alias("ord"), (F.col("h") == 20).alias("malformed"),
        F.when(F.col("h") == 21, F.lit("https://elsewhere.example/news/1")).when(F.col("h") == 22, F.concat(address(F.col("k")), F.lit("?q"))).otherwise(address(F.col("k"))).alias("original"), F.lit(None).cast("string").alias("url"),
        F.when(F.col("h") == 23, F.lit("20240230000000")).otherwise(F.date_format("ts", "yyyyMMdd000000")).alias("timestamp"), F.when(F.col("h") != 24, text(F.col("event_id") % 7)).alias("digest"),
        F.when(F.col("h") == 25, F.lit("-1")).otherwise(text(F.col("h"))).alias("length"), F.lit("application/pdf").alias("mime"), F.when(turned & (F.col("h") != 8), F.lit("301")).otherwise(F.lit("200")).alias("status"),
        F.when(turned, F.when(F.col("k") % 40 == 4, address(-F.col("k"))).otherwise(address(ahead))).alias("redirect"), F.when(F.col("h") != 26, F.lit("2024-02-01")).alias("coverage_date"))
    records, problems = captures.audit_captures(rows, [_HOST], _PATH)
    none = F.lit(None).cast("string")
    return records.select(none.alias("code"), "url", "captured_at", "digest", "redirect", "supersedes").unionByName(
        problems.filter("code <> 'duplicate_capture'").select("code", "url", "captured_at", none.alias("digest"), none.alias("redirect"), none.alias("supersedes"))).unionByName(
        problems.filter("code = 'duplicate_capture'").groupBy("code", "url").agg(F.count(F.lit(1)).cast("string").alias("digest")).select("code", "url", none.alias("captured_at"), "digest", none.alias("redirect"), none.alias("supersedes")))


QUERIES = {f.__name__: f for f in (capture_audit,)}

ORACLE_SQL = {
    "capture_audit": f"""
WITH RECURSIVE e AS (SELECT event_id, user_id AS k, ts, event_id % 29 AS h FROM events),
n AS (SELECT *, CASE WHEN h < 9 THEN {_NEXT} END AS ahead, 'https://{_HOST}/news/' || k AS url, CASE WHEN h = 23 THEN '20240230000000' ELSE strftime(ts, '%Y%m%d') || '000000' END AS t, event_id % 7 AS digest,
  CASE h WHEN 20 THEN 'malformed_row' WHEN 21 THEN 'invalid_url' WHEN 22 THEN 'invalid_url' WHEN 23 THEN 'invalid_timestamp' WHEN 24 THEN 'missing_fields' WHEN 25 THEN 'invalid_length' WHEN 26 THEN 'missing_coverage_date' END AS code FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY url, digest ORDER BY event_id) AS nth FROM n WHERE code IS NULL),
g AS (SELECT *, CASE WHEN ahead IS NOT NULL THEN 'https://{_HOST}/news/' || CASE WHEN k % 40 = 4 THEN -k ELSE ahead END END AS redirect, ahead IS NOT NULL AND h = 8 AS wrong FROM f WHERE nth = 1),
r AS (SELECT *, lag(t) OVER (PARTITION BY url ORDER BY t, event_id) AS supersedes, count(*) OVER (PARTITION BY url, t) AS same FROM g WHERE NOT wrong),
p AS (SELECT url AS id, arg_max(redirect, event_id) AS dest FROM r WHERE redirect IS NOT NULL GROUP BY 1),
w AS (SELECT id, dest, 1 AS hop FROM p UNION ALL SELECT w.id, p.dest, hop + 1 FROM w JOIN p ON w.dest = p.id WHERE hop < 30),
z AS (SELECT id, arg_max(dest, hop) AS finish, max(hop) AS hops FROM w GROUP BY 1)
SELECT NULL AS code, url, t AS captured_at, digest::VARCHAR AS digest, redirect, supersedes FROM r WHERE same = 1
UNION ALL SELECT code, CASE WHEN code <> 'invalid_url' THEN url END, t, NULL, NULL, NULL FROM n WHERE code IS NOT NULL
UNION ALL SELECT 'duplicate_capture', url, NULL, count(*)::VARCHAR, NULL, NULL FROM f WHERE nth > 1 GROUP BY url
UNION ALL SELECT 'invalid_redirect', url, t, NULL, NULL, NULL FROM g WHERE wrong
UNION ALL SELECT 'conflicting_capture', url, t, NULL, NULL, NULL FROM r WHERE same > 1 GROUP BY url, t
UNION ALL SELECT 'redirect_cycle', id, NULL, NULL, NULL, NULL FROM z WHERE hops = 30
UNION ALL SELECT 'redirect_target_missing', id, NULL, NULL, NULL, NULL FROM z WHERE hops < 30 AND finish NOT IN (SELECT url FROM r)""",
}
