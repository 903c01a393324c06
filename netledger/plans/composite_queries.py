"""Queries of composite operators, and of the streaming ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.operators import contracts as ct
from netledger.plans import ledger
from netledger.plans.common import CLOSED, REOPENED, STRUCTURAL, rounded, table
from netledger.streaming import ledger as stream


def _ledger_events(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k, F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), F.when(k % 5 == 0, "unofficial").when(k % 7 == 0, F.lit(None)).otherwise("official").alias("provenance"),
        F.when(k % 9 == 0, "announced").otherwise("confirmed").alias("status"), F.when(k % 4 != 0, F.col("ts")).alias("confirmed"), F.when(k % 6 != 0, F.col("ts")).alias("planned"), (k % 2 == 0).alias("corroborated"),
        F.when(k % 17 == 0, k - 1).alias("revises"), F.when(k % 23 == 0, k - 2).alias("cancels"), (-F.col("value")).alias("before"), F.col("value").alias("after"),
    )


def _history(series):
    def query(spark, sf_dir):
        out = ledger.build_history(_ledger_events(spark, sf_dir), series, STRUCTURAL, (CLOSED, REOPENED))
        stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
        return out.select("entity", "event_id", stamp("valid_from"), stamp("valid_to"), "state")

    return query


def capture_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("url"), F.date_format("ts", "yyyyMMddHH").alias("captured_at"), (F.col("event_id") % 60).alias("digest"), F.col("event_id").alias("ord"))
    return ledger.captures(e)


def promotion_outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reviews = o.select(F.col("o_orderkey").alias("review_id"), (F.col("o_custkey") % 1000 * 4 + F.col("o_orderkey") % 4).alias("candidate_id"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("accepted").alias("decision"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("at"))
    candidates = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("candidate_id"), F.col("p_size").alias("target"))
    identities = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("target"), (F.col("s_nationkey") % 4).alias("entity"))
    out = ledger.promote(reviews, candidates, identities)
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count("entity").alias("with_entity"))


def _monthly(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    snapshot = o.filter(month != "1995-03").select(month.alias("month"), (F.col("o_custkey") * 91 % 3200).cast("double").alias("x"), (F.col("o_custkey") * 37 % 2600).cast("double").alias("y"))
    k = F.col("s_suppkey")
    grid = table(spark, sf_dir, "supplier").select(k.alias("grid_id"), (k * 53 % 3200).cast("double").alias("x"), (k * 71 % 2600).cast("double").alias("y"), F.lit(2.0).alias("window_area_km2"))
    months = o.select(month.alias("month")).distinct()
    population = grid.crossJoin(F.broadcast(months)).select("month", "grid_id", F.when(F.col("grid_id") % 9 != 0, F.col("grid_id") % 5 * 100.0).alias("population"))  # one row per month
    return ledger.analyze_monthly(snapshot, grid, population, (100.0, 250.0, 500.0))


def analyze_monthly(spark, sf_dir):
    return rounded(_monthly(spark, sf_dir), "nearest", "density", "per_100k")


def frame_colours(spark, sf_dir):
    m = _monthly(spark, sf_dir).filter("radius = 250")
    return ledger.frames(m.select("month", "grid_id", "n"), "n").select("month", "grid_id", "colour")


def quality_report(spark, sf_dir):
    """The overall verdict of gates: missing labels, blank identifiers, empty texts."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    gates = d.agg(F.count_if(F.col("doc_id").isNull()).alias("a"), F.count_if(F.col("text") == "").alias("b"), F.avg(F.when(F.col("quality").isNull(), 1.0).otherwise(0.0)).alias("c"))
    rows = gates.select(F.explode(F.array(F.when(F.col("a") == 0, "pass").otherwise("fail"), F.when(F.col("b") == 0, "pass").otherwise("fail"), F.when(F.col("c").isNull(), "not_evaluable").when(F.col("c") <= 0.9, "pass").otherwise("fail"))).alias("status"))
    return ct.overall(rows)


def stream_counts(spark, sf_dir):
    """Six-hour counts of the events as a stream of files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))
    out = stream.run_available(spark, stream.windowed_counts(events, "at", "event_id", "event_type", "40 days", "6 hours"))
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total"), "total", digits=4)


QUERIES = {f"history_{s}": _history(s) for s in ledger.SERIES} | {
    f.__name__: f for f in (capture_versions, promotion_outcomes, analyze_monthly, frame_colours, quality_report, stream_counts)
}

_LEDGER = """e AS (SELECT event_id, user_id AS entity, event_type AS kind, CASE WHEN event_id % 5 = 0 THEN 'unofficial' ELSE 'official' END AS prov, event_id % 9 <> 0 AS sure,
  CASE WHEN event_id % 4 <> 0 THEN ts END AS c, CASE WHEN event_id % 6 <> 0 THEN ts END AS p, event_id % 2 = 0 AS ok, -value AS bef, value AS aft FROM events),
a AS (SELECT *, CASE WHEN prov = 'official' THEN coalesce(c, CASE WHEN ok THEN p END) ELSE coalesce(c, p) END AS at_time FROM e
  WHERE event_id % 23 <> 0 AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_id % 17 = 0) AND event_id NOT IN (SELECT event_id - 2 FROM events WHERE event_id % 23 = 0))"""


def _history_sql(series: str) -> str:
    formal = "(prov = 'official' AND sure AND at_time IS NOT NULL AND kind IN ('signup', 'purchase'))"
    closing = "(prov = 'official' AND sure AND at_time IS NOT NULL AND kind IN ('error', 'click'))"
    loose = "(prov = 'unofficial' AND at_time IS NOT NULL AND kind IN ('error', 'click'))"
    test = {"formal": formal, "effective_official": f"{formal} OR {closing}", "effective_with_unofficial": f"{formal} OR {closing} OR {loose}"}[series]
    stamp = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"""
WITH {_LEDGER}, k AS (SELECT * FROM a WHERE {test}),
u AS (SELECT entity, event_id, at_time, aft FROM k UNION ALL SELECT entity, NULL, NULL, arg_min(bef, (at_time, event_id)) FROM k GROUP BY entity)
SELECT entity, event_id, {stamp("at_time")} AS valid_from, {stamp("lead(at_time) OVER (PARTITION BY entity ORDER BY at_time NULLS FIRST, event_id)")} AS valid_to, aft AS state FROM u"""


ORACLE_SQL = {f"history_{s}": _history_sql(s) for s in ledger.SERIES} | {
    "capture_versions": """
WITH e AS (SELECT user_id % 40 AS url, strftime(ts, '%Y%m%d%H') AS t, event_id % 60 AS digest, event_id FROM events), f AS (SELECT url, digest, arg_min(t, event_id) AS captured_at FROM e GROUP BY ALL),
l AS (SELECT *, lag(captured_at) OVER (PARTITION BY url ORDER BY captured_at, digest) AS supersedes, count(*) OVER (PARTITION BY url, captured_at) AS n FROM f)
SELECT url, captured_at, digest, supersedes FROM l WHERE n = 1""",
    "promotion_outcomes": """
WITH r AS (SELECT o_custkey % 1000 * 4 + o_orderkey % 4 AS c, o_orderkey % 13 <> 0 AS dated FROM orders WHERE o_orderstatus <> 'P'),
k AS (SELECT p_partkey * 2 AS c, p_size AS t FROM part), i AS (SELECT s_suppkey % 60 AS t, min(s_nationkey % 4) AS a, max(s_nationkey % 4) AS b FROM supplier GROUP BY 1),
o AS (SELECT CASE WHEN count(*) OVER (PARTITION BY c) > 1 THEN 'contradicting_reviews' WHEN t IS NULL THEN 'source_row_missing' WHEN a IS NULL OR a <> b THEN 'entity_not_unique' WHEN NOT dated THEN 'bad_date' ELSE 'promoted' END AS outcome
  FROM r LEFT JOIN k USING (c) LEFT JOIN i USING (t))
SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'promoted') AS with_entity FROM o GROUP BY 1""",
    "quality_report": """
SELECT CASE WHEN count(*) FILTER (doc_id IS NULL) > 0 OR count(*) FILTER (text = '') > 0 OR avg((quality IS NULL)::INT) > 0.9 THEN 'fail' ELSE 'pass' END AS status FROM documents LEFT JOIN labels USING (doc_id)""",
    "stream_counts": """
SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
}

_MONTHLY = """s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, (o_custkey * 91 % 3200)::DOUBLE AS x, (o_custkey * 37 % 2600)::DOUBLE AS y FROM orders),
g AS (SELECT s_suppkey AS grid_id, (s_suppkey * 53 % 3200)::DOUBLE AS x, (s_suppkey * 71 % 2600)::DOUBLE AS y, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 5 * 100.0 END AS population FROM supplier),
d AS (SELECT month, grid_id, sqrt(pow(s.x - g.x, 2) + pow(s.y - g.y, 2)) AS d FROM s, g WHERE month <> '1995-03'),
m AS (SELECT month, grid_id, population, radius, count(d) FILTER (d <= radius) AS k, min(d) FILTER (d <= radius) AS nearest FROM (SELECT * FROM (SELECT DISTINCT month FROM s), g, (VALUES (100.0::DOUBLE), (250.0), (500.0)) AS r(radius)) AS q
  LEFT JOIN d USING (month, grid_id) GROUP BY ALL),
o AS (SELECT *, CASE WHEN month <> '1995-03' THEN k END AS n FROM m)"""

ORACLE_SQL |= {
    "analyze_monthly": f"""
WITH {_MONTHLY} SELECT month, grid_id, radius, n, round(nearest, 6) AS nearest, n / 2.0::DOUBLE AS density, round(n / nullif(population, 0)::DOUBLE * 100000, 6) AS per_100k,
  CASE WHEN n IS NULL THEN 'missing_snapshot_month' WHEN population IS NULL THEN 'population_missing' WHEN population = 0 THEN 'population_zero' ELSE 'pass' END AS status FROM o""",
    "frame_colours": f"""
WITH {_MONTHLY}, f AS (SELECT *, (n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0)::DOUBLE AS t FROM o WHERE radius = 250)
SELECT month, grid_id, '#' || lpad(lower(hex(round_even(247 - 239 * t, 0)::BIGINT)), 2, '0') || lpad(lower(hex(round_even(251 - 203 * t, 0)::BIGINT)), 2, '0') || lpad(lower(hex(round_even(255 - 148 * t, 0)::BIGINT)), 2, '0') AS colour FROM f""",
}
