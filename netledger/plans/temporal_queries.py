"""Queries of the event ledger: intervals, replay, versions, deduplication, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.operators import temporal as tm
from netledger.operators.statistics import exact_mean
from netledger.plans.common import CLOSED, REOPENED, STRUCTURAL, table

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")


def _text(c):
    return F.date_format(c, _STAMP)


def dedupe_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return tm.keep_first(d, ["digest"], ["doc_id"]).select("doc_id", "kept", "duplicate_of")


def scd2_intervals(spark, sf_dir):
    e = _events(spark, sf_dir).filter(F.col("event_type").isin(*STRUCTURAL))
    out = tm.intervals(e, "user_id", "ts", "event_id", F.col("value"))
    return out.select("user_id", "event_id", _text("valid_from").alias("valid_from"), _text("valid_to").alias("valid_to"), F.col("state"))


def asof_version(spark, sf_dir):
    """For each error, the amount of the purchase that was the user's last, or else the first."""
    e = _events(spark, sf_dir)
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("value").alias("amount"), F.col("event_id").alias("purchase"))
    return tm.as_of(errors, bought, "user_id", "ts", "bought_at", ["amount", "purchase"], "purchase").select("event_id", "user_id", "amount", "purchase")


def _replay(spark, sf_dir, anchor, cutoffs):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("entity"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("kind"), (-F.col("value")).alias("before"), F.col("value").alias("after"))
    anchors = e.select("entity").distinct().select("entity", F.lit(anchor).cast("timestamp_ntz").alias("anchor_at"), F.lit(0.0).alias("state"), F.lit(True).alias("available"))
    days = spark.createDataFrame([(c,) for c in cutoffs], "c string").select(F.col("c").cast("timestamp_ntz").alias("cutoff"))
    out = tm.replay(e, anchors, days, STRUCTURAL, CLOSED, REOPENED)
    return out.select("entity", _text("cutoff").alias("cutoff"), "state", "available")


def replay_forward(spark, sf_dir):
    return _replay(spark, sf_dir, "2024-01-10", ["2024-01-20"])


def replay_backward(spark, sf_dir):
    return _replay(spark, sf_dir, "2024-01-20", ["2024-01-10"])


def monthly_snapshots(spark, sf_dir):
    """A snapshot of every entity at the end of each of several periods around the anchor."""
    return _replay(spark, sf_dir, "2024-01-15", ["2024-01-05", "2024-01-10", "2024-01-15", "2024-01-20", "2024-01-31"])


def date_basis_counts(spark, sf_dir):
    """Date basis of purchases: observed if the value is high, planned if the id says corroborated."""
    e = _events(spark, sf_dir)
    confirmed, planned, ok = F.when(F.col("value") > 60, F.col("ts")), F.when(F.col("event_id") % 3 != 0, F.col("ts")), F.col("event_id") % 2 == 0
    out = e.select("user_id", tm.date_basis(confirmed, planned, ok).alias("basis"), tm.effective_date(confirmed, planned, ok).alias("effective"))
    counts = out.groupBy("user_id").agg(
        F.count_if(F.col("basis") == "observed").alias("observed"), F.count_if(F.col("basis") == "planned").alias("planned"),
        F.count_if(F.col("basis") == "unknown").alias("unknown"), F.count("effective").alias("applied"),
    )
    return counts.withColumn("label", tm.basis_label(F.col("observed"), F.col("planned")))


def version_upsert(spark, sf_dir):
    return tm.version_upsert(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "supersedes", "is_current")


def first_wins_classification(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), "event_type", "value", "ts")
    tests = [("future", F.col("ts") > F.lit("2024-01-28").cast("timestamp_ntz")), ("stale", F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")), ("reopened", F.col("event_type") == "click"), ("terminated", F.col("event_type") == "error"), ("listed", F.col("value") > 50)]
    return tm.first_wins(e, "user_id", ["ts", "event_id"], tests, "unlisted").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def continuity_breaks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    out = tm.continuity_breaks(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"})
    return out.select("o_orderkey", F.array_join("breaks", ",").alias("breaks"))


def carry_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marker = F.when(F.col("role").isin("user", "system"), F.md5("text"))
    return tm.carry_forward(c, ["conv_id"], ["turn"], marker).select("conv_id", "turn", "carried")


def date_observation_index(spark, sf_dir):
    """Users and the one day of their errors; several days are a conflict."""
    e = _events(spark, sf_dir).filter("event_type = 'error'").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return tm.observation_index(e, "user_id", "day")


def terminal_event(spark, sf_dir):
    """The last event of each user before a day."""
    e = _events(spark, sf_dir).filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def position_moved(spark, sf_dir):
    """Per day, users whose rounded mean value differs from that of their previous day with events."""
    e = _events(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(exact_mean("value"), 0).alias("spot"))
    moved = tm.continuity_breaks(e, ["user_id"], ["day"], {"spot": "spot"})
    return moved.groupBy("day").agg(F.count(F.lit(1)).alias("moved"))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_keep_first, scd2_intervals, asof_version, replay_forward, replay_backward, monthly_snapshots, date_basis_counts, version_upsert,
        first_wins_classification, continuity_breaks, carry_forward, date_observation_index, terminal_event, position_moved,
    )
}


def _replay_sql(anchor: str, cutoffs: list[str]) -> str:
    days = ", ".join(f"(TIMESTAMP '{c}')" for c in cutoffs)
    a = f"TIMESTAMP '{anchor}'"
    ahead, behind = f"ts > {a} AND ts <= cutoff", f"ts > cutoff AND ts <= {a}"
    s, c = "event_type IN ('signup', 'purchase')", "event_type IN ('error', 'click')"
    return f"""
WITH k AS (SELECT * FROM (VALUES {days}) AS v(cutoff)), g AS (
  SELECT user_id, cutoff,
    arg_max(value, (ts, event_id)) FILTER ({ahead} AND {s}) AS f, arg_min(-value, (ts, event_id)) FILTER ({behind} AND {s}) AS b,
    arg_max(event_type, (ts, event_id)) FILTER ({ahead} AND {c}) AS l, arg_min(event_type, (ts, event_id)) FILTER ({behind} AND {c}) AS e
  FROM events, k GROUP BY ALL
)
SELECT user_id AS entity, strftime(cutoff, '%Y-%m-%d %H:%M:%S.%f') AS cutoff, coalesce(CASE WHEN cutoff >= {a} THEN f ELSE b END, 0.0) AS state,
  coalesce(CASE WHEN cutoff >= {a} THEN l = 'click' ELSE e = 'error' END, true) AS available FROM g"""


ORACLE_SQL = {
    "dedupe_keep_first": """
SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicate_of FROM documents""",
    "scd2_intervals": """
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from,
  strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS valid_to, value AS state
FROM events WHERE event_type IN ('signup', 'purchase')""",
    "asof_version": """
WITH p AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT e.event_id, e.user_id,
  coalesce((SELECT arg_max(value, (p.ts, p.event_id)) FROM p WHERE p.user_id = e.user_id AND p.ts <= e.ts), (SELECT arg_min(value, (p.ts, p.event_id)) FROM p WHERE p.user_id = e.user_id AND p.ts > e.ts)) AS amount,
  coalesce((SELECT arg_max(event_id, (p.ts, p.event_id)) FROM p WHERE p.user_id = e.user_id AND p.ts <= e.ts), (SELECT arg_min(event_id, (p.ts, p.event_id)) FROM p WHERE p.user_id = e.user_id AND p.ts > e.ts)) AS purchase
FROM e""",
    "replay_forward": _replay_sql("2024-01-10", ["2024-01-20"]),
    "replay_backward": _replay_sql("2024-01-20", ["2024-01-10"]),
    "monthly_snapshots": _replay_sql("2024-01-15", ["2024-01-05", "2024-01-10", "2024-01-15", "2024-01-20", "2024-01-31"]),
    "date_basis_counts": """
WITH b AS (SELECT user_id, CASE WHEN value > 60 THEN 'observed' WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'planned' ELSE 'unknown' END AS basis FROM events),
c AS (SELECT user_id, count(*) FILTER (basis = 'observed') AS observed, count(*) FILTER (basis = 'planned') AS planned, count(*) FILTER (basis = 'unknown') AS unknown,
  count(*) FILTER (basis <> 'unknown') AS applied FROM b GROUP BY 1)
SELECT *, CASE WHEN observed > 0 AND planned > 0 THEN 'mixed' WHEN observed > 0 THEN 'observed' WHEN planned > 0 THEN 'planned' ELSE 'none_applied' END AS label FROM c""",
    "version_upsert": """
WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), k AS (SELECT * FROM l WHERE b IS DISTINCT FROM event_type)
SELECT user_id, event_id, event_type, lag(event_id) OVER w AS supersedes, lead(event_id) OVER w IS NULL AS is_current FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "first_wins_classification": """
WITH e AS (SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, event_type, value, ts FROM events),
v AS (SELECT event_id, CASE WHEN user_id IS NULL THEN 'unresolved' WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 'duplicate'
  WHEN ts > TIMESTAMP '2024-01-28' THEN 'future' WHEN ts < TIMESTAMP '2024-01-02' THEN 'stale' WHEN event_type = 'click' THEN 'reopened' WHEN event_type = 'error' THEN 'terminated'
  WHEN value > 50 THEN 'listed' ELSE 'unlisted' END AS verdict FROM e)
SELECT verdict, count(*) AS n, min(event_id) AS first_event FROM v GROUP BY 1""",
    "continuity_breaks": """
WITH l AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, lead(o_orderstatus) OVER w AS ns, lead(o_orderpriority) OVER w AS np, lead(1) OVER w AS has FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, concat_ws(',', CASE WHEN s IS DISTINCT FROM ns THEN 'o_orderstatus' END, CASE WHEN p IS DISTINCT FROM np THEN 'o_orderpriority' END) AS breaks
FROM l WHERE has = 1 AND (s IS DISTINCT FROM ns OR p IS DISTINCT FROM np)""",
    "carry_forward": """
SELECT conv_id, turn, last_value(CASE WHEN role IN ('user', 'system') THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations""",
    "date_observation_index": """
WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error')
SELECT user_id, CASE WHEN count(DISTINCT day) = 1 THEN min(day) END AS day, count(DISTINCT day) > 1 AS conflict FROM d GROUP BY 1""",
    "terminal_event": """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1""",
    "position_moved": """
WITH g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 0) AS spot FROM events GROUP BY ALL), l AS (SELECT *, lead(spot) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM g)
SELECT day, count(*) AS moved FROM l WHERE nxt IS NOT NULL AND nxt <> spot GROUP BY 1""",
}
