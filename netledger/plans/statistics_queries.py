"""Queries of counts, rates, rollups, histograms, gates, extremes and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.operators import statistics as stats
from netledger.plans.common import UNITS, rounded, table, units


def _unit_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey")


_UNIT_ORDERS = "SELECT c_nationkey, o_orderstatus, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey"


def unit_counts_formal_effective(spark, sf_dir):
    """Formal (all) and effective (not pending) counts of two years per unit, with labels."""
    years = {"1996": F.col("y") == 1996, "2000": F.col("y") == 2000}
    kinds = {"formal": F.lit(True), "effective": F.col("o_orderstatus") != "P"}
    counts = stats.counts_by(_unit_orders(spark, sf_dir), ["c_nationkey"], {f"{k}_{y}": years[y] & kinds[k] for y in years for k in kinds})
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return stats.with_labels(labels, counts, ["c_nationkey"])


def zero_units(spark, sf_dir):
    """Units without a facility of high balance, and how many facilities they have at all."""
    suppliers = table(spark, sf_dir, "supplier")
    all_units = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rich = suppliers.filter("s_acctbal > 7500").select(F.col("s_nationkey").alias("n_nationkey"))
    any_of = suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("facilities"))
    return stats.with_labels(all_units.join(rich, "n_nationkey", "left_anti"), any_of, ["n_nationkey"])


def group_rates_by_definition(spark, sf_dir):
    """Change rates of overlapping groups of units, per definition and side."""
    u = units(spark, sf_dir).select("n_nationkey", "p")
    counts = stats.counts_by(_unit_orders(spark, sf_dir), ["c_nationkey"], {"a": F.col("y") == 1996, "b": F.col("y") == 2000})
    u = u.join(counts.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", "left")
    k = F.col("n_nationkey")
    definitions = {"even": k % 2 == 0, "low": k < 10, "third": k % 3 == 0, "all": F.lit(True)}
    return rounded(stats.rates_by_definition(u, definitions, "a", "b", "p"), "rate", "per_head")


def region_rollup_share(spark, sf_dir):
    """People and facilities per region and in all, with shares and facilities per 10,000 people."""
    return rounded(stats.rollup_share(units(spark, sf_dir), "r_name", "n", "p"), "share", "per_10k")


def _months(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("month"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


_MONTHS = "SELECT strftime(o_orderdate, '%Y-%m-01') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1"


def month_delta(spark, sf_dir):
    return stats.change_to_previous(_months(spark, sf_dir), [], "month", "n")


def relative_change_null_base(spark, sf_dir):
    """Percent change of pending orders to the month before; null on a zero base."""
    out = stats.change_to_previous(_months(spark, sf_dir), [], "month", "pending")
    return rounded(out.select("month", "pending", stats.relative_change(F.col("previous"), F.col("pending")).alias("percent")), "percent")


def class_histogram(spark, sf_dir):
    """Classes of percent change of pending orders to the month before: counts, shares, and the share
    of that class or a lower one. The first month has no month before it."""
    out = stats.change_to_previous(_months(spark, sf_dir), [], "month", "pending")
    change = stats.relative_change(F.col("previous"), F.col("pending"))
    return rounded(stats.class_histogram(out.select(stats.change_class(change, F.col("previous").isNull()).alias("class")), "class"), "share", "tail_share")


def top_k_decliners(spark, sf_dir):
    return stats.extremes(_changes(spark, sf_dir), "delta", ["c_nationkey"], lowest=12)


def both_ends(spark, sf_dir):
    return stats.extremes(_changes(spark, sf_dir), "delta", ["c_nationkey"], lowest=6, highest=3)


def _changes(spark, sf_dir):
    c = stats.counts_by(_unit_orders(spark, sf_dir), ["c_nationkey"], {"a": F.col("y") == 1996, "b": F.col("y") == 2000})
    return c.select("c_nationkey", (F.col("b") - F.col("a")).alias("delta"))


def spine_gaps(spark, sf_dir):
    """Days between a user's first and last event on which there was none."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return stats.gaps(e, ["user_id"], "day").select("user_id", F.col("day").cast("string").alias("day"))


def sampling_gate(spark, sf_dir):
    """Required and available sample of each language and the verdict on missing labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return stats.sampling_gate(joined, ["lang"], F.col("quality").isNotNull())


def reason_counts(spark, sf_dir):
    """Rows per reason, where a row may have several, and how many rows have any."""
    li = table(spark, sf_dir, "lineitem")
    reasons = {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "discounted": F.col("l_discount") > 0.05, "bulk": F.col("l_quantity") >= 45}
    return stats.reason_counts(li, reasons)


def error_summary(spark, sf_dir):
    """Size, mean, largest and over-threshold counts of account balances by segment."""
    c = table(spark, sf_dir, "customer")
    v = F.col("c_acctbal")
    out = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v > 5000).alias("over_5000"))
    return rounded(out, "mean", "median")


def serial_continuity(spark, sf_dir):
    """Orders whose line numbers aren't 1 to n, each once."""
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("distinct_n"), F.min("l_linenumber").alias("least"), F.max("l_linenumber").alias("most"))
    return out.withColumn("continuous", (F.col("n") == F.col("distinct_n")) & (F.col("least") == 1) & (F.col("most") == F.col("n"))).groupBy("continuous").agg(F.count(F.lit(1)).alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        unit_counts_formal_effective, zero_units, group_rates_by_definition, region_rollup_share, month_delta, relative_change_null_base,
        class_histogram, top_k_decliners, both_ends, spine_gaps, sampling_gate, reason_counts, error_summary, serial_continuity,
    )
}

_DELTA = f"WITH u AS ({_UNIT_ORDERS}), c AS (SELECT c_nationkey, count(*) FILTER (y = 2000) - count(*) FILTER (y = 1996) AS delta FROM u GROUP BY 1)"

ORACLE_SQL = {
    "unit_counts_formal_effective": f"""
WITH u AS ({_UNIT_ORDERS})
SELECT n_nationkey AS c_nationkey, n_name AS label, count(*) FILTER (y = 1996) AS formal_1996, count(*) FILTER (y = 1996 AND o_orderstatus <> 'P') AS effective_1996,
  count(*) FILTER (y = 2000) AS formal_2000, count(*) FILTER (y = 2000 AND o_orderstatus <> 'P') AS effective_2000
FROM nation LEFT JOIN u ON c_nationkey = n_nationkey GROUP BY ALL""",
    "zero_units": """
SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS facilities FROM nation
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7500)""",
    "group_rates_by_definition": f"""
WITH {UNITS}, o AS ({_UNIT_ORDERS}), c AS (SELECT c_nationkey, count(*) FILTER (y = 1996) AS a, count(*) FILTER (y = 2000) AS b FROM o GROUP BY 1),
u AS (SELECT n_nationkey AS k, p, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM units LEFT JOIN c ON c_nationkey = n_nationkey),
d AS (SELECT 'even' AS definition, k % 2 = 0 AS side, * FROM u UNION ALL SELECT 'low', k < 10, * FROM u UNION ALL SELECT 'third', k % 3 = 0, * FROM u UNION ALL SELECT 'all', true, * FROM u)
SELECT definition, side, count(*) AS units, sum(p)::BIGINT AS people, sum(a)::BIGINT AS before, sum(b)::BIGINT AS after,
  round((sum(b) - sum(a)) / nullif(sum(a), 0) * 100, 6) AS rate, round(sum(p) / nullif(sum(b), 0), 6) AS per_head FROM d GROUP BY ALL""",
    "region_rollup_share": f"""
WITH {UNITS}
SELECT r_name, sum(n)::BIGINT AS facilities, sum(p)::BIGINT AS people, round(sum(n) / (SELECT sum(n) FROM units), 6) AS share, round(sum(n) / nullif(sum(p), 0) * 10000, 6) AS per_10k
FROM units GROUP BY ROLLUP (r_name)""",
    "month_delta": f"WITH m AS ({_MONTHS}) SELECT month, n, lag(n) OVER (ORDER BY month) AS previous, n - lag(n) OVER (ORDER BY month) AS delta FROM m",
    "relative_change_null_base": f"""
WITH m AS ({_MONTHS}) SELECT month, pending, round((pending - lag(pending) OVER o) / nullif(lag(pending) OVER o, 0)::DOUBLE * 100, 6) AS percent FROM m WINDOW o AS (ORDER BY month)""",
    "class_histogram": f"""
WITH m AS ({_MONTHS}), p AS (SELECT pending, lag(pending) OVER (ORDER BY month) AS b FROM m), c AS (SELECT b, (pending - b) / nullif(b, 0)::DOUBLE * 100 AS x FROM p),
k AS (SELECT CASE WHEN b IS NULL THEN 8 WHEN x IS NULL THEN 7 WHEN x > 5 THEN 6 WHEN x > 0.001 THEN 5 WHEN x > -0.001 THEN 4 WHEN x > -5 THEN 3 WHEN x > -10 THEN 2 WHEN x > -20 THEN 1 ELSE 0 END AS class FROM c),
g AS (SELECT class, count(*) AS n FROM k GROUP BY 1)
SELECT class, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY class) / sum(n) OVER (), 6) AS tail_share FROM g""",
    "top_k_decliners": f"{_DELTA} SELECT c_nationkey, delta, row_number() OVER (ORDER BY delta, c_nationkey) AS place, 'lowest' AS side FROM c QUALIFY place <= 12",
    "both_ends": f"""{_DELTA}
SELECT c_nationkey, delta, row_number() OVER (ORDER BY delta, c_nationkey) AS place, 'lowest' AS side FROM c QUALIFY place <= 6
UNION ALL SELECT c_nationkey, delta, row_number() OVER (ORDER BY delta DESC, c_nationkey) AS place, 'highest' AS side FROM c QUALIFY place <= 3""",
    "spine_gaps": """
WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), s AS (
  SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e GROUP BY user_id)
SELECT user_id, day::VARCHAR AS day FROM s ANTI JOIN e USING (user_id, day)""",
    "sampling_gate": """
WITH g AS (SELECT lang, count(*) AS n, count(quality) AS have FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
r AS (SELECT *, least(n, greatest(200, ceil(n * 0.05)))::BIGINT AS required FROM g)
SELECT lang, n, have, required, CASE WHEN n = 0 THEN 'not_evaluable' WHEN have >= required THEN 'pass' ELSE 'fail' END AS status FROM r""",
    "reason_counts": """
SELECT 'returned' AS reason, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'open', count(*) FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT 'discounted', count(*) FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 'bulk', count(*) FROM lineitem WHERE l_quantity >= 45""",
    "error_summary": """
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, min(c_acctbal) AS least, max(c_acctbal) AS most,
  count(*) FILTER (c_acctbal > 5000) AS over_5000 FROM customer GROUP BY 1""",
    "serial_continuity": """
WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1)
SELECT n = d AND a = 1 AND b = n AS continuous, count(*) AS orders FROM g GROUP BY 1""",
}
