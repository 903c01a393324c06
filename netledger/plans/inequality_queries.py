"""Queries of inequality measures and weighted quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.operators import inequality as ineq
from netledger.plans.common import UNITS, rounded, table, units

_CUSTOMERS = "SELECT c_mktsegment, c_custkey, greatest(c_acctbal, 0) AS v, (c_custkey % 7 + 1)::DOUBLE AS w FROM customer"


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_mktsegment", "c_custkey", F.greatest("c_acctbal", F.lit(0)).alias("v"), (F.col("c_custkey") % 7 + 1).cast("double").alias("w"))


def gini_pairwise(spark, sf_dir):
    return rounded(ineq.gini_pairwise(_customers(spark, sf_dir), ["c_mktsegment"], "v", "w"), "gini")


def gini_lorenz(spark, sf_dir):
    return rounded(ineq.gini_lorenz(units(spark, sf_dir), ["r_name"], "n", "p"), "gini")


def lorenz_points(spark, sf_dir):
    out = ineq.lorenz(units(spark, sf_dir), [], "n", "p", ("n_nationkey",)).select("n_nationkey", "people_share", "value_share")
    return rounded(out, "people_share", "value_share")


def theil_weighted(spark, sf_dir):
    return rounded(ineq.theil_weighted(_customers(spark, sf_dir), ["c_mktsegment"], "v", "w"), "theil")


def theil_share(spark, sf_dir):
    return rounded(ineq.theil_share(units(spark, sf_dir), ["r_name"], "n", "p"), "theil")


def theil_decomposition(spark, sf_dir):
    return rounded(ineq.theil_decomposition(units(spark, sf_dir), "r_name", "n", "p"), "between", "within", "total")


def hoover(spark, sf_dir):
    return rounded(ineq.hoover(units(spark, sf_dir), ["r_name"], "n", "p"), "hoover")


def weighted_median_by_group(spark, sf_dir):
    return ineq.weighted_median(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")


def quartiles_exclusive(spark, sf_dir):
    return rounded(ineq.quartiles_exclusive(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice"), "q1", "q2", "q3")


def nearest_rank_pct(spark, sf_dir):
    return ineq.nearest_rank(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def distribution_overlap(spark, sf_dir):
    """Share of each segment at or under the median of every other."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    medians = c.groupBy("c_mktsegment").agg(F.percentile("c_acctbal", 0.5).alias("median")).select(F.col("c_mktsegment").alias("other"), "median")
    met = c.join(F.broadcast(medians), F.col("c_mktsegment") != F.col("other"))  # one row per segment
    share = F.avg(F.when(F.col("c_acctbal") <= F.col("median"), 1.0).otherwise(0.0))
    return rounded(met.groupBy("c_mktsegment", "other").agg(share.alias("share")), "share")


QUERIES = {
    f.__name__: f
    for f in (
        gini_pairwise, gini_lorenz, lorenz_points, theil_weighted, theil_share, theil_decomposition, hoover,
        weighted_median_by_group, quartiles_exclusive, nearest_rank_pct, distribution_overlap,
    )
}

ORACLE_SQL = {
    "gini_pairwise": f"""
WITH c AS ({_CUSTOMERS})
SELECT a.c_mktsegment, round(sum(a.w * b.w * abs(a.v - b.v)) / (2 * (SELECT sum(w) FROM c AS k WHERE k.c_mktsegment = a.c_mktsegment)
  * (SELECT sum(w * v) FROM c AS k WHERE k.c_mktsegment = a.c_mktsegment)), 6) AS gini
FROM c AS a JOIN c AS b USING (c_mktsegment) GROUP BY a.c_mktsegment""",
    "gini_lorenz": f"""
WITH {UNITS}, o AS (
  SELECT r_name, p / sum(p) OVER g AS ps, n / sum(n) OVER g AS ns,
    coalesce(sum(n) OVER (g ORDER BY n / p, p, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER g AS before
  FROM units WHERE p > 0 WINDOW g AS (PARTITION BY r_name)
)
SELECT r_name, round(1 - sum(ps * (2 * before + ns)), 6) AS gini FROM o GROUP BY r_name""",
    "lorenz_points": f"""
WITH {UNITS}
SELECT n_nationkey, round(sum(p) OVER o / sum(p) OVER (), 6) AS people_share, round(sum(n) OVER o / sum(n) OVER (), 6) AS value_share
FROM units WHERE p > 0 WINDOW o AS (ORDER BY n / p, p, n, n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "theil_weighted": f"""
WITH c AS ({_CUSTOMERS}), m AS (SELECT c_mktsegment, sum(w * v) / sum(w) AS m, sum(w) AS t FROM c GROUP BY 1)
SELECT c_mktsegment, round(sum(CASE WHEN v > 0 THEN w * (v / m) * ln(v / m) END) / any_value(t), 6) AS theil
FROM c JOIN m USING (c_mktsegment) GROUP BY c_mktsegment""",
    "theil_share": f"""
WITH {UNITS}, t AS (SELECT *, sum(n) OVER (PARTITION BY r_name) AS tn, sum(p) OVER (PARTITION BY r_name) AS tp FROM units WHERE n > 0 AND p > 0)
SELECT r_name, round(sum(n / tn * ln(n / tn / (p / tp))), 6) AS theil FROM t GROUP BY r_name""",
    "theil_decomposition": f"""
WITH {UNITS}, t AS (
  SELECT *, sum(n) OVER () AS an, sum(p) OVER () AS ap, sum(n) OVER g AS tn, sum(p) OVER g AS tp FROM units WHERE n > 0 AND p > 0 WINDOW g AS (PARTITION BY r_name)
), g AS (
  SELECT r_name, any_value(tn) AS tn, any_value(tp) AS tp, any_value(an) AS an, any_value(ap) AS ap, sum(n / tn * ln(n / tn / (p / tp))) AS inner_theil FROM t GROUP BY r_name
)
SELECT round(sum(tn / an * ln(tn / an / (tp / ap))), 6) AS "between", round(sum(tn / an * inner_theil), 6) AS within,
  round(sum(tn / an * ln(tn / an / (tp / ap))) + sum(tn / an * inner_theil), 6) AS total FROM g""",
    "hoover": f"""
WITH {UNITS}, t AS (SELECT r_name, n / nullif(sum(n) OVER g, 0) AS a, p / nullif(sum(p) OVER g, 0) AS b FROM units WINDOW g AS (PARTITION BY r_name))
SELECT r_name, round(sum(abs(a - b)) / 2, 6) AS hoover FROM t GROUP BY r_name""",
    "weighted_median_by_group": """
WITH o AS (
  SELECT l_returnflag, l_linestatus, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS c,
    sum(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) AS t FROM lineitem
)
SELECT l_returnflag, l_linestatus, min(v) AS weighted_median FROM o WHERE c >= t / 2 GROUP BY ALL""",
    "quartiles_exclusive": """
WITH o AS (
  SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders
), j AS (SELECT DISTINCT o_orderpriority, n, i, greatest(1, least(n - 1, i * (n + 1) // 4)) AS j FROM o, range(1, 4) AS t(i)),
q AS (SELECT j.o_orderpriority, j.n, i, (a.v * (4 - (i * (j.n + 1) - 4 * j)) + b.v * (i * (j.n + 1) - 4 * j)) / 4 AS q
  FROM j JOIN o AS a ON a.o_orderpriority = j.o_orderpriority AND a.r = j JOIN o AS b ON b.o_orderpriority = j.o_orderpriority AND b.r = j + 1)
SELECT o_orderpriority, n, round(max(q) FILTER (i = 1), 6) AS q1, round(max(q) FILTER (i = 2), 6) AS q2, round(max(q) FILTER (i = 3), 6) AS q3 FROM q GROUP BY ALL""",
    "nearest_rank_pct": """
WITH o AS (
  SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders
)
SELECT o_orderpriority, max(n) AS n, max(v) FILTER (r = round_even((n - 1) * 0.5, 0) + 1) AS p50,
  max(v) FILTER (r = round_even((n - 1) * 0.9, 0) + 1) AS p90, max(v) FILTER (r = round_even((n - 1) * 0.99, 0) + 1) AS p99
FROM o GROUP BY o_orderpriority""",
    "distribution_overlap": """
WITH m AS (SELECT c_mktsegment AS other, quantile_cont(c_acctbal, 0.5) AS median FROM customer GROUP BY 1)
SELECT c_mktsegment, other, round(avg(CASE WHEN c_acctbal <= median THEN 1.0 ELSE 0.0 END), 6) AS share
FROM customer JOIN m ON c_mktsegment <> other GROUP BY ALL""",
}
