"""Queries of whole studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.plans import spatial_queries, studies
from netledger.plans.common import lat, lon, rounded, table


def accessibility_series(spark, sf_dir):
    """Access of customers to all suppliers, and to those in debt only, by overlapping strata."""
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    places = table(spark, sf_dir, "customer").select(c.alias("lid"), lat(c).alias("lat"), lon(c).alias("lon"), (c % 7 * 10).alias("people"), (c % 7 * (c % 3)).alias("elderly"), "c_nationkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select(k.alias("rid"), lat(k + 0.5).alias("lat"), lon(k + 0.25).alias("lon"), "s_acctbal")
    strata = {"all": F.lit(True), "low": F.col("c_nationkey") < 10, "building": F.col("c_mktsegment") == "BUILDING"}
    bands = (50_000, 100_000, 200_000)
    out = studies.accessibility(places, {"all": s.drop("s_acctbal"), "rich": s.filter("s_acctbal > 4000").drop("s_acctbal")}, strata, bands)
    return rounded(out, "mean_m", "median_m", *[f"cov_{b}" for b in bands], digits=4)


def spatial_summary(spark, sf_dir):
    points = spatial_queries._customers(spark, sf_dir).select(F.col("lid").alias("id"), "x", "y", "v", "c_nationkey")
    return rounded(studies.spatial_statistics(points, ["c_nationkey"], 4, 400.0, 19), "moran", "expected", "z_perm")


def change_frames(spark, sf_dir):
    """Orders of each nation's customers by month, against the first month; one month is taken as missing."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell"))
    counts = o.filter("month <> '1996-05'").join(c, "o_custkey").groupBy("month", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"))
    return studies.change_frames(counts, o.select("month"), cells, "1995-03")


def moving_counts(spark, sf_dir):
    """Suppliers' lines as positions that hold from one order date to another: counts and classes of change in
    the cells around nations' places at every month's end; two months are missing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    k = F.col("o_orderkey")
    at = lambda n: F.when(k % 13 != n, F.date_add("day", (k * 7 % 900).cast("int")))
    positions = o.select((k * 37 % 500).cast("double").alias("x"), F.when(k % 17 != 0, (k * 91 % 500).cast("double")).alias("y"), F.when(k % 13 != 0, F.col("day")).alias("valid_from"), at(1).alias("valid_to"))
    n = F.col("n_nationkey")
    cells = table(spark, sf_dir, "nation").select(n.alias("cell"), (n * 71 % 500).cast("double").alias("x"), (n * 113 % 500).cast("double").alias("y"))
    months = o.select(F.trunc("day", "month").alias("month")).distinct()
    out = studies.change_over_time(positions, cells, months, months.filter("month IN (DATE '1996-05-01', DATE '1998-01-01')"), F.lit("1995-03-01").cast("date"), 60.0)
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


def corrected_access(spark, sf_dir):
    """Access of customers before and after, under three policies for the suppliers' places."""
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    places = table(spark, sf_dir, "customer").select(c.alias("lid"), lat(c).alias("lat"), lon(c).alias("lon"), (c % 7 * 10).alias("people"), "c_nationkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier")
    place = lambda a, b: [k.alias("rid"), lat(k + a).alias("lat"), lon(k + b).alias("lon")]
    accuracy = F.when(k % 4 == 0, "block").when(k % 4 == 1, "city").otherwise("town")
    strata = {"all": F.lit(True), "low": F.col("c_nationkey") < 10, "building": F.col("c_mktsegment") == "BUILDING", "none": F.lit(False)}
    out = studies.corrected_access(
        places, s.select(*place(0.5, 0.25), accuracy.alias("accuracy")), s.filter("s_suppkey % 3 <> 0").select(*place(0.625, 0.375)), s.filter("s_suppkey % 5 = 0").select(k.alias("rid")),
        s.filter("s_suppkey % 7 <> 0").select(*place(0.75, 0.5)), strata, 60_000.0)
    return rounded(out, "mean_before", "mean_after", "mean_change", "far_change", digits=4)


QUERIES = {f.__name__: f for f in (accessibility_series, spatial_summary, change_frames, moving_counts, corrected_access)}

_FAR = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(p.lon)) / 2), 2))))"
_BANDS = (50_000, 100_000, 200_000)

ORACLE_SQL = {
    "accessibility_series": f"""
WITH p AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment, 20 + (c_custkey * 37 % 2600) / 100 AS lat, 122 + (c_custkey * 91 % 3200) / 100 AS lon, c_custkey % 7 * 10 AS people, c_custkey % 7 * (c_custkey % 3) AS elderly FROM customer),
s AS (SELECT 20 + ((s_suppkey + 0.5::DOUBLE) * 37 % 2600) / 100 AS lat, 122 + ((s_suppkey + 0.25::DOUBLE) * 91 % 3200) / 100 AS lon, s_acctbal > 4000 AS rich FROM supplier),
n AS (SELECT id, 'all' AS series, min({_FAR}) AS d FROM p, s GROUP BY 1 UNION ALL SELECT id, 'rich', min({_FAR}) FROM p, s WHERE rich GROUP BY 1),
t AS (SELECT id, people, elderly, unnest(list_filter(['all', CASE WHEN c_nationkey < 10 THEN 'low' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END], lambda x: x IS NOT NULL)) AS stratum FROM p),
d AS (SELECT * FROM t JOIN n USING (id)),
c AS (SELECT series, stratum, d, sum(people) OVER (PARTITION BY series, stratum ORDER BY d RANGE UNBOUNDED PRECEDING) AS upto, sum(people) OVER (PARTITION BY series, stratum) AS whole FROM d WHERE people > 0),
h AS (SELECT series, stratum, min(d) FILTER (2 * upto >= whole) AS median FROM c GROUP BY ALL),
g AS (SELECT series, stratum, sum(people)::BIGINT AS people, sum(d * people) AS dp, {", ".join(f"coalesce(sum(people) FILTER (d <= {b}), 0) AS b{b}" for b in _BANDS)},
  coalesce(sum(people) FILTER (d > 2000), 0)::BIGINT AS over2km, coalesce(sum(elderly) FILTER (d > 2000), 0)::BIGINT AS over2km_elderly FROM d GROUP BY ALL)
SELECT series, stratum, 'computed' AS status, NULL::VARCHAR AS reason, people, round(dp / people, 4) AS mean_m, {", ".join(f"round(b{b} / people * 100, 4) AS cov_{b}" for b in _BANDS)},
  over2km, over2km_elderly, round(median, 4) AS median_m FROM g JOIN h USING (series, stratum)""",
    "spatial_summary": f"SELECT * FROM ({spatial_queries.ORACLE_SQL['moran_permutation']}) AS m JOIN ({spatial_queries.ORACLE_SQL['hot_cold_counts']}) AS h USING (c_nationkey)",
    "change_frames": """
WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders), k AS (SELECT month, c_nationkey AS cell, count(*) AS n FROM o JOIN customer ON o_custkey = c_custkey WHERE month <> '1996-05' GROUP BY ALL),
f AS (SELECT m.month, n_nationkey AS cell, CASE WHEN m.month IN (SELECT month FROM k) THEN coalesce(k.n, 0) END AS n, b.n AS b FROM (SELECT DISTINCT month FROM o) AS m CROSS JOIN nation
  LEFT JOIN k ON k.month = m.month AND k.cell = n_nationkey LEFT JOIN k AS b ON b.month = '1995-03' AND b.cell = n_nationkey),
x AS (SELECT *, (n - b) / nullif(b, 0)::DOUBLE * 100 AS x FROM f)
SELECT month, cell, n, CASE WHEN n IS NULL THEN 8 WHEN x IS NULL THEN 7 WHEN x > 5 THEN 6 WHEN x > 0.001 THEN 5 WHEN x > -0.001 THEN 4 WHEN x > -5 THEN 3 WHEN x > -10 THEN 2 WHEN x > -20 THEN 1 ELSE 0 END AS class FROM x""",
    "moving_counts": """
WITH p AS (SELECT o_orderkey * 37 % 500 AS x, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey * 91 % 500 END AS y, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS vf,
  CASE WHEN o_orderkey % 13 <> 1 THEN o_orderdate::DATE + (o_orderkey * 7 % 900)::INT END AS vt FROM orders),
m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders), c AS (SELECT n_nationkey AS cell, n_nationkey * 71 % 500 AS x, n_nationkey * 113 % 500 AS y FROM nation),
k AS (SELECT month, cell, count(vf IS NULL) FILTER (p.x IS NOT NULL) AS n FROM m CROSS JOIN c LEFT JOIN p ON (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 3600 AND coalesce(vf <= last_day(month), true) AND coalesce(vt > last_day(month), true) GROUP BY ALL),
f AS (SELECT k.month, cell, CASE WHEN k.month NOT IN (DATE '1996-05-01', DATE '1998-01-01') THEN k.n END AS n, b.n AS b FROM k JOIN (SELECT cell, n FROM k WHERE month = DATE '1995-03-01') AS b USING (cell)),
x AS (SELECT *, (n - b) / nullif(b, 0)::DOUBLE * 100 AS x FROM f)
SELECT strftime(month, '%Y-%m') AS month, cell, n, CASE WHEN n IS NULL THEN 8 WHEN x IS NULL THEN 7 WHEN x > 5 THEN 6 WHEN x > 0.001 THEN 5 WHEN x > -0.001 THEN 4 WHEN x > -5 THEN 3 WHEN x > -10 THEN 2 WHEN x > -20 THEN 1 ELSE 0 END AS class FROM x""",
    "corrected_access": f"""
WITH p AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment, 20 + (c_custkey * 37 % 2600) / 100 AS lat, 122 + (c_custkey * 91 % 3200) / 100 AS lon, c_custkey % 7 * 10 AS people FROM customer WHERE c_custkey % 7 > 0),
o AS (SELECT s_suppkey AS k, s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS rough, s_suppkey % 5 = 0 AS moved FROM supplier),
q AS (SELECT 'current' AS series, k, 0.5 AS a, 0.25 AS b FROM o UNION ALL SELECT 'inherit_all', k, CASE WHEN rough THEN 0.625 ELSE 0.5 END, CASE WHEN rough THEN 0.375 ELSE 0.25 END FROM o
  UNION ALL SELECT 'corrected', k, CASE WHEN rough AND NOT moved THEN 0.625 ELSE 0.5 END, CASE WHEN rough AND NOT moved THEN 0.375 ELSE 0.25 END FROM o UNION ALL SELECT 'before', k, 0.75, 0.5 FROM o WHERE k % 7 <> 0),
s AS (SELECT series, 20 + ((k + a::DOUBLE) * 37 % 2600) / 100 AS lat, 122 + ((k + b::DOUBLE) * 91 % 3200) / 100 AS lon FROM q),
d AS (SELECT id, series, min({_FAR}) AS d FROM p, s GROUP BY ALL),
t AS (SELECT id, people, unnest(list_filter(['all', CASE WHEN c_nationkey < 10 THEN 'low' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END], lambda x: x IS NOT NULL)) AS stratum FROM p),
g AS (SELECT x.series, stratum, sum(people)::BIGINT AS people, sum(y.d * people) / sum(people) AS m0, sum(x.d * people) / sum(people) AS m1, coalesce(sum(people) FILTER (y.d > 60000), 0)::BIGINT AS f0, coalesce(sum(people) FILTER (x.d > 60000), 0)::BIGINT AS f1
  FROM t JOIN d AS x USING (id) JOIN d AS y USING (id) WHERE x.series <> 'before' AND y.series = 'before' GROUP BY ALL)
SELECT series, stratum, 'computed' AS status, people, round(m0, 4) AS mean_before, round(m1, 4) AS mean_after, round(m1 - m0, 4) AS mean_change, f0 AS far_before, f1 AS far_after, round((f1 - f0) * 100 / nullif(f0, 0)::DOUBLE, 4) AS far_change FROM g""",
}
