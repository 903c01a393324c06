"""Queries of geocoding, coordinate policies, threads of states, and wide summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.operators import geocoding as gc, temporal as tm
from netledger.plans.common import lat, lon, rounded, table


def _blocks(spark, sf_dir):
    """Lines as street blocks: a part's type is the town, its brand the region."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", (lat(F.col("l_orderkey"))).alias("lat"), lon(F.col("l_orderkey")).alias("lon"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("region"), F.col("p_type").alias("town"), F.col("p_size").alias("block"))
    return li.join(p, "p_partkey")


def block_means(spark, sf_dir):
    """Mean places of the blocks that some part of size 7 needs, without deleted lines."""
    wanted = table(spark, sf_dir, "part").filter("p_size % 7 = 0").select(F.col("p_brand").alias("region"), F.col("p_type").alias("town"), F.col("p_size").alias("block"))
    return rounded(gc.wanted_means(_blocks(spark, sf_dir), wanted, ["region", "town", "block"], F.col("l_linenumber") == 3), "lat", "lon")


_TOWN = "element_at(array('abcd', 'xabc', 'zzabcz', 'cq', 'q', 'hello', 'abc', 'ecd'), cast(c_custkey % 8 + 1 as int))"


def town_match(spark, sf_dir):
    """Towns of customers by the best of exact, prefix, suffix, inner and first-character matches."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("aid"), F.col("c_mktsegment").alias("region"), F.expr(_TOWN).alias("town"))
    towns = c.select("region").distinct().select("region", F.explode(F.array(*map(F.lit, ("abc", "ab", "cd", "h")))).alias("key"))
    return gc.match_towns(c, towns, "region")


def geocode_cascade(spark, sf_dir):
    """Coordinates of parts from their block, their town, their region, or none, counted by accuracy."""
    b = _blocks(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("region"), F.col("p_type").alias("town"), F.col("p_size").alias("block"))
    exact = gc.point_means(b.filter("block % 3 = 0"), ["region", "town", "block"])
    town = gc.point_means(b.filter("block % 3 = 1"), ["region", "town"])
    region = gc.point_means(b.filter("region <> 'Brand#11'"), ["region"])
    keyed = lambda d, keys: parts.join(d, keys).select("p_partkey", "lat", "lon")
    out = gc.assemble(parts, "p_partkey", [("block", keyed(exact, ["region", "town", "block"])), ("town", keyed(town, ["region", "town"])), ("city", keyed(region, ["region"]))])
    return rounded(out.groupBy("accuracy").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "lat", "lon")


def series_fan_out(spark, sf_dir):
    """Customers in each of several overlapping series, with QA flags counted."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    series = gc.series_of({"formal": F.lit(True), "effective": F.col("c_acctbal") > 0, "block_only": k % 3 == 0, "inherited": k % 3 == 1})
    flags = gc.quality_flags({"negative": F.col("c_acctbal") < 0, "large": F.col("c_acctbal") > 9000})
    return c.select(F.explode(series).alias("series"), flags.alias("flags")).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("flags")).alias("flags"))


def coordinate_policies(spark, sf_dir):
    """The same customers under three coordinate policies: how many have a place, and its mean."""
    k = F.col("c_custkey")
    old_lat, old_lon, new_lat, new_lon = F.when(k % 4 != 0, lat(k)), F.when(k % 4 != 0, lon(k)), F.when(k % 3 != 0, lat(k + 1)), F.when(k % 3 != 0, lon(k + 1))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    out = gc.policies(c, {"current": (new_lat, new_lon), "inherit": (F.coalesce(old_lat, new_lat), F.coalesce(old_lon, new_lon)), "corrected": (F.when(k % 5 == 0, new_lat).otherwise(F.coalesce(old_lat, new_lat)), F.when(k % 5 == 0, new_lon).otherwise(F.coalesce(old_lon, new_lon)))})
    return rounded(out.groupBy("policy").agg(F.count("lat").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "lat", "lon")


def wide_unit_summary(spark, sf_dir):
    """Per unit, the mean and the share over a bound of several series, as one wide row."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    measures = []
    for s in ("F", "O", "P"):
        v = F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))
        measures += [F.avg(v).alias(f"mean_{s}"), F.avg(F.when(v > 100_000, 1.0).when(v.isNotNull(), 0.0)).alias(f"share_over_{s}")]
    return rounded(o.groupBy("c_nationkey").agg(*measures), *[f"{m}_{s}" for s in "FOP" for m in ("mean", "share_over")], digits=4)


def state_threads(spark, sf_dir):
    """Orders of a customer as one group, threaded by states made of their ranks; groups that don't
    thread are left without places."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.xxhash64("o_orderkey"), "o_orderkey"))
    e = o.withColumn("n", n).select("o_custkey", "o_orderkey", "n", (F.col("n") - 1).alias("before"), F.when((F.col("o_custkey") % 2 == 0) & (F.col("n") == 3), 1).otherwise(F.col("n")).alias("after"))
    out = tm.threaded(e, ["o_custkey"], "o_orderkey", "before", "after")
    return out.groupBy(F.col("place").isNotNull().alias("threaded")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("place") + 1 == F.col("n")).alias("right"), F.count_distinct("o_custkey").alias("groups"))


def relocation_outcomes(spark, sf_dir):
    """Outcomes of relocation events within a window of dates."""
    e = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 5 == 0, "unofficial").alias("provenance"), F.when(F.col("event_id") % 3 != 0, F.to_date("ts")).alias("confirmed"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("ident"))
    out = tm.relocations(e, F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"), F.col("ident"))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def positional_compare(spark, sf_dir):
    """The i-th line of each order against the i-th of a changed copy."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    other = li.filter("l_orderkey % 60 <> 0 OR l_linenumber <> 1").withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_extendedprice") > 50_000, 1.0).otherwise(1e-9))
    return gc.positional_differences(li, other, ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_quantity"], ["l_quantity", "l_extendedprice"], 1e-6)


QUERIES = {
    f.__name__: f
    for f in (
        block_means, town_match, geocode_cascade, series_fan_out, coordinate_policies, wide_unit_summary, state_threads, relocation_outcomes, positional_compare,
    )
}

_BLOCKS = "blocks AS (SELECT p_brand AS region, p_type AS town, p_size AS block, l_linenumber, 20 + (l_orderkey * 37 % 2600) / 100 AS lat, 122 + (l_orderkey * 91 % 3200) / 100 AS lon FROM lineitem JOIN part ON l_partkey = p_partkey)"

ORACLE_SQL = {
    "block_means": f"""
WITH {_BLOCKS} SELECT region, town, block, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM blocks WHERE l_linenumber <> 3 AND block % 7 = 0 GROUP BY ALL""",
    "town_match": """
WITH c AS (SELECT c_custkey AS aid, (['abcd', 'xabc', 'zzabcz', 'cq', 'q', 'hello', 'abc', 'ecd'])[c_custkey % 8 + 1] AS town FROM customer), t(key) AS (VALUES ('abc'), ('ab'), ('cd'), ('h')),
m AS (SELECT aid, key, CASE WHEN town = key THEN 0 WHEN starts_with(town, key) AND length(key) > 1 THEN 1 WHEN ends_with(town, key) AND length(key) > 1 THEN 2
  WHEN contains(town, key) AND length(key) >= 3 THEN 3 WHEN town[1:1] = key THEN 4 END AS level FROM c, t)
SELECT aid, arg_min(key, (level, -length(key))) AS key, min(level)::INT AS level FROM m WHERE level IS NOT NULL GROUP BY 1""",
    "geocode_cascade": f"""
WITH {_BLOCKS}, b AS (SELECT * FROM blocks), x AS (SELECT region, town, block, avg(lat) AS lat, avg(lon) AS lon FROM b WHERE block % 3 = 0 GROUP BY ALL),
t AS (SELECT region, town, avg(lat) AS lat, avg(lon) AS lon FROM b WHERE block % 3 = 1 GROUP BY ALL), r AS (SELECT region, avg(lat) AS lat, avg(lon) AS lon FROM b WHERE region <> 'Brand#11' GROUP BY ALL),
o AS (SELECT CASE WHEN x.lat IS NOT NULL THEN 'block' WHEN t.lat IS NOT NULL THEN 'town' WHEN r.lat IS NOT NULL THEN 'city' ELSE 'unmatched' END AS accuracy, coalesce(x.lat, t.lat, r.lat) AS lat, coalesce(x.lon, t.lon, r.lon) AS lon
  FROM part LEFT JOIN x ON x.region = p_brand AND x.town = p_type AND x.block = p_size LEFT JOIN t ON t.region = p_brand AND t.town = p_type LEFT JOIN r ON r.region = p_brand)
SELECT accuracy, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM o GROUP BY 1""",
    "series_fan_out": """
WITH c AS (SELECT *, (c_acctbal < 0)::INT + (c_acctbal > 9000)::INT AS f FROM customer), s AS (SELECT 'formal' AS series, f FROM c UNION ALL SELECT 'effective', f FROM c WHERE c_acctbal > 0
  UNION ALL SELECT 'block_only', f FROM c WHERE c_custkey % 3 = 0 UNION ALL SELECT 'inherited', f FROM c WHERE c_custkey % 3 = 1)
SELECT series, count(*) AS n, sum(f)::BIGINT AS flags FROM s GROUP BY 1""",
    "coordinate_policies": """
WITH c AS (SELECT c_custkey AS k, CASE WHEN k % 4 <> 0 THEN 20 + (k * 37 % 2600) / 100 END AS ola, CASE WHEN k % 4 <> 0 THEN 122 + (k * 91 % 3200) / 100 END AS olo,
  CASE WHEN k % 3 <> 0 THEN 20 + ((k + 1) * 37 % 2600) / 100 END AS nla, CASE WHEN k % 3 <> 0 THEN 122 + ((k + 1) * 91 % 3200) / 100 END AS nlo FROM customer),
p AS (SELECT 'current' AS policy, nla AS a, nlo AS o FROM c UNION ALL SELECT 'inherit', coalesce(ola, nla), coalesce(olo, nlo) FROM c
  UNION ALL SELECT 'corrected', CASE WHEN k % 5 = 0 THEN nla ELSE coalesce(ola, nla) END, CASE WHEN k % 5 = 0 THEN nlo ELSE coalesce(olo, nlo) END FROM c)
SELECT policy, count(a) AS n, round(avg(a), 6) AS lat, round(avg(o), 6) AS lon FROM p GROUP BY 1""",
    "wide_unit_summary": f"""
SELECT c_nationkey, {", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 4) AS mean_{s}, round(avg((o_totalprice > 100000)::INT) FILTER (o_orderstatus = '{s}'), 4) AS share_over_{s}" for s in "FOP")}
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "state_threads": """
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, NOT (o_custkey % 2 = 0 AND n >= 3) AS threaded FROM o)
SELECT threaded, sum(n)::BIGINT AS n, sum(CASE WHEN threaded THEN n ELSE 0 END)::BIGINT AS right, count(*) AS groups FROM t GROUP BY 1""".replace("AS right", 'AS "right"'),
    "relocation_outcomes": """
SELECT CASE WHEN event_id % 5 = 0 THEN 'unofficial' WHEN event_id % 3 = 0 THEN 'planned_only' WHEN ts::DATE <= DATE '2024-01-05' OR ts::DATE > DATE '2024-01-20' THEN 'outside' WHEN event_id % 7 = 0 THEN 'no_identifier' ELSE 'used' END AS outcome,
  count(*) AS n FROM events GROUP BY 1""",
    "positional_compare": """
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS e FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, q + CASE WHEN e > 50000 THEN 1 ELSE 0 END AS q, e FROM a WHERE l_orderkey % 60 <> 0 OR l_linenumber <> 1),
x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, e, q) AS ord FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, e, q) AS ord FROM b),
j AS (SELECT l_orderkey, ord, concat_ws(',', CASE WHEN x.q IS NULL OR y.q IS NULL OR abs(x.q - y.q) > 1e-6 THEN 'l_quantity' END, CASE WHEN x.e IS NULL OR y.e IS NULL OR abs(x.e - y.e) > 1e-6 THEN 'l_extendedprice' END) AS fields FROM x FULL JOIN y USING (l_orderkey, ord))
SELECT l_orderkey, ord, fields FROM j WHERE fields <> ''""",
}
