"""Queries of whole geocoding runs: addresses are made of customers' keys, blocks lie where orders do."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.operators import geocoding as gc
from netledger.plans.common import lat, lon, rounded, table

_REGIONS = ("北海道", "東京都", "大阪府", "県なし")
#: What stands for the city in an address, and the cities that there are.
_WRITTEN = ("三宅島三宅村", "中央区", "西多摩郡瑞穂町", "中央区北", "どこにもない市", "郡山島田市", "")
_CITIES = ("三宅村", "中央区", "瑞穂町", "中央区北", "山島田市", "田市")
#: What stands for the town, and the towns of both kinds in every city.
_STREETS = ("大字宮前", "本町", "宮前字小松", "上ル東宮前", "通り東入田丸町西", "巻潟", "本町2丁目", "なし", "", "新町", "港")
_TOWNS = ("宮前", "本町三丁目", "本町二丁目", "本町", "田丸町", "港第一地割")
_SECTIONS = ("巻", "新町", "宮前字")
_NUMBERS = ("", "3", "3-5", "1-54-1", "120-2")


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def geocode_run(spark, sf_dir):
    """The place of every customer's address with the level that gave it, from cities, towns, sections and blocks."""
    k, o = F.col("c_custkey"), F.col("l_orderkey")
    addresses = table(spark, sf_dir, "customer").select(k.alias("aid"), F.concat(_pick(_REGIONS, k), _pick(_WRITTEN, k + F.floor(k / 4)), _pick(_STREETS, F.floor(k / 3)), _pick(_NUMBERS, F.floor(k / 2))).alias("address"))
    # the towns of a line's order and part lie where the line does
    at = table(spark, sf_dir, "lineitem").select(
        _pick(_REGIONS, o).alias("region"), _pick(_CITIES, F.col("l_partkey")).alias("city"), F.col("l_linenumber"), lat(o).alias("lat"), lon(o).alias("lon"),
        _pick(_TOWNS, F.col("l_suppkey") + o).alias("town"), _pick(_SECTIONS, F.col("l_suppkey")).alias("section"), F.col("l_quantity").cast("int").cast("string").alias("block"))
    towns = gc.point_means(at.filter("town <> '田丸町' OR city <> '中央区'"), ["region", "city", "town"])
    sections = gc.point_means(at, ["region", "city", "section"]).withColumnRenamed("section", "town")
    blocks = at.withColumn("deleted", F.col("l_linenumber") == 3)
    return rounded(gc.geocode(addresses, towns, sections, blocks, at.select("region", "city", "lat", "lon")), "lat", "lon")


QUERIES = {f.__name__: f for f in (geocode_run,)}

_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_sql = lambda values, key: f"({_list(values)})[({key}) % {len(values)} + 1]"

ORACLE_SQL = {
    "geocode_run": f"""
WITH w AS (SELECT c_custkey AS aid, {_sql(_REGIONS, "c_custkey")} AS region, {_sql(_WRITTEN, "c_custkey + c_custkey // 4")} || {_sql(_STREETS, "c_custkey // 3")} || {_sql(_NUMBERS, "c_custkey // 2")} AS rest FROM customer),
p AS (SELECT {_sql(_REGIONS, "l_orderkey")} AS region, {_sql(_CITIES, "l_partkey")} AS city, l_linenumber, 20 + (l_orderkey * 37 % 2600) / 100 AS lat, 122 + (l_orderkey * 91 % 3200) / 100 AS lon,
  {_sql(_TOWNS, "l_suppkey + l_orderkey")} AS town, {_sql(_SECTIONS, "l_suppkey")} AS section, l_quantity::INT::VARCHAR AS block FROM lineitem),
kc AS (SELECT region, city, avg(lat) AS lat, avg(lon) AS lon FROM p GROUP BY ALL),
kt AS (SELECT 0 AS src, region, city, town, avg(lat) AS lat, avg(lon) AS lon FROM p WHERE town <> '田丸町' OR city <> '中央区' GROUP BY ALL UNION ALL SELECT 1, region, city, section, avg(lat), avg(lon) FROM p GROUP BY ALL),
kb AS (SELECT region, city, town, block, avg(lat) AS lat, avg(lon) AS lon FROM p WHERE l_linenumber <> 3 GROUP BY ALL),
st AS (SELECT aid, region, rest, unnest(list_filter(range(9), lambda i: i = 0 OR rest[i:i] IN ('郡', '島'))) AS cut FROM w WHERE region <> '県なし'),
sc AS (SELECT aid, arg_min({{'city': city, 'cut': cut}}, (CASE WHEN cut = 0 THEN 0 ELSE 9 - cut END, -length(city))) AS b FROM st JOIN kc USING (region) WHERE starts_with(replace(rest, '大字', '')[cut + 1:], city) GROUP BY 1),
r AS (SELECT w.aid, w.region, b.city AS city, substring(rest, b.cut + length(b.city) + 1) AS t FROM w JOIN sc USING (aid)),
n AS (SELECT *, replace(t, '大字', '') AS f FROM r),
h AS (SELECT *, regexp_extract(f, '^[^0-9]*') AS head0, regexp_extract_all(f, '[0-9]+') AS nums FROM n),
g AS (SELECT *, head0 AS head, regexp_replace(replace(f, '2丁目', '二丁目'), '^字', '') AS whole FROM h),
q AS (SELECT *, ({_list(("一", "二", "三", "四", "五"))})[TRY_CAST(nums[1] AS INT)] AS kan FROM g),
c AS (
  SELECT aid, region, city, 0 AS level, 0 AS ord, 0 AS start, head || kan || '丁目' AS key, 'exact_chome' AS method, nums[2] AS block FROM q WHERE kan IS NOT NULL
  UNION ALL SELECT aid, region, city, 0, 1, 0, head || kan || '丁', 'exact_chome', nums[2] FROM q WHERE kan IS NOT NULL
  UNION ALL SELECT aid, region, city, 0, 2, 0, head || '第' || kan || '地割', 'exact_chome', nums[2] FROM q WHERE kan IS NOT NULL
  UNION ALL SELECT aid, region, city, 0, 3, 0, head, 'exact', CASE WHEN len(nums) <= 2 THEN nums[1] END FROM q
  UNION ALL SELECT aid, region, q.city, 1, -length(town), 0, town, 'prefix', NULL FROM q JOIN (SELECT DISTINCT town FROM kt) ON starts_with(head, town) AND length(town) >= 2
  UNION ALL SELECT aid, region, q.city, 2, -length(town), 0, town, 'suffix', NULL FROM q JOIN (SELECT DISTINCT town FROM kt) ON ends_with(head, town) AND length(town) >= 2 AND town <> head
  UNION ALL SELECT aid, region, q.city, 3, -length(town), strpos(whole, town), town, 'substr', NULL FROM q JOIN (SELECT DISTINCT town FROM kt) ON contains(whole, town) AND length(town) >= 3
  UNION ALL SELECT aid, region, city, 4, -1, 0, head[1:1], 'prefix1', NULL FROM q WHERE head <> ''
),
m AS (SELECT c.*, src, town, lat, lon FROM c JOIN kt ON c.region = kt.region AND c.city = kt.city AND c.key = kt.town),
t AS (SELECT aid, arg_min({{'town': town, 'method': method, 'src': src, 'block': block, 'lat': lat, 'lon': lon}}, (level, CASE WHEN level = 0 THEN ord ELSE src END, CASE WHEN level = 0 THEN src ELSE ord END, start)) AS x FROM m GROUP BY 1)
SELECT w.aid, nullif(w.region, '県なし') AS region, r.city, x.town AS town, x.method AS method, (['towns', 'sections'])[x.src + 1] AS source,
  CASE WHEN kb.lat IS NOT NULL THEN 'block' WHEN x.lat IS NOT NULL THEN 'town' WHEN kc.lat IS NOT NULL THEN 'city' ELSE 'unmatched' END AS accuracy,
  round(coalesce(kb.lat, x.lat, kc.lat), 6) AS lat, round(coalesce(kb.lon, x.lon, kc.lon), 6) AS lon, CASE WHEN w.region = '県なし' THEN 'no_pref' WHEN r.city IS NULL THEN 'no_city' END AS error
FROM w LEFT JOIN r USING (aid) LEFT JOIN t USING (aid) LEFT JOIN kb ON x.src = 0 AND kb.region = w.region AND kb.city = r.city AND kb.town = x.town AND kb.block = x.block LEFT JOIN kc ON kc.region = w.region AND kc.city = r.city""",
}
