"""Queries of distances, neighbourhoods, polygons and spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.functions import geo
from netledger.operators import spatial as sp
from netledger.plans.common import lat, lon, rounded, table

RADII = (20.0, 50.0, 100.0, 200.0)
BANDS = (500, 1000, 2000, 5000, 10000)

#: Hand-made polygons: name and rings of (x, y); the second has a hole, the last overlaps the first.
POLYGONS = (
    ("west", (((124, 22), (134, 21), (133, 34), (125, 33)),)),
    ("ring", (((136, 24), (148, 24), (148, 40), (136, 40)), ((139, 28), (145, 28), (145, 36), (139, 36)))),
    ("spike", (((126, 36), (130, 45), (134, 36), (130, 39)),)),
    ("east", (((149, 20), (153, 20), (151, 44)),)),
    ("cover", (((130, 20), (138, 20), (138, 30), (130, 30)),)),
)


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lid"), "c_nationkey", "c_mktsegment", lat(k).alias("lat"), lon(k).alias("lon"), (k * 91 % 3200).cast("double").alias("x"), (k * 37 % 2600).cast("double").alias("y"), F.col("c_acctbal").alias("v"))


def _suppliers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rid"), lat(k + 0.5).alias("lat"), lon(k + 0.25).alias("lon"), (k * 91 % 3200).cast("double").alias("x"), (k * 37 % 2600).cast("double").alias("y"))


_C = "SELECT c_custkey AS lid, c_nationkey, c_mktsegment, 20 + (c_custkey * 37 % 2600) / 100 AS lat, 122 + (c_custkey * 91 % 3200) / 100 AS lon, (c_custkey * 91 % 3200)::DOUBLE AS x, (c_custkey * 37 % 2600)::DOUBLE AS y, c_acctbal AS v FROM customer"
_S = "SELECT s_suppkey AS rid, 20 + ((s_suppkey + 0.5::DOUBLE) * 37 % 2600) / 100 AS lat, 122 + ((s_suppkey + 0.25::DOUBLE) * 91 % 3200) / 100 AS lon, (s_suppkey * 91 % 3200)::DOUBLE AS x, (s_suppkey * 37 % 2600)::DOUBLE AS y FROM supplier"
_HAVERSINE = f"2 * {geo.MEAN_RADIUS} * asin(least(1.0, sqrt(pow(sin((radians(s.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(c.lon)) / 2), 2))))"


def radius_counts(spark, sf_dir):
    out = sp.radius_counts(_customers(spark, sf_dir).select("lid", "x", "y"), _suppliers(spark, sf_dir).select("x", "y"), RADII)
    return rounded(out, "nearest")


def nearest_neighbor(spark, sf_dir):
    out = sp.nearest(_customers(spark, sf_dir), _suppliers(spark, sf_dir), cell=2.0)
    return rounded(out.select("lid", "distance"), "distance", digits=3)


def _access(spark, sf_dir):
    near = sp.nearest(_customers(spark, sf_dir), _suppliers(spark, sf_dir), cell=2.0)
    return near.join(_customers(spark, sf_dir).select("lid", "c_mktsegment", "c_nationkey"), "lid").withColumn("km", F.col("distance") / 100)


_ACCESS = f"access AS (SELECT c.lid, c_mktsegment, c_nationkey, min({_HAVERSINE}) / 100 AS km FROM ({_C}) AS c, ({_S}) AS s GROUP BY ALL)"


def band_histogram(spark, sf_dir):
    """Customers per distance band and segment, with shares."""
    out = _access(spark, sf_dir).groupBy("c_mktsegment", geo.band(F.col("km"), BANDS).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    whole = out.groupBy("c_mktsegment").agg(F.sum("n").alias("_all"))
    return rounded(out.join(whole, "c_mktsegment").select("c_mktsegment", "band", "n", (F.col("n") / F.col("_all")).alias("share")), "share")


def cumulative_coverage(spark, sf_dir):
    """Mean distance and the share of customers within each bound, by segment."""
    within = [F.avg(F.when(F.col("km") <= b, 1.0).otherwise(0.0)).alias(f"within_{b}") for b in BANDS]
    out = _access(spark, sf_dir).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("km").alias("mean"), *within)
    return rounded(out, "mean", *[f"within_{b}" for b in BANDS])


def stratified_change(spark, sf_dir):
    """Mean distance and coverage before and after a change, for overlapping strata of customers."""
    a = _access(spark, sf_dir).withColumn("after", F.when(F.col("lid") % 11 != 0, F.col("km") * F.when(F.col("lid") % 2 == 0, 0.5).otherwise(1.0)))
    strata = F.array_compact(F.array(F.lit("all"), F.when(F.col("c_nationkey") < 10, F.lit("low")), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("building")), F.when(F.lit(False), F.lit("none"))))
    ok = F.col("after").isNotNull()
    out = a.select(F.explode(strata).alias("stratum"), "km", "after").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("not_evaluable"), F.avg(F.when(ok, F.col("km"))).alias("mean_before"), F.avg("after").alias("mean_after"),
        (F.avg(F.when(ok, F.when(F.col("after") <= 2000, 100.0).otherwise(0.0))) - F.avg(F.when(ok, F.when(F.col("km") <= 2000, 100.0).otherwise(0.0)))).alias("coverage_change"),
    )
    out = out.withColumn("mean_change", F.col("mean_after") - F.col("mean_before"))
    return rounded(out, "mean_before", "mean_after", "mean_change", "coverage_change")


def _polygons(spark):
    rows = [(name, i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, (name, rings) in enumerate(POLYGONS)]
    return spark.createDataFrame(rows, "polygon string, ord int, rings array<array<struct<x:double,y:double>>>")


def _points(spark, sf_dir):
    return _customers(spark, sf_dir).select(F.col("lid").alias("pid"), (F.col("lon") + 0.003).alias("x"), (F.col("lat") + 0.007).alias("y"))


def point_in_polygon(spark, sf_dir):
    return sp.point_in_polygon(_points(spark, sf_dir), _polygons(spark))


def nearest_assigned(spark, sf_dir):
    """How many points lie inside a polygon and how many take the nearest assigned point's."""
    points = _points(spark, sf_dir)
    out = sp.nearest_assigned(points, sp.point_in_polygon(points, _polygons(spark)))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def polygon_centroid(spark, sf_dir):
    return rounded(sp.polygon_centroid(_polygons(spark)), "area", "x", "y")


def _graph(spark, sf_dir, k=4):
    points = _customers(spark, sf_dir).select(F.col("lid").alias("id"), "x", "y", "c_nationkey")
    return sp.knn_edges(points, k, 400.0, ["c_nationkey"])


def _values(spark, sf_dir):
    return _customers(spark, sf_dir).select(F.col("lid").alias("id"), "c_nationkey", "v")


def knn_graph(spark, sf_dir):
    return rounded(_graph(spark, sf_dir), "distance")


def moran(spark, sf_dir):
    edges = _graph(spark, sf_dir).select("src", "dst", F.lit(0.25).alias("w"))
    return rounded(sp.global_moran(_values(spark, sf_dir), edges, ["c_nationkey"]), "moran")


def moran_permutation(spark, sf_dir):
    edges = _graph(spark, sf_dir).select("src", "dst", F.lit(0.25).alias("w"))
    return rounded(sp.moran_permutations(_values(spark, sf_dir), edges, ["c_nationkey"], 19), "moran", "expected", "z_perm")


def getis_ord(spark, sf_dir):
    return rounded(sp.getis_ord(_values(spark, sf_dir), _graph(spark, sf_dir), ["c_nationkey"]), "z")


def hot_cold_counts(spark, sf_dir):
    z = sp.getis_ord(_values(spark, sf_dir), _graph(spark, sf_dir), ["c_nationkey"])
    return z.groupBy("c_nationkey").agg(*[F.count_if(t).alias(n) for n, t in (("hot_95", F.col("z") >= 1.96), ("hot_99", F.col("z") >= 2.58), ("cold_95", F.col("z") <= -1.96), ("cold_99", F.col("z") <= -2.58))])


def mesh_center(spark, sf_dir):
    code = F.concat(F.lpad((F.col("p_partkey") % 40 + 30).cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 30 + 22).cast("string"), 2, "0"), (F.col("p_partkey") % 8).cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 4 + 1).cast("string"), (F.col("p_size") % 4 + 1).cast("string"))
    cut = F.substring(code, F.lit(1), F.element_at(F.array(*map(F.lit, (4, 6, 8, 9, 10, 5))), (F.col("p_partkey") % 6 + 1).cast("int")))
    out = table(spark, sf_dir, "part").select("p_partkey", cut.alias("code")).withColumn("c", geo.mesh_centre(F.col("code")))
    return rounded(out.select("p_partkey", "code", "c.lat", "c.lon"), "lat", "lon", digits=9)


def ecef_and_equal_area(spark, sf_dir):
    """Earth-centred and equal-area coordinates."""
    c = _customers(spark, sf_dir).select("lid", "lat", "lon", geo.ecef(F.col("lat"), F.col("lon")).alias("e"), geo.equal_area(F.col("lat"), F.col("lon")).alias("p"))
    return rounded(c.select("lid", "e.x", "e.y", "e.z", F.col("p.x").alias("px"), F.col("p.y").alias("py")), "x", "y", "z", "px", "py", digits=3)


QUERIES = {
    f.__name__: f
    for f in (
        radius_counts, nearest_neighbor, band_histogram, cumulative_coverage, stratified_change, point_in_polygon, nearest_assigned, polygon_centroid,
        knn_graph, moran, moran_permutation, getis_ord, hot_cold_counts, mesh_center, ecef_and_equal_area,
    )
}

_EDGES = ", ".join(
    f"('{name}', {i}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)"
    for i, (name, rings) in enumerate(POLYGONS) for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
)
_RINGS = ", ".join(
    f"('{name}', {part}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)"
    for name, rings in POLYGONS for part, ring in enumerate(rings) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
)
_PIP = f"""
edge AS (SELECT * FROM (VALUES {_EDGES}) AS t(polygon, ord, x1, y1, x2, y2)),
pt AS (SELECT lid AS pid, lon + 0.003 AS px, lat + 0.007 AS py FROM ({_C})),
hit AS (SELECT pid, polygon, ord FROM pt, edge WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
pip AS (SELECT pid, arg_min(polygon, ord) AS polygon FROM hit GROUP BY 1)"""
_KNN = f"""
c AS ({_C}), knn AS (
  SELECT a.lid AS src, b.lid AS dst, a.c_nationkey, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM c AS a JOIN c AS b ON a.c_nationkey = b.c_nationkey AND a.lid <> b.lid
  QUALIFY row_number() OVER (PARTITION BY a.lid ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.lid) <= 4)"""
_GI = """
near AS (SELECT src, dst FROM knn UNION SELECT lid, lid FROM c),
l AS (SELECT src AS id, sum(v) AS s, count(*) AS w FROM near JOIN c ON lid = dst GROUP BY 1),
g AS (SELECT c_nationkey, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM c GROUP BY 1),
z AS (SELECT id, c_nationkey, (s - m * w) / nullif(sd * sqrt((n * w - w * w) / nullif(n - 1, 0)::DOUBLE), 0) AS z FROM l JOIN c ON lid = id JOIN g USING (c_nationkey))"""

ORACLE_SQL = {
    "radius_counts": f"""
WITH r AS (SELECT unnest([{", ".join(map(str, RADII))}])::DOUBLE AS radius), p AS (SELECT c.lid, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) AS d FROM ({_C}) AS c, ({_S}) AS s)
SELECT lid, radius, count(*) FILTER (d <= radius) AS n, round(min(d) FILTER (d <= radius), 6) AS nearest FROM p, r GROUP BY ALL""",
    "nearest_neighbor": f"SELECT c.lid, round(min({_HAVERSINE}), 3) AS distance FROM ({_C}) AS c, ({_S}) AS s GROUP BY c.lid",
    "band_histogram": f"""
WITH {_ACCESS}, b AS (SELECT c_mktsegment, CASE {" ".join(f"WHEN km <= {b} THEN {i}" for i, b in enumerate(BANDS))} ELSE {len(BANDS)} END AS band FROM access)
SELECT c_mktsegment, band, n, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share FROM (SELECT c_mktsegment, band, count(*) AS n FROM b GROUP BY ALL)""",
    "cumulative_coverage": f"""
WITH {_ACCESS} SELECT c_mktsegment, count(*) AS n, round(avg(km), 6) AS mean, {", ".join(f"round(avg((km <= {b})::INT), 6) AS within_{b}" for b in BANDS)} FROM access GROUP BY 1""",
    "stratified_change": f"""
WITH {_ACCESS}, a AS (SELECT *, CASE WHEN lid % 11 <> 0 THEN km * CASE WHEN lid % 2 = 0 THEN 0.5 ELSE 1.0 END END AS aft FROM access),
s AS (SELECT 'all' AS stratum, * FROM a UNION ALL SELECT 'low', * FROM a WHERE c_nationkey < 10 UNION ALL SELECT 'building', * FROM a WHERE c_mktsegment = 'BUILDING')
SELECT stratum, count(*) AS n, count(*) FILTER (aft IS NULL) AS not_evaluable, round(avg(km) FILTER (aft IS NOT NULL), 6) AS mean_before, round(avg(aft), 6) AS mean_after,
  round(avg(aft) - avg(km) FILTER (aft IS NOT NULL), 6) AS mean_change,
  round(100 * (avg((aft <= 2000)::INT) FILTER (aft IS NOT NULL) - avg((km <= 2000)::INT) FILTER (aft IS NOT NULL)), 6) AS coverage_change FROM s GROUP BY 1""",
    "point_in_polygon": f"WITH {_PIP} SELECT pid, polygon FROM pip",
    "nearest_assigned": f"""
WITH {_PIP} SELECT CASE WHEN polygon IS NULL THEN 'nearest' ELSE 'inside' END AS source, count(*) AS n FROM pt LEFT JOIN pip USING (pid) GROUP BY 1""",
    "knn_graph": f"WITH {_KNN} SELECT src, dst, round(distance, 6) AS distance FROM knn",
    "moran": f"""
WITH {_KNN}, m AS (SELECT c_nationkey, avg(v) AS m, count(*) AS n, var_pop(v) AS var FROM c GROUP BY 1),
s AS (SELECT knn.c_nationkey, sum(0.25) AS w, sum(0.25 * (a.v - m) * (b.v - m)) AS k FROM knn JOIN c AS a ON a.lid = src JOIN c AS b ON b.lid = dst JOIN m ON m.c_nationkey = knn.c_nationkey GROUP BY 1)
SELECT c_nationkey, round(CASE WHEN n >= 3 AND var > 0 THEN k / (w * var) END, 6) AS moran FROM s JOIN m USING (c_nationkey)""",
    "moran_permutation": f"""
WITH {_KNN}, r AS (SELECT range AS run FROM range(0, 20)), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY lid) AS r FROM c),
x AS (SELECT o.c_nationkey, run, lid, row_number() OVER (PARTITION BY o.c_nationkey, run ORDER BY CASE WHEN run > 0 THEN md5(lid || '|' || run || '|1') END, lid) AS r FROM o, r),
d AS (SELECT x.c_nationkey, run, x.lid, o.v FROM x JOIN o ON x.c_nationkey = o.c_nationkey AND x.r = o.r), m AS (SELECT c_nationkey, avg(v) AS m, count(*) AS n, var_pop(v) AS var FROM c GROUP BY 1),
i AS (SELECT knn.c_nationkey, a.run, sum((a.v - m) * (b.v - m)) / nullif(count(*) * any_value(var), 0) AS i, -1 / nullif(any_value(n) - 1, 0)::DOUBLE AS e
  FROM knn JOIN d AS a ON a.lid = src JOIN d AS b ON b.lid = dst AND a.run = b.run JOIN m ON m.c_nationkey = knn.c_nationkey GROUP BY ALL),
z AS (SELECT c_nationkey, i AS o FROM i WHERE run = 0)
SELECT c_nationkey, round(any_value(o), 6) AS moran, round(any_value(e), 6) AS expected, CASE WHEN stddev_samp(i) > 1e-9 THEN round((any_value(o) - avg(i)) / stddev_samp(i), 6) END AS z_perm,
  (count(*) FILTER (abs(i - e) >= abs(o - e) - 1e-9) + 1) / (count(i) + 1) AS p FROM i JOIN z USING (c_nationkey) WHERE run > 0 GROUP BY 1""",
    "polygon_centroid": f"""
WITH edge AS (SELECT * FROM (VALUES {_RINGS}) AS t(polygon, part, x1, y1, x2, y2)), k AS (SELECT *, x1 * y2 - x2 * y1 AS c FROM edge),
p AS (SELECT polygon, part, abs(sum(c) / 2) AS area, sum((x1 + x2) * c) / (3 * sum(c)) AS cx, sum((y1 + y2) * c) / (3 * sum(c)) AS cy FROM k GROUP BY ALL)
SELECT polygon, round(sum(area), 6) AS area, round(sum(area * cx) / sum(area), 6) AS x, round(sum(area * cy) / sum(area), 6) AS y FROM p GROUP BY 1""",
    "ecef_and_equal_area": f"""
WITH k AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE AS f, radians(36) AS p0, radians(138) AS l0), e AS (SELECT *, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM k),
c AS (SELECT lid, radians(lat) AS p, radians(lon) AS l FROM ({_C})),
q AS (SELECT *, (1 - e2) * (sin(p) / (1 - e2 * sin(p) * sin(p)) - ln((1 - e * sin(p)) / (1 + e * sin(p))) / (2 * e)) AS q, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp,
  (1 - e2) * (sin(p0) / (1 - e2 * sin(p0) * sin(p0)) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) AS q0 FROM c, e),
b AS (SELECT *, asin(q / qp) AS b, asin(q0 / qp) AS b0, a * sqrt(qp / 2) AS rq, a * cos(p0) / sqrt(1 - e2 * sin(p0) * sin(p0)) AS am FROM q),
d AS (SELECT *, am / (rq * cos(b0)) AS d, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(l - l0))) AS s, a / sqrt(1 - e2 * sin(p) * sin(p)) AS n FROM b)
SELECT lid, round(n * cos(p) * cos(l), 3) AS x, round(n * cos(p) * sin(l), 3) AS y, round(n * (1 - e2) * sin(p), 3) AS z, round(s * d * cos(b) * sin(l - l0), 3) AS px,
  round(s / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(l - l0)), 3) AS py FROM d""",
    "getis_ord": f"WITH {_KNN}, {_GI} SELECT id, c_nationkey, round(z, 6) AS z FROM z",
    "hot_cold_counts": f"""
WITH {_KNN}, {_GI} SELECT c_nationkey, count(*) FILTER (z >= 1.96) AS hot_95, count(*) FILTER (z >= 2.58) AS hot_99, count(*) FILTER (z <= -1.96) AS cold_95, count(*) FILTER (z <= -2.58) AS cold_99 FROM z GROUP BY 1""",
    "mesh_center": """
WITH k AS (SELECT p_partkey, lpad((p_partkey % 40 + 30)::VARCHAR, 2, '0') || lpad((p_partkey % 30 + 22)::VARCHAR, 2, '0') || p_partkey % 8 || p_partkey % 7 || p_partkey % 10 || p_size % 10 || (p_partkey % 4 + 1) || (p_size % 4 + 1) AS full_code FROM part),
c AS (SELECT p_partkey, full_code[1:([4, 6, 8, 9, 10, 5])[p_partkey % 6 + 1]] AS code FROM k),
d AS (SELECT *, length(code) AS n, code[1:2]::DOUBLE / 1.5 AS a, code[3:4]::DOUBLE + 100 AS b FROM c)
SELECT p_partkey, code, round(CASE n
  WHEN 4 THEN a + 1 / 3 WHEN 6 THEN a + (code[5:5]::INT + 0.5) / 12 WHEN 8 THEN a + code[5:5]::INT / 12 + (code[7:7]::INT + 0.5) / 120
  WHEN 9 THEN a + code[5:5]::INT / 12 + code[7:7]::INT / 120 + ((code[9:9]::INT - 1) // 2 + 0.5) / 240
  WHEN 10 THEN a + code[5:5]::INT / 12 + code[7:7]::INT / 120 + ((code[9:9]::INT - 1) // 2) / 240 + ((code[10:10]::INT - 1) // 2 + 0.5) / 480 END, 9) AS lat,
  round(CASE n
  WHEN 4 THEN b + 0.5 WHEN 6 THEN b + (code[6:6]::INT + 0.5) / 8 WHEN 8 THEN b + code[6:6]::INT / 8 + (code[8:8]::INT + 0.5) / 80
  WHEN 9 THEN b + code[6:6]::INT / 8 + code[8:8]::INT / 80 + ((code[9:9]::INT - 1) % 2 + 0.5) / 160
  WHEN 10 THEN b + code[6:6]::INT / 8 + code[8:8]::INT / 80 + ((code[9:9]::INT - 1) % 2) / 160 + ((code[10:10]::INT - 1) % 2 + 0.5) / 320 END, 9) AS lon FROM d""",
}
