"""What grows with the table must not grow with the square of those at one place, or near it."""

import math

import pytest
from pyspark.sql import functions as F

from netledger.operators import linkage, spatial
from netledger.plans import ledger, registers


def joined(spark, run, kinds=("Join", "CartesianProduct"), counted="number of output rows"):
    """What ``run`` gives, and the most rows that a join made in it; or that another kind of node counted."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    out = run()
    most = 0
    for i in range(before, store.executionsList().size()):
        execution = store.executionsList().apply(i)
        metrics = store.executionMetrics(execution.executionId())
        nodes = store.planGraph(execution.executionId()).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if not any(kind in node.name() for kind in kinds):
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == counted and metrics.contains(metric.accumulatorId()):
                    most = max(most, int(metrics.apply(metric.accumulatorId()).replace(",", "")))
    return out, most


def far(a, b):
    (p, q), (r, s) = [map(math.radians, x) for x in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_among_many_at_few_places(spark, k):
    spots = [(20 + i * 0.5, 130 + i * 0.25) for i in range(12)] + [(89.5, 10.0), (-70.0, 179.9), (0.0, -179.9)]
    asked = [(20.1 + i * 0.9, 129 + i * 0.7) for i in range(8)] + [(89.9, -170.0), (-70.0, -179.9), (10.0, 180.0)]
    at = lambda points, name, of: spark.range(3000).select(F.col("id").alias(name), F.get(F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in points]), (F.col("id") % of).cast("int")).alias("p")).select(name, "p.*")
    near, most = joined(spark, lambda: spatial.nearest_few(at(asked, "lid", 11), at(spots, "rid", 15), k, cell=2.0).collect())
    assert len(near) == 3000 and most <= 10_000
    for r in near:
        wanted = min((far(asked[r.lid % 11], s), i) for i, s in enumerate(spots))
        assert [n.rid for n in r.near] == [wanted[1] + 15 * i for i in range(k)]
        assert r.near[0].d == pytest.approx(wanted[0], abs=1e-3)


def test_a_cascade_shuffles_no_pairs(spark):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "a").alias("k1"), F.lit("b").alias("k2")).unionByName(spark.createDataFrame([(0, None, "b")], "id long, k1 string, k2 string"))
    right = spark.range(400).select(F.col("id").alias("rid"), F.when(F.col("id") < 200, "a").alias("r1"), F.lit("b").alias("r2"))
    run = lambda: linkage.decide(linkage.cascade(left, right, [("one", "k1", "r1"), ("two", "k2", "r2")], "id", "rid"), "id", "rid", ("one",)).collect()
    out, most = joined(spark, run, ("Exchange",), "shuffle records written")
    assert most < 2000 and len(out) == 100 * 200 + 200 * 400
    assert {(r.method, r.n) for r in out if r.id == 3} == {("one", 200)} and {(r.method, r.n) for r in out if r.id == 4} == {("two", 400)}
    assert sorted(r["rank"] for r in out if r.id == 0) == list(range(1, 201)) and all(r["rank"] == r.rid + 1 for r in out)


def test_neighbours_of_many_at_few_places(spark):
    points = spark.range(4000).select("id", (F.col("id") % 7 * 3).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2).alias("p"))
    out, most = joined(spark, lambda: spatial.knn_edges(points, 3, 400.0, ["p"]).collect())
    assert len(out) == 12_000 and most <= 12_000
    assert all(r.distance == 0.0 and r.dst % 14 == r.src % 14 for r in out)
    assert sorted(r.dst for r in out if r.src == 15) == [1, 29, 43] and sorted(r.dst for r in out if r.src == 1415) == [1, 15, 29]


def test_reviews_make_no_pairs(spark):
    anchors = spark.range(500).select(F.format_string("%06d", "id").alias("official_identifier"), F.lit("one").alias("name"), F.lit("there").alias("address"), F.col("id").alias("line"))
    rows = spark.range(400).select(F.col("id").alias("row_id"), F.when(F.col("id") % 4 == 0, "000007").alias("official_identifier"), F.lit("ONE").alias("name"), F.when(F.col("id") % 4 != 1, "there").alias("address"))
    (candidates, reviews, _), _ = joined(spark, lambda: registers.match_register(anchors, rows, "doc"))
    out, most = joined(spark, reviews.collect)
    assert most <= 2000 and {(r.reason, r.candidate_count) for r in out} == {("exact_name_address", 500), ("exact_name_only", 500)}
    plan = candidates._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    ranks = {(r.row_id, r.line, r["rank"]) for r in candidates.filter("row_id IN (0, 1)").collect()}
    assert ranks == {(0, 7, 1)} | {(1, i, i + 1) for i in range(500)}


def test_months_share_their_distances(spark):
    months = [f"2024-{m:02d}" for m in range(1, 13)]
    at = lambda i: (float(i * 37 % 400), float(i * 91 % 300))
    rows = [(months[(i + j) % 11], *at(i)) for i in range(300) for j in range(i % 7)]
    cells = [(g, *at(g * 3 + 1), 2.0) for g in range(150)]
    snapshot, grid = spark.createDataFrame(rows, "month string, x double, y double"), spark.createDataFrame(cells, "grid_id long, x double, y double, window_area_km2 double")
    population = spark.createDataFrame([(m, g, 100.0) for m in months for g in range(150)], "month string, grid_id long, population double")
    out, most = joined(spark, lambda: ledger.analyze_monthly(snapshot, grid, population, (40.0, 90.0)).collect())
    assert most <= 12 * 150 and len(out) == 12 * 150 * 2
    for r in out:
        apart = [math.dist((x, y), cells[r.grid_id][1:3]) for m, x, y in rows if m == r.month] if r.month == "2024-03" else None
        if apart is not None:
            assert r.n == sum(d <= r.radius for d in apart) and (r.nearest is None) == (r.n == 0) and (r.n == 0 or r.nearest == pytest.approx(min(apart)))
        elif r.month == "2024-12":
            assert r.n is None and r.status == "missing_snapshot_month"
