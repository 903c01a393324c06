"""Operators of the main library on small fixtures with known results."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from netledger.functions import geo, text as tx
from netledger.operators import contracts, graph, inequality as ineq, linkage, running, spatial, statistics as stats, temporal as tm
from netledger.plans import ledger


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def numbers(spark, values, weights=None):
    return spark.createDataFrame([("g", float(v), float(w)) for v, w in zip(values, weights or [1] * len(values))], "g string, v double, w double")


def test_inequality_of_known_numbers(spark):
    d = numbers(spark, [0, 1, 2, 3])
    assert ineq.gini_pairwise(d, ["g"], "v", "w").first().gini == pytest.approx(5 / 12)
    assert ineq.theil_weighted(d, ["g"], "v", "w").first().theil == pytest.approx(0.3748900964)
    assert ineq.hoover(d, ["g"], "v", "w").first().hoover == pytest.approx(1 / 3)
    assert ineq.gini_pairwise(numbers(spark, [0, 1], [1, 1]), ["g"], "v", "w").first().gini == pytest.approx(0.5)
    assert ineq.gini_pairwise(numbers(spark, [0, 0]), ["g"], "v", "w").first().gini is None
    assert ineq.gini_pairwise(d.limit(0), ["g"], "v", "w").count() == 0


def test_quantiles_equal_the_standard_library(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 100) for _ in range(101)]
    r = ineq.quartiles_exclusive(numbers(spark, values), ["g"], "v").first()
    assert [r.q1, r.q2, r.q3] == pytest.approx(statistics.quantiles(values, n=4))
    near = ineq.nearest_rank(numbers(spark, values), ["g"], "v", {"p90": 0.9}).first()
    assert near.p90 == sorted(values)[round(100 * 0.9)]
    assert ineq.weighted_median(numbers(spark, [1, 2, 3], [1, 1, 2]), ["g"], "v", "w").first().weighted_median == 2


def test_running_sums_split_a_hot_group(spark):
    rows = [("hot", i, 1.0) for i in range(500)] + [("cold", i, 2.0) for i in range(3)]
    out = running.running_sums(spark.createDataFrame(rows, "g string, i int, w double"), ["g"], ["i"], {"c": "w"})
    assert all(r.c == r.i * r.w and r.c_total == (500 if r.g == "hot" else 6) for r in out.collect())


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 2000 + i) for i in range(200)] + [(5, 5), (7, None)]
    got = {r.vertex: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[2000 + i] for i in range(200)} == {1000} and 5 not in got and 7 not in got
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chain_problems_find_cycles_of_any_length(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, 11), (11, 12), (12, 10), (13, 10), (20, 20), (30, 99)]
    got = {(r.id, r.problem) for r in graph.chain_problems(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {(10, "cycle"), (11, "cycle"), (12, "cycle"), (20, "self"), (30, "missing")}


def test_replay_equals_applying_events_in_order(spark):
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    kinds = ["relocation", "renamed", "temporarily_closed", "reopened", "view"]
    events, anchors = [], []
    for e in range(12):
        state = 0
        for i in range(20):
            kind, new = rng.choice(kinds), rng.randint(1, 9)
            events.append((e, base + dt.timedelta(days=rng.randint(0, 27)), e * 100 + i, kind, state, new))
        anchors.append((e, base + dt.timedelta(days=14), 77, bool(e % 2)))
    cut = [base + dt.timedelta(days=d) for d in (3, 14, 22)]
    got = tm.replay(
        spark.createDataFrame(events, "entity int, at timestamp_ntz, event_id int, kind string, before int, after int"),
        spark.createDataFrame(anchors, "entity int, anchor_at timestamp_ntz, state int, available boolean"), spark.createDataFrame([(c,) for c in cut], "cutoff timestamp_ntz"),
    ).collect()
    want = {}
    for e, at, state, available in anchors:
        mine = sorted(x for x in events if x[0] == e)
        for c in cut:
            s, a = state, available
            for _, t, _, kind, before, after in mine if c >= at else reversed(mine):
                if c >= at and at < t <= c:
                    s, a = (after if kind in tm.STRUCTURAL else s), (kind == tm.REOPENED if kind in (tm.CLOSED, tm.REOPENED) else a)
                elif c < at and c < t <= at:
                    s, a = (before if kind in tm.STRUCTURAL else s), (kind == tm.CLOSED if kind in (tm.CLOSED, tm.REOPENED) else a)
            want[e, c] = (s, a)
    assert {(r.entity, r.cutoff): (r.state, r.available) for r in got} == want


def test_versions_go_back_and_forth(spark):
    rows = [("u", 1, "A"), ("u", 2, "A"), ("u", 3, "B"), ("u", 4, "A")]
    out = tm.version_upsert(spark.createDataFrame(rows, "url string, id int, sha string"), "url", ["id"], "sha").orderBy("id").collect()
    assert [(r.id, r.supersedes, r.is_current) for r in out] == [(1, None, False), (3, 1, False), (4, 3, True)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.uniform(-60, 70), rng.uniform(-100, 100)) for i in range(60)]
    right = [(i, rng.uniform(-60, 70), rng.uniform(-100, 100)) for i in range(25)]

    def far(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.MEAN_RADIUS * math.asin(min(1, math.sqrt(h)))

    got = {r.lid: r for r in spatial.nearest(spark.createDataFrame(left, "lid int, lat double, lon double"), spark.createDataFrame(right, "rid int, lat double, lon double"), 5.0).collect()}
    for a in left:
        best = min((far(a, b), b[0]) for b in right)
        assert got[a[0]].rid == best[1] and got[a[0]].distance == pytest.approx(best[0])


def test_moran_of_a_line_and_polygon_centroids(spark):
    values = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 2, 3))], "p int, id int, v double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src int, dst int, w double")
    assert spatial.global_moran(values, edges, ["p"]).first().moran == pytest.approx(0.0)
    assert spatial.global_moran(values.withColumn("v", F.lit(1.0)), edges, ["p"]).first().moran is None
    square = spark.createDataFrame([("s", 0, [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]])], "polygon string, ord int, rings array<array<struct<x:double,y:double>>>")
    assert tuple(spatial.polygon_centroid(square).first()) == ("s", 4.0, 1.0, 1.0)


def test_geodesy(spark):
    lit = lambda v: F.lit(float(v))
    r = one(spark, geo.ecef(lit(0), lit(0)).alias("e"), geo.equal_area(lit(36), lit(138)).alias("p"), geo.equal_area(lit(37), lit(138)).alias("n"), geo.mesh_centre(F.lit("5339452411")).alias("m"), geo.mesh_centre(F.lit("53394")).alias("bad"))
    assert r.e.x == pytest.approx(geo.SEMI_MAJOR) and (r.e.y, r.e.z) == (0, 0)
    assert (r.p.x, r.p.y) == pytest.approx((0, 0), abs=1e-6) and r.n.y == pytest.approx(110_970, rel=1e-3)
    assert r.bad is None and 35.6 < r.m.lat < 35.8 and 139.6 < r.m.lon < 139.8


def test_text_functions(spark):
    r = one(
        spark, tx.normalized(F.lit("ＡＢ－Ｃ  ß ")).alias("a"), tx.folded_name(F.lit("髙﨑 Ａ")).alias("b"), tx.kanji_blocks(F.lit("西12丁目")).alias("c"), tx.era_date(F.lit("H24.10.19")).alias("d"),
        tx.era_date(F.lit("R8.6.27")).alias("e"), tx.era_date(F.lit("M8.6.27")).alias("f"), tx.iso_date(F.lit("2026-02-30")).alias("g"), tx.mark_state(F.lit("☆")).alias("h"), tx.mark_state(F.lit("○")).alias("i"),
        tx.official_id(F.lit(" 000001A ")).alias("j"), tx.month_end(F.lit("2024-02")).alias("k"), tx.normalized_address(F.lit("大字東１ー２（北）")).alias("l"), tx.state_text(F.lit("テーブル ◎")).alias("m"), tx.safe_int(F.lit("-")).alias("n"),
    )
    assert (r.a, r.b, r.c, str(r.d), str(r.e), r.f, r.g, r.h, r.i, r.j, str(r.k), r.l, r.m, r.n) == (
        "ab-c ss", "高崎a", "西十二丁目", "2012-10-19", "2026-06-27", None, None, "unknown", "yes", "000001a", "2024-02-29", "大字東1-2(北)", "テ-ブル○", 0,
    )


def test_variant_characters(spark):
    r = one(
        spark, tx.folded_name(F.lit("ヶヵ髙﨑德邊邉澤齋齊惠檮嶋冨櫻瀨曾濱廣")).alias("a"), tx.normalized_address(F.lit(" 大字惠澤　眞－１ー２ヶ ")).alias("b"), tx.town_key(F.lit("字大字ヶヵッ濵")).alias("c"),
    )
    assert (r.a, r.b, r.c) == ("ケカ高崎徳辺辺沢斎斉恵梼島富桜瀬曽濱廣", "大字恵沢 真-1-2ヶ", "ケカツ浜")


def test_change_classes_by_their_bounds(spark):
    values = [-100.0, -20.0, -19.9, -10.0, -5.0, -0.5, -0.001, 0.0, 0.001, 5.0, 5.1, 2000.0, None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.c for r in d.select("i", stats.change_class(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 6, 6, 7]
    assert one(spark, stats.change_class(F.lit(1.0), F.lit(True)).alias("c")).c == 8


def test_permutations_against_the_expectation(spark):
    n, rng = 12, random.Random(4)
    value = {i: rng.uniform(0, 9) for i in range(n)}
    edges = [(i, (i + d) % n) for i in range(n) for d in (1, 2)]

    def index(v):
        m = statistics.mean(v.values())
        return statistics.mean((v[i] - m) * (v[j] - m) for i, j in edges) / statistics.pvariance(v.values())

    import hashlib

    runs = []
    for run in range(1, 20):
        order = sorted(value, key=lambda i: (hashlib.md5(f"{i}|{run}|1".encode()).hexdigest(), i))
        runs.append(index({i: value[place] for place, i in enumerate(order)}))
    values = spark.createDataFrame([(0, i, v) for i, v in value.items()] + [(1, 99, 1.0)], "g int, id int, v double")
    r = spatial.moran_permutations(values, spark.createDataFrame([(a, b, 0.5) for a, b in edges], "src int, dst int, w double"), ["g"], 19).first()
    expected, observed = -1 / (n - 1), index(value)
    assert (r.moran, r.expected) == pytest.approx((observed, expected))
    assert r.p == pytest.approx((1 + sum(abs(x - expected) >= abs(observed - expected) for x in runs)) / 20)
    assert r.z_perm == pytest.approx((observed - statistics.mean(runs)) / statistics.stdev(runs))


def test_nearest_over_the_antimeridian_and_without_places(spark):
    left = spark.createDataFrame([(1, 0.0, 179.99), (2, None, 1.0), (3, 0.0, -179.995), (4, 89.9, 0.0)], "lid int, lat double, lon double")
    right = spark.createDataFrame([(7, 0.0, -179.99), (8, 0.0, 179.0), (9, None, None), (10, 89.9, 180.0)], "rid int, lat double, lon double")
    got = {r.lid: r.rid for r in spatial.nearest(left, right).collect()}
    assert got == {1: 7, 2: None, 3: 7, 4: 10}


def test_nearest_on_the_ellipsoid(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(i, rng.uniform(-70, 70), rng.uniform(-180, 180)) for i in range(40)] + [(99, None, 0.0)], "lid int, lat double, lon double")
    right = spark.createDataFrame([(i, rng.uniform(-70, 70), rng.uniform(-180, 180)) for i in range(60)], "rid int, lat double, lon double")
    every = left.filter("lat IS NOT NULL").selectExpr("lid", "lat AS a", "lon AS b").crossJoin(right.selectExpr("rid", "lat AS c", "lon AS d"))
    by_lid = {}
    for r in every.select("lid", "rid", geo.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")).collect():
        by_lid.setdefault(r.lid, []).append((r.g, r.rid))
    got = {r.lid: (r.distance, r.rid) for r in spatial.nearest_geodesic(left, right, 8).collect()}
    assert got.pop(99) == (None, None)
    best = {i: min(v) for i, v in by_lid.items()}
    assert {i: r for i, (_, r) in got.items()} == {i: r for i, (_, r) in best.items()} and all(got[i][0] == pytest.approx(best[i][0], abs=1e-3) for i in best)
    few = {r.lid: len(r.near or ()) for r in spatial.nearest_few(left, right.limit(3), 8).collect()}
    assert few.pop(99) == 0 and set(few.values()) == {3}


def test_neighbours_leave_out_points_without_places(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 0.0, 0), (3, None, 1.0, 0), (4, float("nan"), 1.0, 0), (5, 9.0, 9.0, 1)], "id int, x double, y double, p int")
    assert {(r.src, r.dst) for r in spatial.knn_edges(points, 2, 1.0, ["p"]).collect()} == {(1, 2), (2, 1)}


def test_prefixes_of_any_length(spark):
    long = "p" * 300
    left, right = spark.createDataFrame([(1, long + "x"), (2, "p"), (3, ""), (4, None)], "id int, t string"), spark.createDataFrame([(long,), ("p",), (None,)], "prefix string")
    assert {r.id: r.prefix for r in linkage.longest_prefix(left, right, "t", "prefix", "id").collect()} == {1: long, 2: "p", 3: None, 4: None}
    assert linkage.longest_prefix(left, right.limit(0), "t", "prefix", "id").filter("prefix IS NOT NULL").count() == 0


def test_contracts_report_all_problems(spark):
    rows = [(1, 35.0, 139.0, "EPSG:6668", "town"), (2, None, 139.0, "EPSG:4326", "town"), (3, 99.0, 139.0, None, "street"), (4, None, None, "EPSG:6668", "unmatched")]
    d = spark.createDataFrame(rows, "id int, lat double, lon double, crs string, accuracy string")
    out = contracts.problems(d, contracts.coordinate_tests(F.col("lat"), F.col("lon"), F.col("crs"), F.col("accuracy"), 6668), "id")
    assert {r.code: r.sample for r in out.collect()} == {"half_missing": "2", "crs_wrong": "2", "crs_missing": "3", "outside": "3", "accuracy_unknown": "3"}
    assert contracts.overall(spark.createDataFrame([], "status string")).first().status == "not_evaluable"


def test_links_fall_through_the_cascade(spark):
    left = spark.createDataFrame([(1, "x", "n1"), (2, "", "n1"), (3, None, "none"), (4, "y", "")], "lid int, a string, b string")
    right = spark.createDataFrame([(10, "x", "n1"), (11, "q", "n1")], "rid int, ra string, rb string")
    out = linkage.decide(linkage.cascade(left, right, [("id", "a", "ra"), ("name", "b", "rb")], "lid", "rid"), "lid", "rid", ("id",))
    assert {(r.lid, r.rid, r.method, r.decision) for r in out.collect()} == {(1, 10, "id", "auto_accept"), (2, 10, "name", "manual_review"), (2, 11, "name", "manual_review"), (3, None, "unmatched", "unmatched"), (4, None, "unmatched", "unmatched")}


def test_series_admit_what_they_should(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        (1, "a", "relocation", "official", "confirmed", day, None, None, None, None, 0, 1), (2, "a", "temporarily_closed", None, "confirmed", day, None, None, None, None, 0, 1), (3, "a", "temporarily_closed", "unofficial", "announced", day, None, None, None, None, 0, 1),
        (4, "a", "relocation", "official", "confirmed", None, day, False, None, None, 0, 1), (5, "a", "relocation", "official", "confirmed", day, None, None, None, None, 0, 1), (6, "a", "relocation", "official", "confirmed", day, None, None, 5, None, 0, 1),
        (7, "a", "relocation", "official", "confirmed", day, None, None, None, 6, 0, 1),
    ]
    e = spark.createDataFrame(rows, "event_id int, entity string, kind string, provenance string, status string, confirmed date, planned date, corroborated boolean, revises int, cancels int, before int, after int")
    got = {s: sorted(r.event_id for r in ledger.active_events(e, s).collect()) for s in ledger.SERIES}
    assert got == {"formal": [1], "effective_official": [1, 2], "effective_with_unofficial": [1, 2, 3]}


def test_threads_follow_states_and_refuse_branches(spark):
    rows = [("a", 3, "z", "w"), ("a", 1, "x", "y"), ("a", 2, "y", "z"), ("b", 4, "x", "y"), ("b", 5, "y", "x"), ("c", 6, "p", "q"), ("d", 7, "x", "y"), ("d", 8, "y", "z"), ("d", 9, "y", "w")]
    out = tm.threaded(spark.createDataFrame(rows, "g string, id int, before string, after string"), ["g"], "id", "before", "after").collect()
    assert {r.id: r.place for r in out} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: 0, 7: None, 8: None, 9: None}


def test_captures_link_before_conflicts_go(spark):
    rows = [("u", "1", "A", 0), ("u", "2", "B", 1), ("u", "2", "C", 2), ("u", "3", "A", 3), ("u", "4", "D", 4)]
    out = {(r.captured_at, r.digest): r.supersedes for r in ledger.captures(spark.createDataFrame(rows, "url string, captured_at string, digest string, ord int")).collect()}
    assert out == {("1", "A"): None, ("4", "D"): "2"}


def test_geodesic_is_near_the_great_circle(spark):
    rows = [(35.0, 139.0, 35.0, 139.0), (35.0, 139.0, 43.0, 141.0), (0.0, 0.0, 0.0, 1.0), (-30.0, 179.5, -31.0, -179.5), (None, 1.0, 2.0, 3.0), (0.0, 0.0, 0.1, 179.9)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    out = d.select(geo.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g"), geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("h")).collect()
    assert out[0].g == 0 and out[4].g is None
    assert out[2].g == pytest.approx(111_319.4908, abs=1e-3)
    assert all(r.g == pytest.approx(r.h, rel=6e-3) for r in out[1:4]) and out[5].g is not None


def test_fixed_width_text(spark):
    r = one(
        spark, tx.address_start(F.lit("京都局 東京都港区")).alias("a"), tx.address_start(F.lit("none")).alias("b"), tx.display_width(F.lit("a東b")).alias("c"), tx.slice_columns(F.lit("a東bc"), 1, 4).alias("d"),
        tx.address_start(F.lit("東京都 大阪府北区")).alias("e"),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (4, None, 4, "東b", 4)


def test_row_digests_depend_on_order_and_content(spark):
    d = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k int, v string")
    a = contracts.rows_digest(d, ["k"]).first()
    assert a.rows == 50 and a == contracts.rows_digest(d.repartition(7), ["k"]).first()
    assert a.digest != contracts.rows_digest(d, ["v"]).first().digest
    assert a.digest != contracts.rows_digest(d.withColumn("v", F.when(F.col("k") == 7, "x").otherwise(F.col("v"))), ["k"]).first().digest
    assert contracts.rows_digest(d.limit(0), ["k"]).first().rows == 0


def test_guards_and_descriptors(spark):
    day = F.lit("2024-05-01").cast("date")
    none = F.lit(None).cast("date")
    r = one(
        spark, contracts.usable_at(day, F.lit("EPSG:6668"), 6668, none, none).alias("a"), contracts.usable_at(day, F.lit("EPSG:6668"), 6668, F.lit("2024-06-01").cast("date"), none).alias("b"),
        contracts.usable_at(day, F.lit("EPSG:4326"), 6668, none, none).alias("c"), contracts.usable_at(day, F.lit(None).cast("string"), 6668, none, none).alias("d"),
        contracts.usable_at(day, F.lit("EPSG:6668"), 6668, none, day).alias("e"),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, False, False, True)
    guard = lambda rows: spark.createDataFrame(rows, "d double, p long, q long").agg(contracts.access_guard(F.col("d"), F.col("p"), F.col("q")).alias("g")).first().g
    assert guard([(500.0, 100, 20)]) is None and guard([(None, 100, 20)]) == "not_evaluable" and guard([(1.0, 100, 200)]) == "bad_population" and guard([]) == "zero_population"
    fields = [("x", "int")]
    rows = [
        ("a", "road", "t", "p", "csv", "text/csv", "2024-01-01", "node", "point", "l", "x", 6668, fields, None, False, None), ("b", "g", "t", "p", "csv", "", "2024-02-30", "node", "point", "", "x", None, [("", "int")], None, True, None),
        ("c", "population_mesh", "t", "p", "csv", "m", "2024-01-01", "mesh", "polygon", "l", "x", 0, None, " ", None, "r"), ("d", "population_mesh", "t", "p", "csv", "m", "2024-01-01", "mesh", "polygon", "l", "x", 6668, fields, "persons", True, "r"),
    ]
    d = spark.createDataFrame(
        rows, "dataset_id string, family string, title string, publisher string, format string, mime string, coverage_date string, granularity string, geometry string, license string, terms string, crs_epsg int, "
        "field_schema array<struct<name:string,type:string>>, units string, public_release_allowed boolean, release_review_id string",
    )
    got = {(x.code, x.sample) for x in contracts.problems(d, contracts.descriptor_tests(), "dataset_id").collect()}
    assert got == {
        ("mime_missing", "b"), ("license_missing", "b"), ("family_unknown", "b"), ("coverage_date_bad", "b"), ("crs_bad", "b,c"), ("field_schema_bad", "b,c"), ("units_missing", "c"), ("release_flag_missing", "c"), ("release_without_review", "b"),
    }
    assert contracts.config_problems([2, 5], ["2024-01", "2024-02"], [0, 0, 1, 1], (2, 5)) == []
    assert contracts.config_problems([2], ["2024-13"], [1, 0, 1, 1], (2, 5)) == ["radii_not_fixed", "months_not_sorted_unique", "extent_not_ordered"]


def test_states_and_backfill(spark):
    cell = lambda raw, norm: F.struct(F.lit(raw).alias("raw"), F.lit(norm).alias("normalized"))
    services = F.array(F.lit("Ａ "), F.lit(None).cast("string"))
    r = one(
        spark, tx.cell_text(cell("x", " ")).alias("a"), tx.cell_text(cell("x", "y")).alias("b"), tx.state_key([F.lit("東京 ")], services).alias("k"), tx.state_key([F.lit("東京")], services).alias("l"),
        tx.state_key([F.lit("")], services).alias("m"), tx.state_key([F.lit(None).cast("string")], services).alias("n"),
    )
    assert (r.a, r.b) == ("x", "y") and r.k == r.l and r.m != r.n
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert [x.k for x in linkage.backfill(keys("d", "a", "b", "b"), keys("a"), "k", 2).collect()] == ["b", "d"]
    with pytest.raises(ValueError):
        linkage.backfill(keys("a"), keys("b"), "k", 9)
