"""Studies over time on fixtures small enough to count by hand."""

import datetime as dt

from pyspark.sql import functions as F

from netledger.plans import studies

D = dt.date


def counts(spark, positions, months, radius=1.0):
    p = spark.createDataFrame(positions, "x double, y double, valid_from date, valid_to date")
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 10.0)], "cell string, x double, y double")
    m = spark.createDataFrame([(d,) for d in months], "month date")
    return {(r.month.month, r.cell): r.n for r in studies.counts_over_time(p, cells, m, radius).collect()}


def test_positions_count_from_their_first_month_until_they_end(spark):
    months = [D(2020, 1, 1), D(2020, 2, 1), D(2020, 4, 1)]  # no March
    rows = [(0.0, 0.5, None, D(2020, 2, 10)), (0.0, 0.0, D(2020, 1, 31), None), (0.0, 0.0, D(2020, 3, 5), D(2020, 4, 30)), (0.0, 0.0, D(2020, 3, 5), D(2020, 5, 1)), (10.0, 10.0, D(2019, 1, 1), D(2019, 6, 1)),
            (10.0, 10.0, D(2020, 2, 3), D(2020, 2, 20)), (None, 0.0, None, None), (10.0, 10.9, D(2020, 2, 29), None), (10.0, 10.9, D(2020, 2, 29), None)]
    assert counts(spark, rows, months) == {(1, "a"): 2, (2, "a"): 1, (4, "a"): 2, (1, "b"): 0, (2, "b"): 2, (4, "b"): 2}


def test_counts_without_positions_or_months(spark):
    assert counts(spark, [], [D(2020, 1, 1), D(2020, 1, 1), None]) == {(1, "a"): 0, (1, "b"): 0}
    assert counts(spark, [(0.0, 0.0, None, None)], []) == {}


def test_policies_keep_moved_offices_where_they_are(spark):
    offices = spark.createDataFrame([(1, 1.0, 1.0, "town"), (2, 2.0, 2.0, "block"), (3, 3.0, 3.0, "city"), (4, None, None, "unmatched"), (5, 5.0, 5.0, "town")], "rid int, lat double, lon double, accuracy string")
    old = spark.createDataFrame([(1, 11.0, 1.0), (2, 12.0, 2.0), (3, 13.0, 3.0)], "rid int, lat double, lon double")
    moved = spark.createDataFrame([(3,), (3,)], "rid int")
    out = studies.coordinate_series(offices, old, moved).groupBy("series").agg(F.sort_array(F.collect_list("lat")).alias("at")).collect()
    assert {r.series: r["at"] for r in out} == {"current": [1, 2, 3, 5], "inherit_all": [2, 5, 11, 13], "corrected": [2, 3, 5, 11]}


def test_groups_without_a_distance_are_not_evaluable(spark):
    places = spark.createDataFrame([(1, 35.0, 139.0, 10), (2, 36.0, 139.0, 0)], "lid int, lat double, lon double, people int")
    offices = spark.createDataFrame([(1, 35.0, 139.0, "town")], "rid int, lat double, lon double, accuracy string")
    none = offices.filter("false").select("rid", "lat", "lon")
    out = studies.corrected_access(places, offices, none, none.select("rid"), none, {"all": F.lit(True)}).collect()
    assert {(r.series, r.status, r.people, r.mean_after) for r in out} == {(s, "not_evaluable", 10, None) for s in ("current", "inherit_all", "corrected")}
