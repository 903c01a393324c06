import itertools

from pyspark.sql import functions as F

from netledger.operators.statistics import exact_mean


def _added(values):
    out = 0.0
    for v in values:  # sum() of newer versions of Python makes up for rounding
        out += v
    return out


def test_no_order_of_rows_moves_a_tie(spark):
    """42.5 / 5 is a tie that float sums miss in some orders."""
    orders = sorted(set(itertools.permutations((5.51, 23.32, 2.59, 10.45, 0.63))))
    assert any(_added(o) / 5 < 8.5 for o in orders)
    rows = [(i, v) for i, o in enumerate(orders) for v in o]
    df = spark.createDataFrame(rows, "g int, v double").repartition(8, "v")
    out = df.groupBy("g").agg(F.round(exact_mean("v"), 0).alias("spot")).groupBy("spot").count().collect()
    assert [tuple(r) for r in out] == [(9.0, len(orders))]


def test_values_that_no_decimal_holds_keep_the_plain_mean(spark):
    df = spark.createDataFrame([(1, 1e300), (1, 3e300), (2, None), (3, 0.5), (3, None)], "g int, v double")
    assert dict(df.groupBy("g").agg(exact_mean("v").alias("m")).collect()) == {1: 2e300, 2: None, 3: 0.5}
