"""Measures of inequality and weighted quantiles, in closed form.

Null, empty and degenerate inputs give a null measure, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netledger.operators.running import ranked, running_sums


def gini_pairwise(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by.., gini): sum of w_i w_j |v_i - v_j| over all pairs / (2 W sum(w v)).

    With rows in order of value, twice the sum over pairs is the sum of w (v W_before - S_before), W
    and S being running sums of w and of w v. Null if any value or weight is negative or the total
    isn't positive.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    rows = rows.withColumn("wv", F.col("v") * F.col("w"))
    run = running_sums(rows, by, ["v", "w"], {"cum_w": "w", "cum_wv": "wv"})
    pairs = F.sum(F.col("w") * (F.col("v") * F.col("cum_w") - F.col("cum_wv")))
    ok = (F.min("v") >= 0) & (F.min("w") >= 0) & (F.max("cum_wv_total") > 0)
    return run.groupBy(*by).agg(F.when(ok, pairs / (F.max("cum_w_total") * F.max("cum_wv_total"))).alias("gini"))


def lorenz(df: DataFrame, by: list[str], value: str, people: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Rows with people > 0 and their cumulative shares of people and value, in order of value per head;
    ``tie`` names columns that order rows of equal value and people."""
    rows = df.filter(F.col(people) > 0).withColumn("_per", F.col(value) / F.col(people)).withColumn("_p", F.col(people).cast("double")).withColumn("_n", F.col(value).cast("double"))
    run = running_sums(rows, by, ["_per", people, value, *tie], {"cum_p": "_p", "cum_n": "_n"})
    share = lambda c: F.try_divide(F.col(f"cum_{c}") + F.col(f"_{c}"), F.col(f"cum_{c}_total"))
    return run.withColumn("people_share", share("p")).withColumn("value_share", share("n"))


def gini_lorenz(df: DataFrame, by: list[str], value: str, people: str) -> DataFrame:
    """(by.., gini): one less twice the area under the Lorenz curve, by trapezoids."""
    run = lorenz(df, by, value, people)
    area = F.sum(F.try_divide(F.col("_p") * (2 * F.col("cum_n") + F.col("_n")), 2 * F.col("cum_p_total") * F.col("cum_n_total")))
    return run.groupBy(*by).agg((1 - 2 * area).alias("gini"))


def theil_weighted(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by.., theil): weighted Theil T over positive values; the mean includes zeros.

    sum(w (v/m) ln(v/m)) expands into sums of w v ln v, so one aggregate does.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    mean = F.try_divide(F.sum(w * v), F.sum(w))
    logs = F.sum(F.when(v > 0, w * v * F.ln(v)))
    positive = F.sum(F.when(v > 0, w * v))
    theil = F.try_divide(logs - positive * F.ln(F.when(mean > 0, mean)), mean * F.sum(w))
    return df.groupBy(*by).agg(theil.alias("theil"))


def _share_theil(n: Column, p: Column, N: Column, P: Column) -> Column:
    return (n / N) * F.ln((n / N) / (p / P))


def theil_share(df: DataFrame, by: list[str], value: str, people: str) -> DataFrame:
    """(by.., theil) of shares; rows without people or value are out of the totals, too."""
    rows = df.filter((F.col(people) > 0) & (F.col(value) > 0))
    n, p = F.col(value).cast("double"), F.col(people).cast("double")
    N, P = F.sum(n), F.sum(p)
    # sum of (n/N) ln(n P / (p N)) = sum(n ln(n/p)) / N + ln(P/N)
    return rows.groupBy(*by).agg((F.sum(n * F.ln(n / p)) / N + F.ln(P / N)).alias("theil"))


def theil_decomposition(df: DataFrame, group: str, value: str, people: str) -> DataFrame:
    """One row (between, within, total): Theil by groups from two levels of aggregation."""
    rows = df.filter((F.col(people) > 0) & (F.col(value) > 0))
    n, p = F.col(value).cast("double"), F.col(people).cast("double")
    groups = rows.groupBy(group).agg(F.sum(n).alias("n"), F.sum(p).alias("p"), F.sum(n * F.ln(n / p)).alias("l"))
    inner = F.col("l") / F.col("n") + F.ln(F.col("p") / F.col("n"))
    out = groups.agg(
        F.sum("n").alias("N"), F.sum("p").alias("P"), F.sum(F.col("n") * F.ln(F.col("n") / F.col("p"))).alias("b"), F.sum(F.col("n") * inner).alias("w")
    )
    between, within = F.col("b") / F.col("N") + F.ln(F.col("P") / F.col("N")), F.col("w") / F.col("N")
    return out.select(between.alias("between"), within.alias("within"), (between + within).alias("total"))


def hoover(df: DataFrame, by: list[str], value: str, people: str) -> DataFrame:
    """(by.., hoover): half the sum of |value share - people share|."""
    n, p = F.col(value).cast("double"), F.col(people).cast("double")
    totals = df.groupBy(*by).agg(F.sum(n).alias("_N"), F.sum(p).alias("_P"))
    joined = df.join(totals, by) if by else df.crossJoin(F.broadcast(totals))  # one row of totals
    return joined.groupBy(*by).agg((F.sum(F.abs(F.try_divide(n, F.col("_N")) - F.try_divide(p, F.col("_P")))) / 2).alias("hoover"))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by.., weighted_median): least value at which the running weight reaches half the total."""
    summed = df.groupBy(*by, value).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    run = running_sums(summed, by, [value], {"cum": "_w"})
    reached = (F.col("cum_total") > 0) & (F.col("cum") + F.col("_w") >= F.col("cum_total") / 2)
    return run.groupBy(*by).agg(F.min(F.when(reached, F.col(value))).alias("weighted_median"))


def quartiles_exclusive(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., n, q1, q2, q3) by the exclusive method: position i (n + 1) / 4 between ranks."""
    rows = ranked(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")), by, ["v"])
    out = []
    for i in (1, 2, 3):
        j = F.least(F.greatest(F.floor(i * (F.col("n") + 1) / 4), F.lit(1)), F.col("n") - 1)
        d = i * (F.col("n") + 1) - 4 * j
        part = F.when(F.col("rank") == j, F.col("v") * (4 - d)).when(F.col("rank") == j + 1, F.col("v") * d)
        out.append(F.when(F.max("n") > 1, F.sum(part) / 4).otherwise(F.max("v")).alias(f"q{i}"))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *out)


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by.., n, <name>..): the value of rank rint((n - 1) share) + 1, halves to even."""
    rows = ranked(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")), by, ["v"])
    at = lambda p: F.least(F.rint((F.col("n") - 1) * F.lit(p)), F.col("n") - 1) + 1
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("rank") == at(p), F.col("v"))).alias(k) for k, p in shares.items()])
