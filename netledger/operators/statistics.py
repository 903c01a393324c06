"""Counts, rates, rollups, histograms, gates, extremes and series over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exact_mean(c: str, scale: int = 10) -> Column:
    """The mean of a column of doubles from their sum as decimals, so that it depends on no order of rows. Values
    of more digits behind the point are rounded to ``scale``; groups with values that no decimal holds have the plain mean."""
    whole = F.col(c).try_cast(f"decimal(28,{scale})")
    return F.when(F.count(whole) == F.count(c), F.try_divide(F.sum(whole).cast("double"), F.count(c))).otherwise(F.avg(c))


def counts_by(df: DataFrame, by: list[str], predicates: dict[str, Column]) -> DataFrame:
    """One count per predicate and group, in a single map-side combined aggregate."""
    return df.groupBy(*by).agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def with_labels(units: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Every unit with its counts; units without any have zeros."""
    joined = units.join(counts, keys, "left")
    return joined.fillna(0, [c for c in counts.columns if c not in keys])


def rates_by_definition(df: DataFrame, definitions: dict[str, Column], before: str, after: str, people: str) -> DataFrame:
    """The same rows aggregated under several membership definitions at once.

    Each row is expanded to (definition, side) pairs in the map phase; sums are combined before the
    shuffle, so the expansion does not travel.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("definition"), member.alias("side")) for name, member in definitions.items()])
    expanded = df.select(F.explode(pairs).alias("d"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (before, after, people)])
    out = expanded.groupBy("d.definition", "d.side").agg(
        F.count(F.lit(1)).alias("units"), F.sum(people).alias("people"), F.sum(before).alias("before"), F.sum(after).alias("after")
    )
    rate = F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100
    return out.select("definition", "side", "units", "people", "before", "after", rate.alias("rate"), F.try_divide("people", "after").alias("per_head"))


def rollup_share(df: DataFrame, level: str, facilities: str, people: str) -> DataFrame:
    """Sums per level and in all (null level), share of all facilities, and facilities per 10,000 people."""
    out = df.rollup(level).agg(F.sum(facilities).alias("facilities"), F.sum(people).alias("people"), F.grouping(level).alias("_all"))
    whole = out.filter("_all = 1").select(F.col("facilities").alias("_whole"))
    joined = out.crossJoin(F.broadcast(whole))  # one row
    return joined.select(
        level, "facilities", "people", F.try_divide("facilities", "_whole").alias("share"), (F.try_divide("facilities", "people") * 10000).alias("per_10k")
    )


def relative_change(before: Column, after: Column) -> Column:
    """Percent change; null on a zero or null base."""
    return F.try_divide(after - before, before.cast("double")) * 100


def change_to_previous(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``value`` with its previous one in order of ``at`` and the difference, for aggregated series."""
    w = Window.partitionBy(*by).orderBy(at)
    return df.select(*by, at, value, F.lag(value).over(w).alias("previous"), (F.col(value) - F.lag(value).over(w)).alias("delta"))


#: Upper bounds of the change classes 0 to 5 in percent, each inclusive; 6 lies above.
CHANGE_BOUNDS = (-20, -10, -5, -0.001, 0.001, 5)
NO_BASE, NO_MONTH = 7, 8


def change_class(percent: Column, missing: Column | None = None) -> Column:
    """Class of a percent change: 0 to 6 by its bounds, 7 where there is none for lack of a base, 8
    where ``missing`` says that the month itself is missing."""
    out = F.when(percent.isNull(), NO_BASE) if missing is None else F.when(missing, NO_MONTH).when(percent.isNull(), NO_BASE)
    for i, bound in enumerate(CHANGE_BOUNDS):
        out = out.when(percent <= bound, i)
    return out.otherwise(len(CHANGE_BOUNDS))


def class_histogram(df: DataFrame, column: str) -> DataFrame:
    """(class, n, share, tail_share): tail_share is that of the class and all below it."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    everything, upto = Window.partitionBy(), Window.orderBy(column)
    total = F.sum("n").over(everything)
    return counts.select(column, "n", (F.col("n") / total).alias("share"), (F.sum("n").over(upto) / total).alias("tail_share"))


def extremes(df: DataFrame, value: str, tie: list[str], lowest: int, highest: int = 0) -> DataFrame:
    """The ends of an order: (.., place, side). Each end is a top-k, so no full sort takes place."""
    ends = []
    for side, k, order in (("lowest", lowest, F.col(value).asc()), ("highest", highest, F.col(value).desc())):
        if k:
            top = df.orderBy(order, *tie).limit(k)
            ends.append(top.select("*", F.row_number().over(Window.orderBy(order, *tie)).cast("long").alias("place"), F.lit(side).alias("side")))
    out = ends[0]
    for other in ends[1:]:
        out = out.unionByName(other)
    return out


def gaps(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """(by.., day) of the days between the first and last of a group that it lacks.

    Successive days are compared, so only the missing days are made.
    """
    w = Window.partitionBy(*by).orderBy(day)
    step = df.select(*by, day).distinct().select(*by, F.col(day).alias("_to"), F.lag(day).over(w).alias("_from"))
    open_ends = step.filter(F.datediff("_to", "_from") > 1)
    return open_ends.select(*by, F.explode(F.sequence(F.date_add("_from", 1), F.date_sub("_to", 1))).alias(day))


def sampling_gate(df: DataFrame, by: list[str], sampled: Column, least: int = 200, share: float = 0.05) -> DataFrame:
    """(by.., n, have, required, status): at least min(n, max(least, share of n)) rows must be sampled."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(sampled).alias("have"))
    required = F.least(F.col("n"), F.greatest(F.lit(least), F.ceil(F.col("n") * share))).cast("long")
    status = F.when(F.col("n") == 0, "not_evaluable").when(F.col("have") >= required, "pass").otherwise("fail")
    return out.select(*by, "n", "have", required.alias("required"), status.alias("status"))


def reason_counts(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(reason, n) where a row counts for each reason that holds: one pass, one row per reason."""
    counted = df.agg(*[F.count_if(c).alias(name) for name, c in reasons.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("reason"), F.col(name).alias("n")) for name in reasons])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")
