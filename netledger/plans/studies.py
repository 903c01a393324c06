"""Whole studies as one operator each: access of people, spatial statistics, frames of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.operators import geocoding as gc, spatial as sp, statistics as stats
from netledger.plans.registers import access_summary
from netledger.session import stored


def distances(places: DataFrame, series: dict[str, DataFrame]) -> DataFrame:
    """(lid, series, distance): the distance of every place (lid, lat, lon) to the nearest facility (rid, lat,
    lon) of each series; null where a series has none."""
    out = None
    for name, facilities in series.items():
        found = sp.nearest(places.select("lid", "lat", "lon"), facilities).select("lid", F.lit(name).alias("series"), "distance")
        out = found if out is None else out.unionByName(found)
    return out


def accessibility(places: DataFrame, series: dict[str, DataFrame], strata: dict[str, Column], bands: tuple[int, ...] = (500, 1000, 2000, 5000)) -> DataFrame:
    """The summary of ``access_summary`` for every series and stratum, people counting in all strata that
    hold for their place. ``places`` (lid, lat, lon, people, elderly, ..); strata are tests of its columns."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in strata.items()]))
    people = places.select("lid", "people", "elderly", F.explode(names).alias("stratum"))
    return access_summary(people.join(distances(places, series), "lid"), ["series", "stratum"], bands=bands)


def spatial_statistics(points: DataFrame, part: list[str], k: int, cell: float, permutations: int = 99) -> DataFrame:
    """(part.., moran, expected, z_perm, p, hot_95, hot_99, cold_95, cold_99) of points (id, x, y, v): Moran's I
    over the k nearest neighbours with row-standardised weights, and the number of points whose Gi* is
    significant on either side."""
    edges = sp.knn_edges(points, k, cell, part).select("src", "dst")
    values = points.select("id", "v", *part)
    degree = edges.groupBy("src").agg((1.0 / F.count(F.lit(1))).alias("w"))
    moran = sp.moran_permutations(values, edges.join(degree, "src"), part, permutations)
    z = sp.getis_ord(values, edges, part)
    ends = {"hot_95": F.col("z") >= 1.96, "hot_99": F.col("z") >= 2.58, "cold_95": F.col("z") <= -1.96, "cold_99": F.col("z") <= -2.58}
    return moran.join(z.groupBy(*part).agg(*[F.count_if(test).alias(name) for name, test in ends.items()]), part)


def change_frames(counts: DataFrame, months: DataFrame, cells: DataFrame, base: str | Column) -> DataFrame:
    """(month, cell, n, class) for every month and cell: the class of the change of the count to that of the
    month ``base``. ``counts`` (month, cell, n) lacks cells without any; a month without a row at all is missing."""
    there = counts.select("month").distinct().withColumn("there", F.lit(True))
    first = counts.filter(F.col("month") == base).select("cell", F.col("n").alias("b"))
    spine = cells.select("cell").crossJoin(F.broadcast(months.select("month").distinct()))  # one row per month
    met = spine.join(there, "month", "left").join(counts, ["month", "cell"], "left").join(first, "cell", "left")
    n = F.when(F.col("there"), F.coalesce("n", F.lit(0)))
    change = stats.relative_change(F.nullif(F.coalesce("b", F.lit(0)), F.lit(0)), n)
    return met.select("month", "cell", n.alias("n"), stats.change_class(change, F.col("there").isNull()).alias("class"))


def month_number(day: Column) -> Column:
    """Months since the year 0."""
    return F.year(day) * 12 + F.month(day) - 1


def counts_over_time(positions: DataFrame, cells: DataFrame, months: DataFrame, radius: float) -> DataFrame:
    """(month, cell, n) for every month and cell: positions within ``radius`` of the cell at the month's end.

    ``positions`` (x, y, valid_from, valid_to) hold from the first day on until before the last; null ends are
    open, null places count nowhere. ``cells`` (cell, x, y), ``months`` (month, any day of it; repeated or null ones don't
    matter). Positions meet cells once, when they come and when they go, and not again for every month between:
    a cell's count is the running sum of its changes, over as many rows as there are months.
    """
    numbered = months.filter("month IS NOT NULL").groupBy(month_number(F.col("month")).alias("at")).agg(F.min("month").alias("month"))
    first = numbered.agg(F.min("at").alias("first"))
    change = F.array(F.struct(F.coalesce(month_number(F.col("valid_from")), F.lit(-1)).alias("at"), F.lit(1).alias("by")), F.struct(month_number(F.col("valid_to")).alias("at"), F.lit(-1).alias("by")))
    changes = positions.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y", F.explode(change).alias("c")).filter("c.at IS NOT NULL")
    changes = changes.crossJoin(F.broadcast(first)).groupBy("x", "y", F.greatest("c.at", "first").alias("at")).agg(F.sum("c.by").alias("by")).filter("by <> 0")  # one row
    changes = stored(changes)
    spots = changes.select("x", "y").distinct().withColumn("rid", F.struct("x", "y"))
    met = sp.radius_pairs(cells.select(F.col("cell").alias("lid"), "x", "y"), spots, radius).select(F.col("lid").alias("cell"), "rid.x", "rid.y")
    steps = met.join(changes, ["x", "y"]).groupBy("cell", "at").agg(F.sum("by").alias("by"))
    # a change in a month that isn't asked for counts from the next one on
    spine = cells.select("cell").distinct().crossJoin(F.broadcast(numbered)).withColumn("by", F.lit(0))  # one row per month
    upto = Window.partitionBy("cell").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)  # a cell's months
    told = spine.unionByName(steps.select("cell", "at", F.lit(None).cast(months.schema["month"].dataType).alias("month"), "by"))
    return told.withColumn("n", F.sum("by").over(upto)).filter("month IS NOT NULL").select("month", "cell", "n")


def change_over_time(positions: DataFrame, cells: DataFrame, months: DataFrame, missing: DataFrame, base: Column, radius: float) -> DataFrame:
    """(month, cell, n, class) of ``counts_over_time`` as ``change_frames`` gives them against the month ``base``; months
    (month) of ``missing`` have no counts."""
    counts = stored(counts_over_time(positions, cells, months, radius))
    there = counts.join(missing.select("month").distinct(), "month", "left_anti")
    return change_frames(there, counts.select("month"), cells, base)


def coordinate_series(offices: DataFrame, inherited: DataFrame, relocated: DataFrame) -> DataFrame:
    """(series, rid, lat, lon) of offices (rid, lat, lon, accuracy) under three policies: ``current`` places as they are,
    ``inherit_all`` with earlier places (rid, lat, lon) where the current one is known to the town or city only, and
    ``corrected``, which keeps the current place of offices (rid) that have moved."""
    old = inherited.groupBy("rid").agg(F.min(F.struct("lat", "lon")).alias("old"))
    met = offices.join(old, "rid", "left").join(relocated.select("rid").distinct().withColumn("moved", F.lit(True)), "rid", "left")
    rough = F.col("accuracy").isin("town", "city") & F.col("old").isNotNull()
    stays = rough & F.col("moved").isNull()
    pick = lambda test, c: F.when(test, F.col(f"old.{c}")).otherwise(F.col(c))
    fanned = gc.policies(met.select("rid", F.struct("lat", "lon").alias("own"), F.struct(pick(rough, "lat").alias("lat"), pick(rough, "lon").alias("lon")).alias("all"), F.struct(pick(stays, "lat").alias("lat"), pick(stays, "lon").alias("lon")).alias("kept")), {
        "current": (F.col("own.lat"), F.col("own.lon")), "inherit_all": (F.col("all.lat"), F.col("all.lon")), "corrected": (F.col("kept.lat"), F.col("kept.lon"))})
    return fanned.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("policy").alias("series"), "rid", "lat", "lon")


def corrected_access(places: DataFrame, offices: DataFrame, inherited: DataFrame, relocated: DataFrame, before: DataFrame, strata: dict[str, Column], far: float = 2000.0) -> DataFrame:
    """(series, stratum, status, people, mean_before, mean_after, mean_change, far_before, far_after, far_change): how
    access changed since the facilities ``before`` (rid, lat, lon), by policy of ``coordinate_series`` and stratum.

    Means are weighted by people; ``far`` counts people beyond that distance, and their change is in
    percent, null where nobody was far before. A group with a place that lacks a distance on either side is not evaluable. Places without people are left out.
    """
    made = stored(coordinate_series(offices, inherited, relocated))
    peopled = places.filter("people > 0")
    series = {name: made.filter(F.col("series") == name).drop("series") for name in ("current", "inherit_all", "corrected")}
    found = stored(distances(peopled, series | {"before": before}))
    base = found.filter("series = 'before'").select("lid", F.col("distance").alias("base"))
    names = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in strata.items()]))
    rows = peopled.select("lid", "people", F.explode(names).alias("stratum")).join(base, "lid").join(found.filter("series <> 'before'"), "lid")
    mean = lambda c: F.sum(F.col(c) * F.col("people")) / F.sum("people")
    beyond = lambda c: F.coalesce(F.sum(F.when(F.col(c) > far, F.col("people"))), F.lit(0).cast("long"))
    out = rows.groupBy("series", "stratum").agg(
        F.count_if(F.col("base").isNull() | F.col("distance").isNull()).alias("bad"), F.sum("people").alias("people"),
        mean("base").alias("mean_before"), mean("distance").alias("mean_after"), beyond("base").alias("far_before"), beyond("distance").alias("far_after"))
    good = F.col("bad") == 0
    figures = {"mean_before": F.col("mean_before"), "mean_after": F.col("mean_after"), "mean_change": F.col("mean_after") - F.col("mean_before"), "far_before": F.col("far_before"), "far_after": F.col("far_after"), "far_change": stats.relative_change(F.nullif("far_before", F.lit(0)), F.col("far_after"))}
    return out.select("series", "stratum", F.when(good, "computed").otherwise("not_evaluable").alias("status"), "people", *[F.when(good, v).alias(n) for n, v in figures.items()])
