"""Running sums and ranks that don't need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from netledger.session import checkpointed


def spare(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is not taken."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def running_sums(df: DataFrame, by: list[str], order: list[str], measures: dict[str, str]) -> DataFrame:
    """``df`` with a column per measure: the sum of its source column over all rows of the group that
    come before in ``order``, and ``<name>_total`` over the group.

    Rows are dealt into ranges of (group, order), so a large group is split over many tasks. Sums of
    the ranges give each range its offset; a window within the range gives each row its own. Ties in
    ``order`` stay together, so name enough columns to tell rows apart. The cost is one range shuffle
    and one hash shuffle of the rows, and a table of one row per group and range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = spare("_range", df.columns)
    inner = {m: spare(f"_{m}_in", df.columns) for m in measures}
    dealt = df.repartitionByRange(n, *by, *order).withColumn(span, F.spark_partition_id())
    dealt = checkpointed(dealt)  # the number of a partition must not change between the two uses
    sums = dealt.groupBy(*by, span).agg(*[F.sum(c).alias(f"_{m}") for m, c in measures.items()])
    group = Window.partitionBy(*by)
    before = group.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *by, span,
        *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_start") for m in measures],
        *[F.sum(f"_{m}").over(group).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*by, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt
    for m, c in measures.items():
        placed = placed.withColumn(inner[m], F.coalesce(F.sum(c).over(inside), F.lit(0)))
    on = F.col(f"r.{span}") == F.col(f"s.{span}")
    for b in by:
        on = on & F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}"))
    # there may be as many groups as rows, which estimates from the size of files miss
    joined = placed.alias("r").join(starts.alias("s").hint("merge"), on)
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[(F.col(f"r.{inner[m]}") + F.col(f"s._{m}_start")).alias(m) for m in measures],
        *[F.col(f"s.{m}_total") for m in measures],
    )


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (1, 2, ..) within the group and ``n``, the size of the group."""
    one, before = spare("_one", df.columns), spare("_before", df.columns)
    out = running_sums(df.withColumn(one, F.lit(1)), by, order, {before: one})
    return out.select(*df.columns, (F.col(before) + 1).alias("rank"), F.col(f"{before}_total").alias("n"))


def followed(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``rank`` within the group and ``next``, a struct of ``columns`` of the row after it; a null struct
    for the last. Rows meet by group and rank, so a large group is split over many tasks."""
    one, before = spare("_one", df.columns), spare("_before", df.columns)
    out = running_sums(df.withColumn(one, F.lit(1)), by, order, {before: one})
    numbered = checkpointed(out.select(*df.columns, (F.col(before) + 1).alias("rank")))
    after = numbered.select(*by, (F.col("rank") - 1).alias("rank"), F.struct(*columns).alias("next"))
    on = F.col("r.rank") == F.col("s.rank")
    for b in by:
        on = on & F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}"))
    return numbered.alias("r").join(after.alias("s"), on, "left").select("r.*", "s.next")
