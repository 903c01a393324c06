"""Mixing sources to target weights.

Documents get hash-random keys, which split each source into ranges of equal width. Token counts
are summed per (source, range), and per GROUP ranges; running sums over the groups of a source and
within each group give every range its offset, and a window inside each range gives every document its
own. So the order of a source is a range sort whose bounds are known beforehand, and neither a hot
source nor a large one meets in one task. Each source is then cut at its exact budget: whole epochs
first, then a prefix of the shuffled order.

A null source is a source of its own. Texts without words have size zero and are never taken. Keys
come from ids, or from texts where ids are null; rows with equal keys are ordered by id, size and
digest, and rows equal in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netledger.llm.common import SPACE, named, table, words
from netledger.session import stored

#: The weights that sources take in turn, and how often a source may be repeated.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3

#: Rows of the whole table per key range; a range holds at most that many of one source on average.
RANGE_ROWS = 512
#: Ranges whose offsets are summed together.
GROUP = 4096


def size_of(text: Column) -> Column:
    """Number of words: what is left of the runs between white space."""
    short = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(short, SPACE, "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Shares are proportional to the weights, except that a source stops at ``most`` times its size
    and leaves its excess to the others. With sources ordered by cap per weight, those up to some
    place are capped and the rest share what the caps leave, so two running sums decide. The table
    of sources is small by nature: the weights are a setting of each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # once a source stays under its cap, all later ones do; they share at the level of the first
    s = s.withColumn("place", F.row_number().over(order))
    share = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)["level"]
    return s.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share * F.col("weight")).alias("target")
    )


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) as the struct ``row``, with doc_id, source, size and digest."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))


def _key(seed: str = "mix") -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), "digest")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """Rows of ``sized`` with source_size, target and taken.

    ``taken`` counts words with repeats. It is a multiple of the size except for the one document of
    each source at which the budget ends. Columns that aren't used later don't travel.
    """
    rows = docs.withColumn("key", _key(seed))
    # a range is named by the leading bits of the key; their number follows the number of rows
    ranges = max(1, -(-docs.count() // RANGE_ROWS))
    leading = F.conv(F.substring("key", 1, 8), 16, 10).cast("double")
    cut = rows.withColumn("range", F.floor(leading * ranges / 2.0**32))
    sums = cut.groupBy("source", "range").agg(F.sum("size").alias("sum")).withColumn("group", F.floor(F.col("range") / GROUP))
    earlier = lambda *by: Window.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source", "group").agg(F.sum("sum").alias("total"))
    skips = groups.select("source", "group", F.coalesce(F.sum("total").over(earlier("group")), F.lit(0)).alias("skip"))
    offsets = sums.withColumn("inner", F.coalesce(F.sum("sum").over(earlier("group", "range")), F.lit(0)))
    shares = targets(groups.groupBy("source").agg(F.sum("total").alias("source_size")), weights, most)
    heads = skips.alias("o").join(shares.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(F.col("o.source").alias("source"), "group", "skip", "source_size", "target")
    starts = offsets.alias("o").join(heads.alias("h"), F.col("o.source").eqNullSafe(F.col("h.source")) & (F.col("o.group") == F.col("h.group"))).select(
        F.col("o.source").alias("source"), "range", (F.col("skip") + F.col("inner")).alias("offset"), "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("c").join(
        starts.hint("merge").alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.range") == F.col("s.range"))
    )
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select(*[F.col(f"c.{c}") for c in docs.columns], "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once: their sizes are stored, and the mix reads those twice
    slim = stored(sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "digest"))
    return mix(slim).select("doc_id", "size", "source_size", "target", "taken")


def _order() -> Column:
    """What the rows of a source are ordered by."""
    return F.struct(_key().alias("key"), F.col("doc_id"), F.col("size"), F.col("digest"))


def cuts(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, epochs, edge, n_edge, full, rest), one row per source: how its budget falls in its order.

    All rows are taken ``epochs`` times. Those before the row ``edge`` are taken once more, and those after it
    aren't; of the ``n_edge`` rows that are equal to it (repeated ones) ``full`` are, and one gives ``rest`` words.
    """
    rows = mix(slim, weights, most).withColumn("order", _order())
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs).withColumn("extra", F.col("taken") - F.col("epochs") * F.col("size"))
    more = F.col("extra") > 0
    whole = F.col("extra") == F.col("size")
    last = rows.groupBy("source").agg(F.first("epochs").alias("epochs"), F.coalesce(F.max(F.when(more & ~whole, F.col("order"))), F.max(F.when(more, F.col("order")))).alias("edge"))
    last = stored(last)
    at = F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.order") == F.col("l.edge"))
    equal = rows.alias("r").join(last.alias("l"), at).groupBy(F.col("l.source").alias("source")).agg(
        F.count(F.lit(1)).alias("n_edge"), F.count_if(more & whole).alias("full"), F.max(F.when(more & ~whole, F.col("extra"))).alias("rest"))
    return last.alias("l").join(equal.alias("e"), F.col("l.source").eqNullSafe(F.col("e.source")), "left").select("l.*", *[F.coalesce(f"e.{c}", F.lit(0)).alias(c) for c in ("n_edge", "full", "rest")])


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Where a source's budget ends within a
    document, the last copy holds the words that are left, with single spaces between them.

    Texts are not shuffled: their sizes are stored, the budget of each source is cut on these, and every
    row is told by where it stands against the cut of its source. Only rows that are equal to that at a cut, and
    are there several times, meet to be numbered.
    """
    slim = stored(sized(docs).select("doc_id", "source", "size", "digest"))
    edges = stored(cuts(slim, weights, most))  # a row per source; Spark broadcasts it by its size
    met = sized(docs).withColumn("order", _order()).alias("m").join(edges.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source")))
    met = met.select("m.row", "m.size", "m.source", F.col("m.order").alias("order"), "t.epochs", "t.edge", "t.n_edge", "t.full", "t.rest")
    equal = F.coalesce(F.col("order") == F.col("edge"), F.lit(False))
    alone = ~equal | (F.col("n_edge") == 1)
    place = Window.partitionBy("source").orderBy("order")
    placed = met.filter(alone).withColumn("place", F.lit(1)).unionByName(met.filter(~alone).withColumn("place", F.row_number().over(place)))
    extra = F.when(F.col("edge").isNull(), 0).when(equal, F.when(F.col("place") <= F.col("full"), F.col("size")).when(F.col("place") == F.col("full") + 1, F.col("rest")).otherwise(0)).when(F.col("order") < F.col("edge"), F.col("size")).otherwise(0)
    out = placed.withColumn("extra", extra).filter("size > 0 AND (epochs > 0 OR extra > 0)")
    whole = F.col("epochs") + F.when(F.col("extra") == F.col("size"), 1).otherwise(0)
    rest = F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(0)
    copies = out.select("row", rest.alias("rest"), whole.alias("whole"), F.explode(F.sequence(F.lit(1), (whole + F.signum(rest)).cast("int"))).alias("n"))
    cut = F.array_join(F.slice(words(F.col("row.text")), 1, F.greatest(F.col("rest"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("n") <= F.col("whole"), F.col("row.text")).otherwise(cut)
    changed = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return copies.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    md5(coalesce(text, '')) AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER ()::BIGINT AS total,
    ([{", ".join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, row_number() OVER o AS place, (total - coalesce(sum({MOST_EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY {MOST_EPOCHS} * source_size / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, CASE WHEN level * weight >= {MOST_EPOCHS} * source_size THEN {MOST_EPOCHS} * source_size
    ELSE weight * (SELECT arg_min(level, place) FROM l AS k
                   WHERE k.level * k.weight < {MOST_EPOCHS} * k.source_size) END::DOUBLE AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix' || coalesce(d.doc_id::VARCHAR, d.digest)), d.doc_id NULLS FIRST, d.size, d.digest
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
  + greatest(0, least(budget % source_size - before, size)) END::BIGINT AS taken
FROM p"""
