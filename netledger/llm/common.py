"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netledger.session import checkpointed

#: Java regular expression of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table that lies in fewer splits than there are cores, dealt over all of them; for work in
    Python that is dear per row. Larger tables stay as they are. ``scan`` must be a plain read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a side that may be broadcast, at a few dozen bytes each. Above, the join shuffles.
BROADCAST_ROWS = 500_000


def bounded(side: DataFrame, weight: Column | None = None) -> DataFrame:
    """``side`` with a broadcast hint if it is small by count; else the join shuffles both sides.

    ``side`` should be materialised, as it is counted here. ``weight`` is the size of a row in plain rows,
    for rows of any length.
    """
    rows = side.count() if weight is None else side.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


#: Words of 64 bits in a sieve: 2 MB, whatever it is made of.
SIEVE = 1 << 18


def _place(hashed: Column) -> tuple[Column, Column]:
    """Word and bit of a hash in a sieve."""
    return hashed.bitwiseAND(F.lit(SIEVE - 1)).cast("int"), F.shiftrightunsigned(hashed, 40).bitwiseAND(F.lit(63)).cast("int")


def sieve(keys: DataFrame, *columns: Column) -> DataFrame:
    """A bitmap of fixed size, as one row with an array of words, in which the bits of all keys are set.

    With ``may_hold`` it parts the rows of a large table without a shuffle: most rows whose key isn't there are
    known by it, and only the others need meet the keys themselves. It is the same plan at every size; with very
    many keys it tells less, and more rows go on to the exact join.
    """
    word, bit = _place(F.xxhash64(*columns))
    found = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = keys.sparkSession.range(SIEVE).select(F.col("id").cast("int").alias("word")).join(found, "word", "left")
    listed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return checkpointed(every.agg(F.transform(listed, lambda w: w["bits"]).alias("bits")))


def may_hold(rows: DataFrame, bits: DataFrame, *columns: Column, there: bool = True) -> DataFrame:
    """The rows whose key may be one of the sieve's, or those whose key surely isn't."""
    word, bit = _place(F.xxhash64(*columns))
    return rows.join(F.broadcast(bits), F.bit_get(F.get("bits", word), bit) == 1, "left_semi" if there else "left_anti")  # one row of 2 MB


def spare(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is not taken."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def named(name: str, side: str = "") -> Column:
    """The column of any name, with dots or not, of a side of a join."""
    return F.col(f"{side}." * bool(side) + "`" + name.replace("`", "``") + "`")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingle_set(text: Column, k: int) -> Column:
    """Distinct 32-bit hashes of the k-word shingles of a text with A-Z in lower case."""

    def sets(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.hash(F.slice(w, i, k))))

    return let(words(F.translate(text, _UPPER, _UPPER.lower())), sets)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)
