"""Vector code compression: product codes from codebooks of whole numbers.

A vector is floor(256 * x) of its components, cut into equal consecutive parts. Every part position has a
codebook. It starts as that part of the vectors of least id; in each round all parts go to their nearest
entry and each entry becomes the floor of the mean of its parts. A code is the numbers of a vector's
entries after the last round.

Rounds run as ``treeAggregate`` over an RDD of columnar NumPy blocks (a row per component): squared
distances to all entries accumulate dimension by dimension, ``np.add.at`` adds the parts to int64 tensors
of sums and counts, and these merge through a tree, so that the driver gets a few tensors of a fixed size
(parts x entries x components) whatever the number of vectors and however they fall on the entries. Blocks
are read anew from the table in each round; a lost task is computed again from there. Codebooks go out
by broadcast; their size is fixed by the parameters and the length of the vectors.

Vectors that are null, or hold null or non-finite components (or such whose 256-fold isn't finite), are
left out. Vectors shorter than the longest count as filled up with zeros, as do all if their length isn't
a multiple of the number of parts. Fewer vectors than entries make shorter codebooks. Null ids come after
all others; rows of one id are ordered by their vectors. Repeated rows come out as often as they come in, and
null labels are a label. No vectors give no rows. Numbers that longs can't hold are computed as Python's
integers, and errors beyond a long's range become its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from netledger.llm.common import table
from netledger.llm.vectors import LONG, as_long, extent, matrix, sound, whole
from netledger.session import stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors a block holds at most.
BLOCK = 4096
#: Labels of a HOT_SHARE-th of all rows or more, HOT_SHARE at most, have their sums sent to the rows.
HOT_SHARE = 1000


def assigned(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the nearest entries, ties to the lower, and squared distances to them: (parts, vectors) each.
    ``columns`` is (components, vectors), ``books`` (parts, entries, components of a part)."""
    parts, entries, step = books.shape
    codes = np.empty((parts, columns.shape[1]), np.int64)
    far = np.empty(codes.shape, columns.dtype)
    every = np.arange(columns.shape[1])
    for p in range(parts):
        distance = np.zeros((columns.shape[1], entries), columns.dtype)
        for d in range(step):
            gap = columns[p * step + d][:, None] - books[p, :, d]
            distance += gap * gap
        codes[p] = distance.argmin(axis=1)
        far[p] = distance[every, codes[p]]
    return codes, far


def gathered(held: tuple | None, columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts that go to each entry, added to those held."""
    parts, entries, step = books.shape
    sums, counts = held or (np.zeros(books.shape, columns.dtype), np.zeros((parts, entries), np.int64))
    codes, _ = assigned(columns, books)
    for p in range(parts):
        np.add.at(counts[p], codes[p], 1)
        for d in range(step):
            np.add.at(sums[p, :, d], codes[p], columns[p * step + d])
    return sums, counts


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floors of their means; unused ones stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def learn(vectors: DataFrame, width: int, longs: bool, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components of a part) from sound vectors (vec_id, embedding) of at most
    ``width`` components, a multiple of ``parts``."""
    first = vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = whole(matrix(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width), longs)
    books = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = np.ascontiguousarray(matrix(batch.column(0).slice(at, BLOCK), width).T)
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    if not len(first):
        return books
    cut = vectors.select("embedding").mapInArrow(blocks, "block binary").rdd.map(lambda r: whole(np.frombuffer(r[0]).reshape(width, -1), longs))
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)
        books = moved(books, *cut.treeAggregate(None, lambda held, block: gathered(held, block, sent.value), merged))
        sent.unpersist()
    return books


def encoded(vectors: DataFrame, books: np.ndarray, longs: bool) -> DataFrame:
    """``vectors`` (vec_id, label, embedding) as (vec_id, label, code, error)."""
    parts, entries, step = books.shape
    digits = 2 if entries <= 256 else (entries - 1).bit_length() + 3 >> 2
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                codes, far = assigned(whole(np.ascontiguousarray(matrix(part.column(2), parts * step).T), longs), sent.value)
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.T.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(as_long(far.sum(axis=0)))], names=["vec_id", "label", "code", "error"])

    rows = vectors.select("vec_id", "label", "embedding")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def with_label_sums(codes: DataFrame) -> DataFrame:
    """``codes`` (a stored table) with label_error, the error summed over the rows of the same label.

    Sums of frequent labels, HOT_SHARE at most, go to the rows where they are; other labels' rows, none of
    which are many, meet their sums by a shuffle.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = stored(codes.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows")))
    n = sums.agg(F.sum("rows")).first()[0] or 0
    hot, usual = sums.filter(F.col("rows") * HOT_SHARE >= n), sums.filter(F.col("rows") * HOT_SHARE < n)
    same = F.col("c.label").eqNullSafe(F.col("s.label"))
    out = [F.col(f"c.{name}") for name in codes.columns] + [F.col("s.label_error").alias("label_error")]
    near = codes.alias("c").join(F.broadcast(hot).alias("s"), same).select(*out)
    rest = codes.alias("c").join(F.broadcast(hot).alias("s"), same, "left_anti").alias("c").join(usual.alias("s"), same).select(*out)
    return near.unionByName(rest)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error, label_error) of all sound vectors of (vec_id, label, embedding),
    and the codebooks."""
    good = vectors.select("vec_id", "label", "embedding").filter(sound(F.col("embedding")))
    width, most, n = extent(good, "embedding")
    width = max(1, -(-width // parts)) * parts
    longs = 4 * most * most * width < LONG and most * n < LONG
    books = learn(good, width, longs, parts, entries, rounds)
    return with_label_sums(stored(encoded(good, books, longs))), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds() -> str:
    """SQL of the codebooks c0, c1, ... and the assignments a0, a1, ... to them."""
    out = []
    for i in range(ROUNDS + 1):
        if i:
            out.append(f"""m{i} AS (
  SELECT part, entry, j, floor(sum(x[j + 1]) / count(*)) AS mean FROM parts JOIN a{i - 1} USING (r, part), range(4) AS t(j) GROUP BY ALL
), n{i} AS (SELECT part, entry, list(mean ORDER BY j)::DOUBLE[] AS moved FROM m{i} GROUP BY ALL),
c{i} AS MATERIALIZED (SELECT part, entry, coalesce(moved, c) AS c FROM c{i - 1} LEFT JOIN n{i} USING (part, entry))""")
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, part, min(far)::BIGINT AS far, arg_min(entry, far * {ENTRIES} + entry) AS entry
  FROM (SELECT r, part, entry, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS far FROM parts JOIN c{i} USING (part)) GROUP BY ALL)""")
    return ",\n".join(out)


#: For vectors of 64 components.
SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (SELECT r, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM k, range({PARTS}) AS t(part)),
c0 AS (SELECT part, r AS entry, x AS c FROM parts WHERE r < {ENTRIES}),
{_rounds()},
e AS (SELECT r, sum(far)::BIGINT AS error, string_agg(printf('%02x', entry), '' ORDER BY part) AS code FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN c], ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM k JOIN e USING (r)"""
