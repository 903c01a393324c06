"""Embedding near-dedup through a pivot-permutation index.

Every vector is described by its NEAREST reference points (pivots) in order of distance. The inverted
lists are kept per conjunction of SHARED pivots, so vectors that share that many meet in a list, and
their shared-pivot count is tallied from the descriptions before the cosine is verified.

Families of copies would make lists of which every pair is a link. They are found first: vectors with
the same three nearest pivots that lie within half the linking angle of one of them form a ball, in
which all are linked to all, without a pair being looked at. The lists then hold balls. Two balls are
linked as a whole, or not at all, where their radii and the angle of their centres settle it; only
where they don't, members are compared one by one. Equal vectors count as one with a weight.

Vectors are compared only under equal labels that are not null, and only if they have the same
length. Null and zero vectors and those with null or non-finite components link with nothing: they
return with no links, as their own component. A null id takes part; ids of components are the least
ids that are not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from netledger.llm.common import table
from netledger.operators.graph import connected_components
from netledger.session import checkpointed

THRESHOLD = 0.93
#: The number of pivots follows the number of different vectors, PER_ROOT times its square root, between
#: these bounds, so that lists don't grow with the table up to a million vectors. Pivots come from at most
#: SAMPLE times as many different vectors, those of the smallest hash; every vector is indexed.
LEAST_PIVOTS, MOST_PIVOTS, PER_ROOT, SAMPLE = 1024, 4096, 4, 4
NEAREST, SHARED = 7, 3

#: Vectors of one cell from which on their centre is sent to them.
LARGE_CELL = 256

_MARGIN = 1e-6  # of angles, against rounding


def choose_pivots(vectors: DataFrame, pivots: int | None = None) -> np.ndarray:
    """Unit vectors that lie apart from each other, from a bounded sample of different (v: array<double>)."""
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PER_ROOT * vectors.count() ** 0.5)))
    rows = vectors.select(F.xxhash64("v").alias("h"), "v").orderBy("h").limit(SAMPLE * pivots).collect()
    width = max((len(r["v"]) for r in rows), default=1)
    rows = [r["v"] for r in rows if len(r["v"]) == width]
    found = np.array(rows, dtype=float).reshape(len(rows), width)
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    room, n = np.empty((pivots, width)), 0
    for v in found:
        if n < pivots and (not n or (room[:n] @ v).max() < 0.9):
            room[n] = v
            n += 1
    chosen = room[:n]
    if len(chosen) < NEAREST:
        extra = np.random.default_rng(7).normal(size=(NEAREST, width))
        chosen = np.vstack([chosen, extra / np.linalg.norm(extra, axis=1, keepdims=True)])
    return chosen


def described(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with ``near``: numbers of the NEAREST pivots, nearest first."""
    names = vectors.columns
    at = names.index("v")
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(at).to_pylist()
            x = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                x[i, : min(width, len(r))] = r[:width]
            order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, NEAREST), pa.int32()), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], names=[*names, "near"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))]))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b))))


def _triples(near: Column) -> Column:
    sorted_near = F.sort_array(near)
    keys = []
    for three in combinations(range(NEAREST), SHARED):
        key = F.lit(0).cast("long")
        for i in three:
            key = key * (MOST_PIVOTS + NEAREST) + F.get(sorted_near, F.lit(i))
        keys.append(key)
    return F.array(*keys)


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    limit = float(np.arccos(threshold))
    e = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "label", e.alias("e")).withColumn(
        "ok", F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("e", lambda x: x != 0), F.lit(False))
    )
    # scaled before squaring, so that norms neither vanish nor overflow
    most = F.array_max(F.transform("e", lambda x: F.abs(x)))
    sized = F.transform("e", lambda x: x / most)
    rows = rows.withColumn("s", F.when(F.col("ok"), sized))
    rows = rows.withColumn("norm", F.sqrt(_dot(F.col("s"), F.col("s"))))
    rows = rows.select("vec_id", "label", F.xxhash64("label", "e").alias("h"), "ok", F.transform("s", lambda x: x / F.col("norm")).alias("v"))
    rows = checkpointed(rows)
    good = rows.filter("ok")

    # equal vectors: one node with a weight
    node = good.groupBy("label", "v", "h").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"))
    node = checkpointed(node.select(F.struct("id", "h").alias("node"), "id", "w", F.struct("label", F.size("v").alias("n")).alias("part"), "v"))
    node = checkpointed(described(node, choose_pivots(node.select("v").distinct())))

    # balls
    cell = [F.col("part"), *[F.get("near", F.lit(i)) for i in range(3)]]
    celled = node.withColumn("cell", F.xxhash64(*cell))
    centre = checkpointed(celled.groupBy("part", "cell").agg(F.min_by(F.struct("node", "v"), "node").alias("c"), F.count(F.lit(1)).alias("n")))
    # cells with a thousandth of all vectors or more are a thousand at most; their members stay where they are
    large = max(LARGE_CELL, node.count() // 1000)
    hot, usual = centre.filter(F.col("n") >= large).drop("n"), centre.filter(F.col("n") < large).drop("n")
    near_hot = celled.join(F.broadcast(hot), ["part", "cell"])
    near_usual = celled.join(F.broadcast(hot.select("part", "cell")), ["part", "cell"], "left_anti").join(usual, ["part", "cell"])
    placed = near_hot.unionByName(near_usual).withColumn("far", _angle(F.col("v"), F.col("c.v")))
    inside = F.col("far") <= limit / 2 - _MARGIN
    placed = checkpointed(
        placed.select(
            "node", "id", "w", "part", "v", "near",
            F.when(inside, F.col("c.node")).otherwise(F.col("node")).alias("ball"), F.when(inside, F.col("far")).otherwise(F.lit(0.0)).alias("far"),
        )
    )
    balls = checkpointed(
        placed.groupBy("ball").agg(
            F.sum("w").alias("size"), F.max("far").alias("radius"), F.min("id").alias("least"),
            F.max(F.when(F.col("node") == F.col("ball"), F.col("v"))).alias("v"), F.first("part").alias("part"),
        )
    )

    # inverted lists of balls; a pair of balls counts the lists they share
    postings = placed.select("part", "ball", F.explode(_triples(F.col("near"))).alias("key")).distinct()
    pairs = (
        postings.alias("a").join(postings.alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.ball") < F.col("b.ball")))
        .groupBy(F.col("a.ball").alias("a"), F.col("b.ball").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    )
    side = lambda n: balls.select(F.col("ball").alias(n), F.col("size").alias(f"{n}_size"), F.col("radius").alias(f"{n}_radius"), F.col("v").alias(f"{n}_v"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("angle", _angle(F.col("a_v"), F.col("b_v")))
    reach = F.col("a_radius") + F.col("b_radius")
    met = met.withColumn("all", F.col("angle") + reach <= limit - _MARGIN).filter(F.col("all") | (F.col("angle") - reach <= limit + _MARGIN))
    met = checkpointed(met.select("a", "b", "a_size", "b_size", "all"))
    whole = met.filter("all")
    member = lambda n: placed.select(F.col("ball").alias(n), F.col("node").alias(f"{n}_node"), F.col("w").alias(f"{n}_w"), F.col("v").alias(f"{n}_v"))
    single = met.filter(~F.col("all")).select("a", "b").join(member("a"), "a").join(member("b"), "b")
    single = checkpointed(single.filter(_dot(F.col("a_v"), F.col("b_v")) >= threshold).select("a", "b", "a_node", "b_node", "a_w", "b_w"))

    # links of a vector: its ball without itself, balls linked as a whole, and single vectors
    by_ball = whole.select(F.col("a").alias("ball"), F.col("b_size").alias("n")).union(whole.select("b", "a_size")).groupBy("ball").agg(F.sum("n").alias("more"))
    by_node = single.select(F.col("a_node").alias("node"), F.col("b_w").alias("n")).union(single.select("b_node", "a_w")).groupBy("node").agg(F.sum("n").alias("some"))
    joined = connected_components(whole.select("a", "b").union(single.select("a", "b")), "a", "b")
    group = balls.join(joined, F.col("ball") == F.col("vertex"), "left").withColumn("component", F.coalesce("component", "ball"))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    group = checkpointed(group.join(least, "component").join(by_ball, "ball", "left").select("ball", "size", "component_id", F.coalesce("more", F.lit(0)).alias("more")))
    counted = placed.select("node", "ball").join(group, "ball").join(by_node, "node", "left").select(
        F.col("node.h").alias("h"), F.col("node.id").alias("id"), (F.col("size") - 1 + F.col("more") + F.coalesce("some", F.lit(0))).alias("n_links"), "component_id"
    )
    # back to rows: a row's node is that of its label and vector
    nodes = good.groupBy("label", "v", "h").agg(F.min("vec_id").alias("id"))
    keyed = checkpointed(
        nodes.alias("n").join(counted.alias("c"), (F.col("n.h") == F.col("c.h")) & F.col("n.id").eqNullSafe(F.col("c.id"))).select("n.label", "n.v", "n.h", "c.n_links", "c.component_id")
    )
    out = rows.alias("r").join(
        keyed.alias("k"), F.col("ok") & (F.col("r.h") == F.col("k.h")) & (F.col("r.label") == F.col("k.label")) & (F.col("r.v") == F.col("k.v")), "left"
    )
    component = F.when(F.col("ok"), F.col("k.component_id")).otherwise(F.col("r.vec_id"))
    return out.select(
        F.col("r.vec_id").alias("vec_id"), F.coalesce("k.n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(F.col("r.vec_id") == component, F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of one label: what the index must find.
SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), m AS (
  SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS top,
    len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND label IS NOT NULL AND len(v) > 0 AS ok FROM e
), u AS (
  SELECT r, vec_id, label, len(v) AS n, list_transform(v, lambda x: x / top) AS s FROM m WHERE ok AND top > 0
), n AS (SELECT r, vec_id, label, n, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS w FROM u),
l AS (
  SELECT a.r AS a, b.r AS b FROM n AS a JOIN n AS b ON a.label = b.label AND a.n = b.n AND a.r <> b.r AND list_dot_product(a.w, b.w) >= 0.93
), walk(a, b) AS (SELECT a, a FROM l UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a),
c AS (SELECT walk.a AS r, min(e.vec_id) AS component_id FROM walk JOIN e ON e.r = walk.b GROUP BY 1),
k AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept
FROM e LEFT JOIN c USING (r) LEFT JOIN k USING (r)"""
