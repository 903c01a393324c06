"""Exact top-k search by inner product through an M-tree that lies in tables.

Vectors become whole numbers, floor(256 * x). A vector x of norm up to B is lifted to (x, sqrt(B^2 - |x|^2)), a
query q to (q, 0): the squared distance is then |q|^2 + B^2 - 2 q.x, so the greatest inner products are the
nearest neighbours in a metric space. Scores themselves are never taken from distances; they are integers.

The tree has four levels. Two levels of routing objects, FAN by FAN at most, come from a bounded sample and
are broadcast; every vector goes to the nearest, and keeps its distance from it. The vectors of a routing
object (node), in order of that distance, are cut into pages of PAGE entries, stored as rows: a page has a
routing object of its own, a covering radius, the distance to its parent, and its entries' distances to
it. Groups of pages and blocks of queries have a bounded size, however many rows fall on one node.

A search first looks at the group nearest to each query, which bounds its k-th distance. Then, per block, the
nodes that some query can't exclude give the groups still to be met. Within a group pages are visited best
first by their lower bounds |d(q, parent) - d(page, parent)| - radius, which need no distance to the page; then
by d(q, page) - radius; and of the entries only those with |d(q, page) - d(entry, page)| within the k-th distance
are scored. Bounds carry a slack for rounding, so nothing is lost; equal scores go to the smaller id.

Vectors that are null, or hold null or non-finite components (or such whose 256-fold isn't finite), take no
part; shorter ones count as filled up with zeros. Every row but the query's own is a candidate, also one
of the same id or vector. Null ids come after all others among equal scores. Fewer candidates than k are all
returned; no vectors or no queries give no rows. Scores beyond a long's range become its end and tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netledger.llm.common import table
from netledger.llm.vectors import DOUBLE, SCALE, as_long, extent, matrix, sound, whole
from netledger.session import stored

K, EVERY = 5, 50
#: Entries of a page, of a group of pages, and queries of a block.
PAGE, GROUP, BLOCK = 128, 8192, 1024
#: Routing objects of a level at most, and vectors, and components of them, in the sample they come from.
FAN, SAMPLE, SAMPLE_CELLS = 64, 8192, 1 << 21
#: Vectors of a node that are aimed at while FAN allows it.
NODE = 4 * PAGE

NONE = -(2**63)  # a score that isn't there

PAGES = "group long, node int, radius double, to_node double, lo double, hi double, centre int, rid array<long>, vec_id array<long>, far array<double>, v binary"
FOUND = "rid long, query_id long, vec_id long, score long"


class Tree(NamedTuple):
    """The upper levels: routing objects (whole numbers), lifted coordinates, and where each one's children start."""

    width: int
    bound: float  # squared norm that no vector exceeds
    exact: bool  # whether scores are exact as doubles
    top: np.ndarray
    nodes: np.ndarray
    starts: np.ndarray  # children of top i are nodes starts[i] to starts[i + 1]


def lift(x: np.ndarray, bound: float) -> np.ndarray:
    return np.sqrt(np.maximum(bound - (x * x).sum(axis=1), 0))


def apart(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Distances of lifted vectors, all of x to all of y."""
    return np.sqrt(np.maximum(2 * bound - 2 * (x @ y.T + np.outer(lift(x, bound), lift(y, bound))), 0))


def away(q: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Distances of queries q to lifted vectors y."""
    return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + bound - 2 * (q @ y.T), 0))


def slack(q: np.ndarray, tree: Tree) -> np.ndarray:
    """What rounding may change in a bound of each query."""
    return 8 * np.sqrt((tree.width + 8) * np.finfo(float).eps * ((q * q).sum(axis=1) + tree.bound))


def plant(sample: np.ndarray, n: int, bound: float, exact: bool) -> Tree:
    """Upper levels for n vectors from a sample of them."""
    fan = int(np.clip(np.ceil(np.sqrt(n / NODE)), 1, FAN))
    top = sample[:fan]
    nearest = apart(sample, top, bound).argmin(axis=1)
    children = [sample[nearest == i][:fan] for i in range(len(top))]
    starts = np.cumsum([0, *map(len, children)])
    return Tree(sample.shape[1], bound, exact, top, np.concatenate(children), starts)


def route(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The node of each vector and the distance to it: the nearest at the top, then the nearest of its children."""
    first = apart(x, tree.top, tree.bound).argmin(axis=1)
    node, far = np.zeros(len(x), np.int32), np.zeros(len(x))
    for i in np.unique(first):
        mine = np.flatnonzero(first == i)
        at, end = tree.starts[i], tree.starts[i + 1]
        if end > at:  # equal vectors are on one side only, so a later twin has no children
            d = apart(x[mine], tree.nodes[at:end], tree.bound)
            nearest = d.argmin(axis=1)
            node[mine], far[mine] = at + nearest, d[np.arange(len(mine)), nearest]
    return node, far


def routed(rows: DataFrame, tree: Tree) -> DataFrame:
    """(rid, vec_id, embedding, node, far) of (rid, vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, far = route(matrix(batch.column(2), tree.width), tree)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(far)], names=["rid", "vec_id", "embedding", "node", "far"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("rid", "vec_id", "embedding").mapInArrow(run, f"rid long, vec_id long, embedding {kind}, node int, far double")


def in_order(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Rows of ``routed`` in partitions of about ``size`` rows that follow each other by node and distance."""
    parts = max(1, -(-n // size))
    return rows.repartitionByRange(parts, "node", "far", "rid").sortWithinPartitions("node", "far", "rid").coalesce(parts)


def paged(ordered: DataFrame, tree: Tree) -> DataFrame:
    """Pages of rows that come by node and distance."""
    names = [f.split()[0] for f in PAGES.split(", ")]

    def page(group: int, rows: pa.RecordBatch) -> list:
        x = matrix(rows.column(2), tree.width)
        far = rows.column(4).to_numpy()
        lifted = np.hstack([x, lift(x, tree.bound)[:, None]])
        centre = int(((lifted - lifted.mean(axis=0)) ** 2).sum(axis=1).argmin())
        d = apart(x, x[centre : centre + 1], tree.bound)[:, 0]
        return [group, rows.column(3)[0].as_py(), d.max(), far[centre], far.min(), far.max(), centre, rows.column(0).to_pylist(), rows.column(1).to_pylist(), d, x.tobytes()]

    def batch_of(pages: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pages), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, filled, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            node = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
            pages = []
            for start, end in zip(cuts, cuts[1:]):
                last = end == len(node)
                for at in range(start, end, PAGE):
                    if last and at + PAGE > end:
                        continue
                    if filled >= GROUP:
                        group, filled = group + 1, 0
                    pages.append(page(group, batch.slice(at, min(PAGE, end - at))))
                    filled += min(PAGE, end - at)
            left = (cuts[-1] - cuts[-2]) % PAGE if len(node) else 0
            held = batch.slice(len(node) - left) if left else None
            if pages:
                yield batch_of(pages)
        if held is not None:
            yield batch_of([page(group, held)])

    return ordered.mapInArrow(run, PAGES)


class Best:
    """The best scores of each query of a block so far, greatest first, ties to smaller ids, null ids last."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), NONE, np.int64)
        self.name = np.zeros((queries, k), np.int64)
        self.void = np.ones((queries, k), bool)

    def take(self, rows: np.ndarray, scores: np.ndarray, name: np.ndarray, void: np.ndarray) -> None:
        """Merge scores (rows, entries)."""
        k = self.score.shape[1]
        better = (scores >= self.score[rows, -1:]).any(axis=1)
        if not better.any():
            return
        rows, scores = rows[better], scores[better]
        shape = scores.shape
        every = [np.hstack([a, b]) for a, b in ((self.score[rows], scores), (self.name[rows], np.broadcast_to(name, shape)), (self.void[rows], np.broadcast_to(void, shape)))]
        order = np.lexsort((every[1], every[2], ~every[0]), axis=1)[:, :k]
        self.score[rows], self.name[rows], self.void[rows] = (np.take_along_axis(e, order, axis=1) for e in every)


def scores_of(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ x.T).astype(np.int64)
    return np.maximum(as_long(whole(q, False).dot(whole(x, False).T)), NONE + 1)


def visit(tree: Tree, q: np.ndarray, own: np.ndarray, kth: np.ndarray, pages: list[dict], k: int) -> tuple[Best, int]:
    """The best k of some pages for each query, and how many scores were computed.

    ``kth`` is a score that k candidates of each query reach elsewhere, NONE where none is known; what
    is below it may be left out.
    """
    best, computed = Best(len(q), k), 0
    if not len(q) or not pages:
        return best, computed
    squares, extra = (q * q).sum(axis=1), slack(q, tree)

    def reach(rows: np.ndarray) -> np.ndarray:
        """Distances beyond which nothing is wanted."""
        s = np.maximum(best.score[rows, -1], kth[rows])
        d = np.sqrt(np.maximum(squares[rows] + tree.bound - 2 * s.astype(float), 0)) + extra[rows]
        return np.where(s == NONE, np.inf, d)

    parents, which = np.unique([p["node"] for p in pages], return_inverse=True)
    to_parent = away(q, tree.nodes[parents], tree.bound)
    bounds = np.abs(to_parent[:, which] - np.array([p["to_node"] for p in pages])) - np.array([p["radius"] for p in pages])
    everyone = np.arange(len(q))
    for i in np.argsort(bounds.min(axis=0), kind="stable"):
        page = pages[i]
        rows = everyone[~(bounds[:, i] > reach(everyone))]
        if not len(rows):
            continue
        x = page["v"]
        d = away(q[rows], x[page["centre"]][None], tree.bound)[:, 0]
        limit = reach(rows)
        near = ~(d - page["radius"] > limit)
        rows, d, limit = rows[near], d[near], limit[near]
        entries = np.flatnonzero(~(np.abs(d[:, None] - page["far"]) > limit[:, None]).all(axis=0))
        if not len(rows) or not len(entries):
            continue
        scores = scores_of(q[rows], x[entries], tree.exact)
        computed += scores.size
        scores[own[rows][:, None] == page["rid"][entries]] = NONE
        best.take(rows, scores, page["name"][entries], page["void"][entries])
    return best, computed


def searched(queries: DataFrame, pages: DataFrame, pairs: DataFrame, tree: Tree, k: int, home: bool) -> DataFrame:
    """FOUND rows of the (block, group) pairs: of the queries whose home is the group, or of all others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = right.column("group")[0].as_py() if right.num_rows else None
        is_home = left.column("home").to_numpy() == group if left.num_rows else np.zeros(0, bool)
        left = left.filter(pa.array(is_home == home))
        q = matrix(left.column("embedding").combine_chunks(), tree.width) if left.num_rows else np.zeros((0, tree.width))
        own = left.column("rid").to_numpy().astype(np.int64)
        kth = left.column("kth").fill_null(NONE).to_numpy().astype(np.int64)
        met = []
        for row in right.select([f.split()[0] for f in PAGES.split(", ")]).to_pylist() if left.num_rows else []:
            row["v"] = np.frombuffer(row["v"]).reshape(-1, tree.width)
            row["rid"], row["far"] = np.array(row["rid"], np.int64), np.array(row["far"])
            row["void"] = np.array([i is None for i in row["vec_id"]])
            row["name"] = np.array([i or 0 for i in row["vec_id"]], np.int64)
            met.append(row)
        with np.errstate(over="ignore", invalid="ignore"):
            best, _ = visit(tree, q, own, kth, met, k)
        there = (best.score > NONE) & (best.score >= kth[:, None])
        which = np.nonzero(there)[0]
        names = pa.array(best.name[there], mask=best.void[there])
        return pa.table({"rid": own[which], "query_id": left.column("vec_id").take(pa.array(which)), "vec_id": names, "score": best.score[there]})

    pairs = pairs.select(F.col("block").alias("to_block"), F.col("group").alias("to_group"))
    asked = queries.join(pairs, F.col("block") == F.col("to_block"))
    met = pages.join(pairs, F.col("group") == F.col("to_group"))
    met = met.select(F.col("to_block").alias("by_block"), F.col("to_group").alias("by_group"), *pages.columns)
    return asked.groupBy("to_block", "to_group").cogroup(met.groupBy("by_block", "by_group")).applyInArrow(run, FOUND)


def blocked(ordered: DataFrame, homes: np.ndarray, tree: Tree) -> DataFrame:
    """Queries in order as (block, home, rid, vec_id, embedding): home is the group nearest to a query."""
    kind = ordered.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            d = away(matrix(batch.column(2), tree.width), tree.nodes, tree.bound)
            d[:, homes < 0] = np.inf  # nodes without entries
            block = (TaskContext.get().partitionId() << 32) + (seen + np.arange(batch.num_rows)) // BLOCK
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(homes[d.argmin(axis=1)]), *batch.columns[:3]], names=["block", "home", "rid", "vec_id", "embedding"])

    return ordered.mapInArrow(run, f"block long, home long, rid long, vec_id long, embedding {kind}")


def wanted(queries: DataFrame, rings: np.ndarray, tree: Tree) -> DataFrame:
    """(block, node) of the nodes that some query of the block can't exclude, by the nearest and farthest entries."""
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(names.index("block")).to_numpy()
            pairs = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = matrix(part.column(names.index("embedding")), tree.width)
                kth = part.column(names.index("kth")).fill_null(NONE).to_numpy().astype(float)
                limit = np.sqrt(np.maximum((q * q).sum(axis=1) + tree.bound - 2 * kth, 0)) + slack(q, tree)
                d = away(q, tree.nodes, tree.bound)
                row, node = np.nonzero(~(np.maximum(d - rings[1], rings[0] - d) > limit[:, None]))
                pairs.append(np.unique(np.stack([block[at + row], node]), axis=1))
            found = np.unique(np.hstack(pairs), axis=1) if pairs else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int32))], names=["block", "node"])

    return queries.mapInArrow(run, "block long, node int").distinct()


def top_k(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``vectors`` (vec_id, embedding) for which ``asked``, a
    condition on vec_id, holds: the k rows of the greatest inner product, itself left out."""
    spark = vectors.sparkSession
    rows = vectors.filter(sound(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()))
    width, most, n = extent(rows, "embedding")
    width = max(width, 1)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE) if most < 2**62 else x.cast("double") * SCALE, 2))
    bound = (rows.agg(F.max(norm)).first()[0] or 0.0) * (1 + 1e-9) + 1
    sample = rows.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(max(1, min(SAMPLE, SAMPLE_CELLS // width))).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    with np.errstate(over="ignore", invalid="ignore"):
        tree = plant(matrix(pa.array([r[0] for r in sample], pa.list_(pa.float64())), width), n, bound, most * most * width < DOUBLE)

    pages = stored(paged(in_order(routed(rows, tree), n, GROUP), tree))
    # one row per routing object, of which there are FAN * FAN at most
    summary = pages.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("group", "lo").alias("home")).collect()
    rings, homes = np.full((2, len(tree.nodes)), np.nan), np.full(len(tree.nodes), -1, np.int64)
    rings[0], rings[1] = np.inf, -np.inf
    for r in summary:
        rings[0, r["node"]], rings[1, r["node"]], homes[r["node"]] = r["lo"], r["hi"], r["home"]

    asking = rows.filter(asked)
    queries = stored(blocked(in_order(routed(asking, tree), asking.count(), BLOCK), homes, tree))
    at_home = queries.select("block", F.col("home").alias("group")).distinct()
    first = stored(searched(queries.withColumn("kth", F.lit(None).cast("long")), pages, at_home, tree, k, home=True))
    kth = first.groupBy("rid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("rid", "kth")
    bounded = stored(queries.join(kth, "rid", "left"))
    groups = pages.select("node", "group").distinct()
    pairs = stored(wanted(bounded, rings, tree).join(groups, "node").select("block", "group").distinct())
    found = first.unionByName(searched(bounded, pages, pairs, tree, k, home=False))
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e AS q JOIN e AS c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {K}"""
