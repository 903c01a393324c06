"""Graph operators: connected components, reference chains, supersession leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netledger.session import checkpointed


def _toward_minimum(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Re-hang the neighbours of every vertex on the smallest of them.

    ``edges`` holds (u, v) with v < u. Large star looks at both directions and moves the neighbours
    above u; small star looks at the neighbours below u. Minima come from a map-side combined
    aggregate, so a hub costs one row per task; the join back is a plain equi-join that adaptive
    execution may split where a hub is large.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if only_larger else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if only_larger:
        pairs = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return pairs.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, component) for every vertex that an edge touches; component is the smallest member.

    Alternates large-star and small-star rounds until the edges no longer change, so the number of
    rounds grows with the logarithm of the longest path. Each round ends in a checkpoint. Self loops
    and null ends are ignored; repeated and reversed edges count once; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    current = checkpointed(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        row = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or row[0] == 0:
            break
        mark = tuple(row)
        current = checkpointed(_toward_minimum(_toward_minimum(current, True), False))
    members = current.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return members.union(current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def component_digests(members: DataFrame) -> DataFrame:
    """(component, size, component_id) where components are small: SHA-256 of the sorted members as text."""
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("vertex")), lambda v: v.cast("string")), ","), 256).alias("component_id"))


def chain_problems(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    """(id, problem) of single-parent chains (id, parent): ``missing`` parents, ``self`` references, and
    ``cycle`` members.

    A walk doubles its stride each round by joining the pointers to themselves, until it is longer
    than all pointers; walks that have not ended by then stand on a cycle, and where they stand leads
    around to its other members.
    """
    refs = nodes.filter(F.col(parent).isNotNull()).select("id", F.col(parent).alias("to"))
    known = nodes.select(F.col("id").alias("to")).distinct()
    missing = refs.join(known, "to", "left_anti").select("id", F.lit("missing").alias("problem"))
    selves = refs.filter("id = to").select("id", F.lit("self").alias("problem"))
    pointer = checkpointed(refs.filter("id <> to").join(known, "to", "left_semi").select("id", "to"))
    walk, stride, total = pointer, 1, pointer.count()
    while stride <= total and not walk.isEmpty():
        walk = checkpointed(walk.alias("a").join(walk.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", F.col("b.to").alias("to")))
        stride *= 2
    on_cycle = walk.select(F.col("to").alias("id")).distinct()  # where endless walks stand is on a cycle
    ring = _closed(on_cycle, pointer)
    return missing.union(selves).union(ring.select("id", F.lit("cycle").alias("problem")))


def _closed(seed: DataFrame, pointer: DataFrame) -> DataFrame:
    """``seed`` with all vertices that pointers from it lead to."""
    found = seed
    while True:
        found = checkpointed(found)
        more = checkpointed(found.join(pointer, "id").select(F.col("to").alias("id")).distinct().join(found, "id", "left_anti"))
        if more.isEmpty():
            return found
        found = found.union(more)


def leaves(nodes: DataFrame, group: str, supersedes: str) -> DataFrame:
    """(group, id, n_leaves, ok): rows that none supersedes; a group with several is not ok."""
    gone = nodes.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("id"))
    left = nodes.join(gone, "id", "left_anti").select(group, "id")
    sizes = left.groupBy(group).agg(F.count(F.lit(1)).alias("n_leaves"))
    return left.join(sizes, group).withColumn("ok", F.col("n_leaves") == 1)


def predecessors_successors(events: DataFrame, entity: str, before: str, after: str) -> DataFrame:
    """(entity, predecessors, successors): identifiers only before, and only after, without the entity."""
    sets = events.groupBy(entity).agg(F.collect_set(before).alias("b"), F.collect_set(after).alias("a"))
    own = F.array(F.col(entity))
    return sets.select(
        entity, F.array_sort(F.array_except(F.array_except("b", "a"), own)).alias("predecessors"), F.array_sort(F.array_except(F.array_except("a", "b"), own)).alias("successors")
    )


def chain_ends(pointers: DataFrame) -> DataFrame:
    """(id, end) for every pointer (id, to), one per id: where the chain that begins at it stops; null if it runs
    into a circle.

    A walk doubles its stride each round. As long as a chain goes on, some walk of its nodes ends in every
    round; when a round ends none, all that is left stands on circles or leads into them.
    """
    walk = checkpointed(pointers.select("id", "to", F.lit(True).alias("open")))
    left, before = walk.count(), -1
    while left and left != before:
        ahead = walk.select(F.col("id").alias("at"), F.col("to").alias("next"))
        walk = checkpointed(walk.join(ahead, F.col("to") == F.col("at"), "left").select("id", F.coalesce("next", "to").alias("to"), F.col("at").isNotNull().alias("open")))
        left, before = walk.filter("open").count(), left
    return walk.select("id", F.when(~F.col("open"), F.col("to")).alias("end"))
