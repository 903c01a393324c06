"""Temporal operators: intervals, replay, as-of joins, versions, deduplication, carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Events that change what a facility is, and those that close it for a time or open it
#: again. All others only announce.
STRUCTURAL = (
    "contract_concluded", "contract_terminated", "abolished", "relocation", "address_change", "renamed", "service_change", "office_type_change", "established",
    "disadvantaged_area_change", "disadvantaged_area_correction",
)
CLOSED, REOPENED = "temporarily_closed", "reopened"


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``kept`` (the first row of each key) and ``duplicate_of``, the first row's first order
    column, for the others. The first row comes from an aggregate, so a frequent key is not sorted."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = df.alias("d").join(first.alias("f"), on)
    mine = F.struct(*[F.col(f"d.{o}") for o in order]) == F.col("_first")
    return joined.select("d.*", mine.alias("kept"), F.when(~mine, F.col("_first")[order[0]]).alias("duplicate_of"))


def intervals(events: DataFrame, entity: str, at: str, tie: str, state: Column) -> DataFrame:
    """(entity, tie, valid_from, valid_to, state): each event opens an interval that the next one ends."""
    w = Window.partitionBy(entity).orderBy(at, tie)
    return events.select(entity, tie, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), state.alias("state"))


def as_of(left: DataFrame, right: DataFrame, entity: str, at: str, valid_from: str, columns: list[str], tie: str) -> DataFrame:
    """Rows of ``left`` with the ``columns`` of the version of ``right`` that was valid at ``at``: the last
    that starts at or before it, else the first of the entity; null without any version.

    Both sides are unioned and ordered once per entity, which costs one shuffle and no range product.
    """
    entity_type = F.col(entity)
    versions = right.select(entity_type, F.col(valid_from).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"), F.struct(*columns).alias("_v"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    asked = left.select(entity_type, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit("").alias("_tie"), F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(entity).orderBy("_at", "_side", "_tie")
    past = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = versions.unionByName(asked).withColumn("_found", F.coalesce(past, later))
    return out.filter("_side = 1").select("_row.*", "_found.*")


def replay(events: DataFrame, anchors: DataFrame, cutoffs: DataFrame, structural: tuple[str, ...] = STRUCTURAL, closed: str = CLOSED, reopened: str = REOPENED) -> DataFrame:
    """State of every entity at every cutoff: (entity, cutoff, state, available).

    ``events`` (entity, at, event_id, kind, before, after), ``anchors`` (entity, anchor_at, state,
    available), ``cutoffs`` (cutoff): few and bounded, so they are broadcast. Going forward from the
    anchor the last structural event's ``after`` is the state and the last closure decides
    availability; going backward it is the first event's ``before``, undone. So two conditional
    aggregates replace the event loop.
    """
    spots = anchors.join(F.broadcast(cutoffs))
    e = events.select("entity", "at", "event_id", "kind", "before", "after")
    met = spots.join(e, "entity", "left")
    ahead = (F.col("at") > F.col("anchor_at")) & (F.col("at") <= F.col("cutoff"))
    behind = (F.col("at") > F.col("cutoff")) & (F.col("at") <= F.col("anchor_at"))
    place = F.struct("at", "event_id")
    changing, closing = F.col("kind").isin(*structural), F.col("kind").isin(closed, reopened)
    pick = lambda extreme, test, value: extreme(F.when(test, F.struct(place.alias("p"), value.alias("v"))))["v"]
    out = met.groupBy("entity", "cutoff").agg(
        F.first("state").alias("_state"), F.first("available").alias("_available"), F.first(F.col("cutoff") >= F.col("anchor_at")).alias("_forward"),
        pick(F.max, ahead & changing, F.col("after")).alias("_after"), pick(F.min, behind & changing, F.col("before")).alias("_before"),
        pick(F.max, ahead & closing, F.col("kind")).alias("_last"), pick(F.min, behind & closing, F.col("kind")).alias("_first"),
    )
    state = F.coalesce(F.when(F.col("_forward"), F.col("_after")).otherwise(F.col("_before")), "_state")
    undone = F.when(F.col("_forward"), F.col("_last") == reopened).otherwise(F.col("_first") == closed)
    return out.select("entity", "cutoff", state.alias("state"), F.coalesce(undone, "_available").alias("available"))


def effective_date(confirmed: Column, planned: Column, corroborated: Column) -> Column:
    """Confirmed date, else the planned one if the state was corroborated."""
    return F.coalesce(confirmed, F.when(F.coalesce(corroborated, F.lit(False)), planned))


def date_basis(confirmed: Column, planned: Column, corroborated: Column) -> Column:
    return F.when(confirmed.isNotNull(), "observed").when(F.coalesce(corroborated, F.lit(False)) & planned.isNotNull(), "planned").otherwise("unknown")


def basis_label(observed: Column, planned: Column) -> Column:
    return F.when((observed > 0) & (planned > 0), "mixed").when(observed > 0, "observed").when(planned > 0, "planned").otherwise("none_applied")


def version_upsert(df: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Versions of a source: rows whose content differs from the one before, with what they supersede.

    Going back to earlier content is a new version. ``is_current`` marks the last.
    """
    w = Window.partitionBy(key).orderBy(*order)
    seen = df.withColumn("_last", F.lag(F.struct(content)).over(w)).filter(F.col("_last").isNull() | ~F.col(f"_last.{content}").eqNullSafe(F.col(content)))
    return seen.drop("_last").withColumns({"supersedes": F.lag(order[-1]).over(w), "is_current": F.lead(order[-1]).over(w).isNull()})


def carry_forward(df: DataFrame, by: list[str], order: list[str], marker: Column) -> DataFrame:
    """``df`` with ``carried``: the last marker that was not null, up to and with the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("carried", F.last(marker, ignorenulls=True).over(w))


def continuity_breaks(df: DataFrame, by: list[str], order: list[str], after: dict[str, str]) -> DataFrame:
    """Rows whose state doesn't continue in the next row of the group, with the fields that break.

    ``after`` maps a column of this row to the column of the next that should equal it.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    fields = [F.when(~F.col(a).eqNullSafe(F.lead(b).over(w)), F.lit(a)) for a, b in after.items()]
    out = df.withColumn("_next", F.lead(F.lit(1)).over(w)).withColumn("breaks", F.array_compact(F.array(*fields)))
    return out.filter((F.col("_next") == 1) & (F.size("breaks") > 0)).drop("_next")


def first_wins(df: DataFrame, key: str, order: list[str], verdicts: list[tuple[str, Column]], default: str) -> DataFrame:
    """``df`` with ``verdict``: the first of the ordered tests that holds; a key that came before is a
    ``duplicate`` unless an earlier test holds. A null key is ``unresolved``; such rows aren't numbered."""
    w = Window.partitionBy(key).orderBy(*order)
    out = F.when(F.row_number().over(w) > 1, "duplicate")
    for name, test in verdicts:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    numbered = df.filter(F.col(key).isNotNull()).withColumn("verdict", out.otherwise(default))
    return numbered.unionByName(df.filter(F.col(key).isNull()).withColumn("verdict", F.lit("unresolved")))


def observation_index(df: DataFrame, key: str, date: str) -> DataFrame:
    """(key, date, conflict): the one date observed for a key; differing dates poison it for good."""
    out = df.groupBy(key).agg(F.min(date).alias("_least"), F.max(date).alias("_most"))
    conflict = F.col("_least") != F.col("_most")
    return out.select(key, F.when(~conflict, F.col("_least")).alias(date), conflict.alias("conflict"))


def threaded(events: DataFrame, by: list[str], key: str, before: str, after: str) -> DataFrame:
    """``events`` with ``place``: the position of each in the thread of its group, in which one's after
    state is the next one's before state. The thread starts at a before state that no other event
    leaves behind.

    Places are counted by doubling strides along the links, so rounds grow with the logarithm of the
    longest thread. A group in which states branch, close a circle, or leave several starts has null places.
    """
    from netledger.session import checkpointed

    e = events.select(*by, key, F.struct(F.col(before)).alias("_b"), F.struct(F.col(after)).alias("_a"))
    ends, starts = e.select(*by, F.col(key).alias("_from"), F.col("_a").alias("_s")), e.select(*by, F.col(key).alias("_to"), F.col("_b").alias("_s"))
    links = ends.join(starts, [*by, "_s"]).filter(F.col("_from") != F.col("_to"))
    # how far each event stands behind another, doubling; heads of threads have no one before them
    back = checkpointed(links.select(*by, F.col("_to").alias("id"), F.col("_from").alias("to"), F.lit(1).alias("steps")))
    single = back.groupBy(*by).agg((F.count(F.lit(1)) == F.count_distinct("id")).alias("one"), (F.count(F.lit(1)) == F.count_distinct("to")).alias("way"), F.count(F.lit(1)).alias("n_links"))
    sizes = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.join(single, by, "left").filter((F.col("n") == 1) | (F.col("one") & F.col("way") & (F.col("n_links") == F.col("n") - 1))).select(*by)
    walk = back.join(whole, by, "left_semi")
    longest = walk.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    place = walk
    reach = 1
    while reach < longest:
        further = place.alias("p").join(place.alias("q"), [F.col(f"p.{b}").eqNullSafe(F.col(f"q.{b}")) for b in by] + [F.col("p.to") == F.col("q.id")], "left")
        place = checkpointed(further.select(*[F.col(f"p.{b}").alias(b) for b in by], F.col("p.id"), F.coalesce("q.to", "p.to").alias("to"), (F.col("p.steps") + F.coalesce("q.steps", F.lit(0))).alias("steps")))
        reach *= 2
    counted = place.select(*by, F.col("id").alias(key), "steps")
    heads = e.select(*by, key).join(whole, by, "left_semi").join(counted.select(*by, key), [*by, key], "left_anti").select(*by, key, F.lit(0).alias("steps"))
    places = counted.unionByName(heads).withColumnRenamed("steps", "place")
    return events.join(places, [*by, key], "left")


def relocations(events: DataFrame, start: Column, end: Column, ident: Column) -> DataFrame:
    """``events`` with ``outcome``: used for relocations whose date is confirmed and lies in (start, end];
    else why not: unofficial, planned_only, outside, or no_identifier."""
    outcome = (
        F.when(F.coalesce("provenance", F.lit("official")) != "official", "unofficial").when(F.col("confirmed").isNull(), "planned_only")
        .when((F.col("confirmed") <= start) | (F.col("confirmed") > end), "outside").when(ident.isNull(), "no_identifier").otherwise("used")
    )
    return events.withColumn("outcome", outcome)
