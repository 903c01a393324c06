"""Facilities as chains of states: corroboration, history by component, and replay field by field.

A state is a struct of texts ``section, ident, name, address, status`` and, where states are compared,
``simple, area`` and ``services`` (an array of texts). Events are rows (event_id, kind, before, after, ..) with
two such structs. Identifiers that an event joins belong to one facility, whose name is the least of
them. Orders within a facility come from ranks over ranges of rows, so one with a third of all events is
spread over many tasks; lists of its events are tables here, never arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.text import state_text
from netledger.operators import graph, temporal as tm
from netledger.operators.running import followed
from netledger.session import checkpointed

#: Identifiers that mean that there is no facility, in compared states and in replayed ones.
DELETED, ABSENT = ("-", "", "―", "─", "－", "−"), ("", "-")
#: Fields that must continue from state to state, and those that an anchor is compared by.
CHAIN_FIELDS = ("section", "ident", "name", "address", "simple", "area", "services")
ANCHOR_FIELDS = ("section", "name", "address")
#: What a later observation of a date may be.
OBSERVATION_KINDS = ("current_list_snapshot", "official_notice")
#: A status that means closed for a time.
CLOSED_STATUS = ("一時閉鎖", "temporarily_closed")

PAYLOAD = ("section", "ident", "name", "address", "status")


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def live(ident: Column, dead: tuple[str, ...]) -> Column:
    """The identifier, or null if it names no facility."""
    return F.when(~F.trim(text(ident)).isin(*dead), F.trim(ident))


def compared(state: Column, fields: tuple[str, ...] = CHAIN_FIELDS) -> Column:
    """A state as a struct of texts in which spellings alike are equal; services become one text."""
    services = lambda s: F.array_join(F.transform(F.coalesce(s, F.array().cast("array<string>")), lambda x: F.concat(text(x), F.lit("\x1f"))), "")
    return F.struct(*[state_text(services(state[f]) if f == "services" else text(state[f])).alias(f) for f in fields])


def differing(left: Column, right: Column, fields: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(~left[f].eqNullSafe(right[f]), F.lit(f)) for f in fields]))


def facilities(events: DataFrame, before: Column, after: Column) -> DataFrame:
    """(ident, facility) of all live identifiers (two columns of ``events``) that events name."""
    pairs = events.select(before.alias("a"), after.alias("b"))
    ends = pairs.select("a").union(pairs.select("b")).filter("a IS NOT NULL").distinct()
    joined = graph.connected_components(pairs.filter("a IS NOT NULL AND b IS NOT NULL"), "a", "b")
    return ends.join(joined, F.col("a") == F.col("vertex"), "left").select(F.col("a").alias("ident"), F.coalesce("component", "a").alias("facility"))


class Confirmed(NamedTuple):
    """``events`` (event_id, facility, status, state_corroborated, effective_date_confirmed, confirmed_date, date_basis,
    reasons), ``chains`` (facility, n_events, n_past, n_future, chain_consistent, anchor_match, corroborated, terminal_event,
    terminal_kind) and ``issues`` (code, detail, facility, event_id, next_event_id, fields)."""

    events: DataFrame
    chains: DataFrame
    issues: DataFrame


def confirm_chains(events: DataFrame, anchors: DataFrame, anchor_at: Column, observations: DataFrame | None = None, order: tuple[str, ...] = (), key: str = "event_id") -> Confirmed:
    """Which announced events the register of a day (``anchors``: ident, section, name, address) corroborates.

    ``events`` (event_id, planned, before, after): planned is a text. Of events of one day and equal states
    the first by ``order`` and id counts. Those without a date, with one that isn't a date, or without an
    identifier are issues. The others form chains: per facility by day, and within a day along the
    states, where one's after is the next one's before. A day that doesn't thread makes its chain
    inconsistent, and so does a state that doesn't continue in the next; ``fields`` names those that differ.

    A consistent chain corroborates its events up to the anchor's day if the last of them ends in the
    state that the register gives for its identifier, or, if it ends in a deletion, if the register holds
    none of the identifiers of the facility. Later events stay announced. Observations (event_id,
    observed_at, kind) of a corroborated event confirm its date if all name the planned day. Anchors
    of one identifier must be one; of several the least by section, name and address counts.

    Where several events have one id, ``key`` names a column of events and observations that tells them apart: each is an
    event of its own, all of the first id count among equal states, and an observation belongs to the event of its key.
    """
    e = events.select("event_id", F.col(key).alias("row"), "planned", *order, compared(F.col("before")).alias("b"), compared(F.col("after")).alias("a"), live(F.col("before.ident"), DELETED).alias("from"), live(F.col("after.ident"), DELETED).alias("to"))
    e = checkpointed(tm.keep_first(e, ["planned", "b", "a"], [*order, "event_id"]).withColumn("at", F.col("planned").try_cast("date")))
    blank = F.trim(text(F.col("planned"))) == ""
    unnamed = F.col("from").isNull() & F.col("to").isNull()
    state = (
        F.when(~F.col("kept"), "duplicate_announcement").when(blank, "missing_planned_date").when(F.col("at").isNull(), "invalid_planned_date")
        .when(unnamed, "unresolvable_identifier").otherwise("chained")
    )
    e = e.withColumn("state", state)
    dated = e.filter("state = 'chained'")
    members = checkpointed(facilities(dated, F.col("from"), F.col("to")))
    dated = dated.withColumn("ident", F.coalesce("from", "to")).join(members, "ident").drop("ident")

    # places within a day come from the states; most days hold one event and need none
    days = dated.groupBy("facility", "at").agg(F.count(F.lit(1)).alias("n"))
    crowded = checkpointed(dated.join(days.filter("n > 1"), ["facility", "at"], "left_semi").select("facility", "at", "row", "b", "a"))
    place = tm.threaded(crowded, ["facility", "at"], "row", "b", "a").select("row", "place", F.lit(True).alias("crowded"))
    chain = dated.join(place, "row", "left").withColumn("loose", F.col("crowded").isNotNull() & F.col("place").isNull())
    chain = followed(chain.withColumn("place", F.coalesce("place", F.lit(0))), ["facility"], ["at", "place", *order, "event_id", "row"], ["event_id", "b"])
    chain = checkpointed(chain.withColumn("fields", F.when(F.col("next.event_id").isNotNull(), differing(F.col("a"), F.col("next.b"), CHAIN_FIELDS))))
    past = F.col("at") <= anchor_at
    broken = F.coalesce(F.size("fields") > 0, F.lit(False))
    chains = chain.groupBy("facility").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(past).alias("n_past"), F.count_if(~past).alias("n_future"),
        (F.count_if(broken | F.col("loose")) == 0).alias("chain_consistent"), F.max(F.when(past, F.struct("rank", "event_id", "to", "a"))).alias("last"),
    )
    register = anchors.select(F.trim("ident").alias("to"), compared(F.struct("section", "name", "address"), ANCHOR_FIELDS).alias("kept")).groupBy("to").agg(F.min("kept").alias("listed"))
    lingering = members.join(register, members["ident"] == register["to"], "left_semi").select("facility").distinct().withColumn("lingers", F.lit(True))
    met = chains.withColumn("to", F.col("last.to")).join(register, "to", "left").join(lingering, "facility", "left")
    apart = differing(F.col("listed"), F.col("last.a"), ANCHOR_FIELDS)
    detail = (
        F.when(F.col("n_past") == 0, "no_past_events").when(F.col("to").isNull() & F.col("lingers").isNotNull(), "deleted_chain_still_present_in_anchor").when(F.col("to").isNull(), F.lit(None))
        .when(F.col("listed").isNull(), "terminal_identifier_absent_from_anchor").when(F.size(apart) > 0, "terminal_state_differs_from_anchor")
    )
    met = met.withColumn("detail", detail).withColumn("anchor_match", F.col("detail").isNull())
    verdict = checkpointed(met.select(
        "facility", "n_events", "n_past", "n_future", "chain_consistent", "anchor_match", (F.col("chain_consistent") & F.col("anchor_match")).alias("corroborated"), F.col("last.event_id").alias("terminal_event"),
        F.when(F.col("anchor_match"), F.when(F.col("to").isNull(), "absent_from_anchor").otherwise("present_in_anchor")).alias("terminal_kind"),
        "detail", F.when(F.col("detail") == "terminal_state_differs_from_anchor", apart).alias("fields"),
    ))

    if observations is None:
        observations = events.sparkSession.createDataFrame([], "event_id string, observed_at date, kind string").withColumn("event_id", F.col("event_id").cast(events.schema["event_id"].dataType))
    fit = observations.withColumn("row", F.col(key)).filter(F.col("kind").isin(*OBSERVATION_KINDS) & F.col("row").isNotNull() & F.col("observed_at").isNotNull())
    index = tm.observation_index(fit, "row", "observed_at")
    placed = chain.select("row", "facility", past.alias("past")).join(verdict, "facility")
    out = e.select("event_id", "row", "state", "at").join(placed, "row", "left").join(index, "row", "left")
    codes = F.array_compact(F.array(F.when(F.col("detail").isNotNull(), F.when(F.col("n_past") == 0, "no_past_events").otherwise("anchor_mismatch")), F.when(~F.col("chain_consistent"), "chain_inconsistent")))
    reasons = F.when(F.col("state") != "chained", F.array("state")).when(~F.col("past"), F.array(F.lit("future_event"))).otherwise(codes)
    out = out.withColumn("ok", F.coalesce(F.col("past") & F.col("corroborated"), F.lit(False))).withColumn("seen", F.col("conflict").isNotNull())
    dated_by = F.coalesce(F.col("ok") & ~F.col("conflict") & (F.col("observed_at") == F.col("at")), F.lit(False))
    out = checkpointed(out.withColumn("fixed", dated_by).withColumn("reasons", F.when(~F.col("ok"), reasons)))
    found = out.select(
        "event_id", "facility", F.when(F.col("ok"), "confirmed").otherwise("announced").alias("status"), F.col("ok").alias("state_corroborated"), F.col("fixed").alias("effective_date_confirmed"),
        F.when(F.col("fixed"), F.col("observed_at")).alias("confirmed_date"), F.when(F.col("fixed"), "observed").when(F.col("ok") & ~F.col("seen"), "planned").otherwise("unknown").alias("date_basis"), "reasons",
    )

    none = F.lit(None)
    kind_of_id = events.schema["event_id"].dataType
    row = lambda df, code, detail=none, facility=none, event=none, following=none, fields=none: df.select(
        code.alias("code"), detail.cast("string").alias("detail"), facility.cast("string").alias("facility"), event.cast(kind_of_id).alias("event_id"), following.cast(kind_of_id).alias("next_event_id"), fields.cast("array<string>").alias("fields"))
    c = F.col
    issues = [
        row(e.filter("state <> 'chained'"), c("state"), event=c("event_id")),
        row(chain.filter("loose"), F.lit("chain_inconsistent"), F.lit("same_date_events_do_not_thread"), c("facility"), c("event_id")),
        row(chain.filter(broken), F.lit("chain_inconsistent"), F.lit("after_state_does_not_match_next_before_state"), c("facility"), c("event_id"), c("next.event_id"), c("fields")),
        row(verdict.filter("detail IS NOT NULL"), F.when(c("n_past") == 0, "no_past_events").otherwise("anchor_mismatch"), c("detail"), c("facility"), c("terminal_event"), fields=c("fields")),
        row(out.filter("state = 'chained' AND NOT past"), F.lit("future_event"), facility=c("facility"), event=c("event_id")),
        row(out.filter("seen AND ok AND NOT fixed"), F.lit("date_observation_conflict"), F.when(c("conflict"), "observations_disagree"), c("facility"), c("event_id")),
        row(out.filter("seen AND NOT ok"), F.lit("date_observation_for_uncorroborated_event"), facility=c("facility"), event=c("event_id")),
        row(fit.join(e.select("row"), "row", "left_anti").select("event_id").distinct(), F.lit("date_observation_unknown_event"), event=c("event_id")),
        row(observations.filter(~F.coalesce(F.col("kind").isin(*OBSERVATION_KINDS), F.lit(False))), F.lit("date_observation_kind_rejected"), c("kind"), event=c("event_id")),
    ]
    joined = issues[0]
    for more in issues[1:]:
        joined = joined.unionByName(more)
    return Confirmed(found, verdict.drop("detail", "fields"), joined)


class History(NamedTuple):
    """``entities`` (facility, ident, section, name, address, exists, available, confidence, valid_from), ``states``
    (facility, event_id, valid_from, valid_to, exists, section, ident, name, address, status), ``lineage`` (facility, ident,
    role), ``basis`` (observed, planned, unknown, label) and ``problems`` (code, event_id, field)."""

    entities: DataFrame
    states: DataFrame
    lineage: DataFrame
    basis: DataFrame
    problems: DataFrame

    def identifiers(self) -> DataFrame:
        """Intervals of the identifiers that name a facility."""
        return self.states.filter(~text(F.col("ident")).isin(*ABSENT)).select("facility", "ident", "valid_from", "valid_to")


def event_problems(events: DataFrame, closures: tuple[str, ...] = (tm.CLOSED, tm.REOPENED)) -> DataFrame:
    """(code, event_id, field): repeated ids, references to nothing or round in a circle, and structural
    events of unofficial provenance. ``events`` (event_id, kind, provenance, revises, cancelled_by)."""
    kind = events.schema["event_id"].dataType
    none = F.lit(None).cast("string").alias("field")
    twice = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND event_id IS NOT NULL").select(F.lit("duplicate_event_id").alias("code"), "event_id", none)
    out = twice
    for field in ("revises", "cancelled_by"):
        # of an id that occurs twice the last reference would be as good as the first; one is enough to walk
        nodes = events.groupBy(F.col("event_id").alias("id")).agg(F.max(field).cast(kind).alias("parent")).filter("id IS NOT NULL")
        code = F.when(F.col("problem") == "missing", "unresolved_event_reference").otherwise("event_reference_cycle")
        out = out.unionByName(graph.chain_problems(nodes).select(code.alias("code"), F.col("id").alias("event_id"), F.lit(field).alias("field")))
    loose = events.filter(~F.coalesce("provenance", F.lit("official")).eqNullSafe(F.lit("official")) & ~F.coalesce(F.col("kind").isin(*closures), F.lit(False)))
    return out.unionByName(loose.select(F.lit("unofficial_structural_event").alias("code"), "event_id", none))


def in_force(events: DataFrame, closures: tuple[str, ...] = (tm.CLOSED, tm.REOPENED)) -> DataFrame:
    """``events`` with ``effective`` of those that count: dated, of a known kind, and confirmed if official or a
    closure if not; neither repeated nor revised, cancelled, cancelling or disabled.

    Revised and cancelled events go by reference, so a circle of revisions goes as a whole.
    """
    names = lambda c: events.filter(F.col(c).isNotNull()).select(F.col(c).alias("event_id"))
    repeated = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("event_id")
    gone = repeated.union(names("revises")).union(names("cancelled_by")).distinct()
    official = F.coalesce("provenance", F.lit("official")) == "official"
    sure = F.col("status").isin("confirmed", "effective")
    effective = F.when(official, F.when(sure, tm.effective_date(F.col("confirmed"), F.col("planned"), F.col("corroborated")))).otherwise(F.coalesce("observed", "planned"))
    known = F.col("kind").isNotNull() & ~F.col("kind").isin("", "unknown")
    admitted = F.when(official, known).otherwise(F.col("kind").isin(*closures))
    rows = events.withColumn("effective", effective).withColumn("official", official)
    rows = rows.filter(F.coalesce(admitted, F.lit(False)) & F.col("effective").isNotNull() & F.col("cancelled_by").isNull())
    if "disabled" in events.columns:
        rows = rows.filter(~F.coalesce("disabled", F.lit(False)))
    return rows.join(gone, "event_id", "left_anti")


def build_facility_history(events: DataFrame, anchors: DataFrame, anchor_at: Column, structural: tuple[str, ...] = tm.STRUCTURAL, closures: tuple[str, ...] = (tm.CLOSED, tm.REOPENED)) -> History:
    """Facilities by the identifiers that events join, and the intervals of their states.

    ``events`` (event_id, kind, provenance, status, confirmed, planned, observed, corroborated, revises,
    cancelled_by, before, after; ``disabled`` if there is one), ``anchors`` (section, ident, name, address, status): a
    register of the day ``anchor_at``; an identifier stands in it once. Identifiers of the register that no event
    names are facilities of their own.

    A facility that the register lists has the state given there; else the after state of its last
    structural event up to that day, or the before state of its first. One that the register doesn't list
    doesn't exist if its last event is still to come. Intervals start with the before state of the first
    structural event, open to the past; facilities without events have one interval from the
    anchor's day. Predecessors are identifiers that events only leave, successors those that they only reach.
    """
    rows = checkpointed(in_force(events, closures))
    start, end = live(F.col("before.ident"), ABSENT), live(F.col("after.ident"), ABSENT)
    named = facilities(rows, start, end)
    listed = anchors.select(F.struct(*PAYLOAD).alias("anchor"), text(F.trim("ident")).alias("ident"))
    own = listed.select("ident").join(named, "ident", "left_anti").select("ident", F.col("ident").alias("facility"))
    members = checkpointed(named.unionByName(own.distinct()))

    moves = rows.filter(F.col("official") & F.col("kind").isin(*structural)).select("event_id", "effective", "before", "after", F.coalesce(start, end).alias("ident"))
    moves = checkpointed(moves.join(members, "ident").drop("ident"))
    place = F.struct("effective", "event_id")
    told = moves.groupBy("facility").agg(
        F.min_by("before", place).alias("first"), F.max_by("after", F.when(F.col("effective") <= anchor_at, place)).alias("past"), F.max("effective").alias("latest"))
    held = listed.join(members, "ident").groupBy("facility").agg(F.min_by("anchor", "ident").alias("anchor"))
    least = members.groupBy("facility").agg(F.min("ident").alias("least"))
    entity = least.join(held, "facility", "left").join(told, "facility", "left")
    shape = F.lit(None).cast(anchors.select(F.struct(*PAYLOAD)).schema[0].dataType)
    as_payload = lambda s: F.when(s.isNotNull(), F.struct(*[s[p].alias(p) for p in PAYLOAD])).otherwise(shape)
    entity = entity.withColumn("state", F.coalesce("anchor", as_payload(F.col("past")), as_payload(F.col("first"))))
    ident = F.coalesce(F.when(text(F.col("state.ident")) != "", F.col("state.ident")), "least")
    ahead = F.col("anchor").isNull() & F.coalesce(F.col("latest") > anchor_at, F.lit(False))
    entity = checkpointed(entity.withColumn("ident", ident).withColumn("exists", ~F.col("ident").isin(*ABSENT) & ~ahead))
    entities = entity.select(
        "facility", "ident", "state.section", "state.name", "state.address", "exists", (~text(F.col("state.status")).isin(*CLOSED_STATUS)).alias("available"),
        F.when(F.col("latest").isNotNull(), "high").when(F.col("anchor").isNotNull(), "medium").otherwise("low").alias("confidence"), F.when(F.col("anchor").isNotNull(), anchor_at).alias("valid_from"),
    )

    first = told.select("facility", F.lit(None).cast(moves.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(moves.schema["effective"].dataType).alias("valid_from"), F.col("first").alias("s"))
    later = moves.select("facility", "event_id", F.col("effective").alias("valid_from"), F.col("after").alias("s"))
    spans = followed(first.unionByName(later), ["facility"], ["valid_from", "event_id"], ["valid_from"])
    still = entity.filter("latest IS NULL").select("facility", F.lit(None).cast(moves.schema["event_id"].dataType).alias("event_id"), F.when(F.col("anchor").isNotNull(), anchor_at).cast(moves.schema["effective"].dataType).alias("valid_from"), F.lit(None).cast(moves.schema["effective"].dataType).alias("valid_to"), F.col("state").alias("s"))
    spans = spans.select("facility", "event_id", "valid_from", F.col("next.valid_from").alias("valid_to"), as_payload(F.col("s")).alias("s")).unionByName(still)
    exists = ~text(F.col("s.ident")).isin(*ABSENT)
    states = spans.select("facility", "event_id", "valid_from", "valid_to", exists.alias("exists"), "s.section", F.when(exists, F.col("s.ident")).otherwise("").alias("ident"), "s.name", "s.address", "s.status")

    sides = moves.select("facility", live(F.col("before.ident"), ABSENT).alias("ident"), F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(moves.select("facility", live(F.col("after.ident"), ABSENT).alias("ident"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    ends = sides.filter("ident IS NOT NULL").groupBy("facility", "ident").agg(F.max("b").alias("b"), F.max("a").alias("a")).filter("a <> b")
    current = entity.select("facility", F.col("ident").alias("current"))
    lineage = ends.join(current, "facility").filter("ident <> current").select("facility", "ident", F.when(F.col("b") == 1, "predecessor").otherwise("successor").alias("role"))

    basis = F.when(F.col("official"), tm.date_basis(F.col("confirmed"), F.col("planned"), F.col("corroborated"))).otherwise(F.when(F.col("observed").isNotNull(), "observed").otherwise("planned"))
    counts = rows.select(basis.alias("basis")).agg(*[F.count_if(F.col("basis") == b).alias(b) for b in ("observed", "planned", "unknown")])
    return History(entities, states, lineage, counts.withColumn("label", tm.basis_label(F.col("observed"), F.col("planned"))), event_problems(events, closures))


def replay_states(events: DataFrame, anchors: DataFrame, cutoffs: DataFrame, closures: tuple[str, str] = (tm.CLOSED, tm.REOPENED)) -> DataFrame:
    """State of every entity at every cutoff, field by field: (entity, cutoff, section, ident, name, address, exists,
    available, n_applied, provenance).

    ``events`` (entity, at, event_id, kind, provenance, before, after), ``anchors`` (entity, anchor_at, section, ident,
    name, address, exists, available), ``cutoffs`` (cutoff): a list of days, broadcast. From the anchor on events
    are applied forward with their after states, before it backward with their before states. Events of
    other kinds than the two closures set the state: name and address are those of the last one applied, be
    they blank; section and identifier those of the last one applied that gives them; and the entity
    exists unless its identifier is none. Closures decide availability alone. Provenance is ``mixed`` once an
    unofficial event was applied.

    Each event falls to one cutoff, the first that it affects, and is aggregated there; running values over the
    cutoffs of an entity do the rest. So events are never multiplied by cutoffs, and no list of events is held.
    """
    days = cutoffs.select("cutoff").distinct().agg(F.sort_array(F.collect_list("cutoff")).alias("days"))  # the list of cutoffs is a setting
    started = anchors.select("entity", "anchor_at")
    e = events.select("entity", "at", "event_id", "kind", "provenance", "before", "after").join(started, "entity").crossJoin(F.broadcast(days))  # one row of cutoffs
    forward = F.col("at") > F.col("anchor_at")
    reached = F.size(F.filter("days", lambda d: d < F.col("at")))
    e = e.withColumn("forward", forward).withColumn("slot", F.when(forward, reached).otherwise(reached - 1))
    closing = F.coalesce(F.col("kind").isin(*closures), F.lit(False))
    state = F.when(F.col("forward"), F.struct(*[F.col(f"after.{f}").alias(f) for f in PAYLOAD[:4]])).otherwise(F.struct(*[F.col(f"before.{f}").alias(f) for f in PAYLOAD[:4]]))
    e = e.withColumn("s", F.when(~closing, state)).withColumn("place", F.struct("at", "event_id"))
    opened = F.when(closing, (F.col("kind") == closures[1]) == F.col("forward"))

    def nearest(value: Column, test: Column) -> Column:
        """Of the rows that pass, the value of the last one applied: the latest forward, the earliest backward."""
        found = F.when(test, F.struct(F.col("place"), value.alias("v")))
        return F.when(F.col("forward"), F.max(found)).otherwise(F.min(found))["v"]

    given = lambda f: F.col("s").isNotNull() & (text(F.col(f"s.{f}")) != "")
    sums = e.groupBy("entity", "forward", "slot").agg(
        nearest(F.struct(text(F.col("s.name")).alias("name"), text(F.col("s.address")).alias("address")), F.col("s").isNotNull()).alias("words"), nearest(F.col("s.section"), given("section")).alias("section_"),
        nearest(F.col("s.ident"), given("ident")).alias("ident_"), nearest(opened, closing).alias("open"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("provenance", F.lit("official")) != "official").alias("n_unofficial"),
    )
    spine = anchors.crossJoin(F.broadcast(days)).select("*", F.posexplode("days").alias("slot", "cutoff")).drop("days")  # one row of cutoffs
    spine = spine.withColumn("forward", F.col("cutoff") >= F.col("anchor_at"))
    met = spine.join(sums, ["entity", "forward", "slot"], "left")
    w = Window.partitionBy("entity", "forward").orderBy("slot")
    up, down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    carried: Callable[[str], Column] = lambda c: F.when(F.col("forward"), F.last(c, ignorenulls=True).over(up)).otherwise(F.first(c, ignorenulls=True).over(down))
    summed: Callable[[str], Column] = lambda c: F.coalesce(F.when(F.col("forward"), F.sum(c).over(up)).otherwise(F.sum(c).over(down)), F.lit(0))
    names = ("words", "section_", "ident_", "open")
    run = met.select("entity", "cutoff", "section", "ident", "name", "address", "exists", "available", *[carried(c).alias(f"c_{c}") for c in names], summed("n").alias("n_applied"), summed("n_unofficial").alias("n_unofficial"))
    ident = F.coalesce("c_ident_", "ident")
    return run.select(
        "entity", "cutoff", F.coalesce("c_section_", "section").alias("section"), ident.alias("ident"), F.coalesce("c_words.name", "name").alias("name"), F.coalesce("c_words.address", "address").alias("address"),
        F.when(F.col("c_words").isNull(), F.col("exists")).otherwise(~text(ident).isin(*ABSENT)).alias("exists"), F.coalesce("c_open", "available").alias("available"), "n_applied", F.when(F.col("n_unofficial") > 0, "mixed").otherwise("official").alias("provenance"),
    )


def applied_events(events: DataFrame, anchors: DataFrame, cutoff: Column) -> DataFrame:
    """(entity, event_id, backward, at) of the events that a replay to one cutoff applies."""
    e = events.select("entity", "at", "event_id").join(anchors.select("entity", "anchor_at"), "entity")
    ahead = (F.col("at") > F.col("anchor_at")) & (F.col("at") <= cutoff)
    behind = (F.col("at") > cutoff) & (F.col("at") <= F.col("anchor_at"))
    return e.filter(ahead | behind).select("entity", "event_id", behind.alias("backward"), "at")
