"""Corroboration, history by component, and replay field by field."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netledger.operators.running import followed
from netledger.plans import facilities as fc

STATE = "struct<section:string,ident:string,name:string,address:string,status:string,simple:string,area:string,services:array<string>>"


def state(ident, name="甲郵便局", address="東京都港区１", section="postal_office", services=("○",) * 5, area="", status=""):
    return (section, ident, name, address, status, "", area, list(services))


def announced(spark, rows):
    """Rows (event_id, planned, before, after)."""
    return spark.createDataFrame(rows, f"event_id string, planned string, before {STATE}, after {STATE}")


def register(spark, *states):
    return spark.createDataFrame([s[:5] for s in states], "section string, ident string, name string, address string, status string")


def run(spark, rows, *states, seen=None):
    out = fc.confirm_chains(announced(spark, rows), register(spark, *states), F.lit("2026-06-30").cast("date"), seen)
    issues = {}
    for r in out.issues.collect():
        issues.setdefault(r.code, []).append(r)
    return {r.event_id: r for r in out.events.collect()}, {r.facility: r for r in out.chains.collect()}, issues


A, B, C, D = (state("000100", address=f"東京都港区{i}") for i in "１２３４")


def test_one_event_gives_the_state_but_not_the_date(spark):
    events, chains, issues = run(spark, [("e1", "2020-05-01", A, B)], B)
    assert events["e1"][2:7] == ("confirmed", True, False, None, "planned") and not issues
    assert chains["000100"].terminal_kind == "present_in_anchor" and chains["000100"].corroborated


def test_a_round_trip_stays_planned(spark):
    events, _, _ = run(spark, [("e1", "2020-05-01", A, B), ("e2", "2021-05-01", B, A)], A)
    assert {(e.state_corroborated, e.date_basis) for e in events.values()} == {(True, "planned")}


def test_events_of_one_day_follow_their_states(spark):
    day = "2020-05-01"
    events, chains, _ = run(spark, [("e1", day, C, D), ("e2", day, B, C), ("e3", day, A, B), ("e4", "2020-06-01", D, A)], A)
    assert all(e.state_corroborated for e in events.values()) and chains["000100"].n_events == 4
    # the terminal event is the last of the thread, not of the ids
    assert run(spark, [("e2", day, A, B), ("e1", day, B, C)], C)[1]["000100"].terminal_event == "e1"


def test_a_day_that_does_not_thread_is_named(spark):
    day = "2020-05-01"
    events, chains, issues = run(spark, [("e1", day, A, B), ("e2", day, C, D), ("e3", "2020-01-01", D, A)], D)
    assert not chains["000100"].chain_consistent and all(e.reasons == ["chain_inconsistent"] for e in events.values())
    loose = [r.event_id for r in issues["chain_inconsistent"] if r.detail == "same_date_events_do_not_thread"]
    assert sorted(loose) == ["e1", "e2"]


def test_fields_that_break_are_named_and_spellings_are_not(spark):
    spelt = state("000100", name="甲 郵便局", address="東京都港区２", services=("◯",) * 5)
    events, _, issues = run(spark, [("e1", "2020-05-01", A, B), ("e2", "2021-05-01", spelt, C)], C)
    assert events["e2"].state_corroborated and not issues
    other = state("000100", address="東京都港区２", area="○", services=("○",) * 4)
    events, _, issues = run(spark, [("e1", "2020-05-01", A, B), ("e2", "2021-05-01", other, C)], C)
    row = issues["chain_inconsistent"][0]
    assert (row.event_id, row.next_event_id, row.fields) == ("e1", "e2", ["area", "services"]) and not events["e1"].state_corroborated


def test_the_register_decides(spark):
    events, _, issues = run(spark, [("e1", "2020-05-01", A, B)], state("000100", address="東京都港区９", section="company"))
    row = issues["anchor_mismatch"][0]
    assert events["e1"].reasons == ["anchor_mismatch"] and (row.detail, row.fields) == ("terminal_state_differs_from_anchor", ["section", "address"])
    _, _, issues = run(spark, [("e1", "2020-05-01", A, B)], state("000200"))
    assert issues["anchor_mismatch"][0].detail == "terminal_identifier_absent_from_anchor"


def test_a_deleted_chain_is_absent_with_all_its_identifiers(spark):
    old, new, gone = state("000100"), state("000200"), state("－")
    rows = [("e1", "2020-05-01", old, new), ("e2", "2021-05-01", new, gone)]
    events, chains, _ = run(spark, rows, state("000300"))
    assert events["e1"].state_corroborated and chains["000100"].terminal_kind == "absent_from_anchor"
    for lingering in (old, new):
        events, chains, issues = run(spark, rows, lingering)
        assert not events["e2"].state_corroborated and issues["anchor_mismatch"][0].detail == "deleted_chain_still_present_in_anchor"


def test_dates_and_identifiers_that_are_none(spark):
    gone = state("-")
    rows = [("e1", "R8.13.99", A, B), ("e2", None, A, B), ("e3", " ", A, B), ("e4", "2020-01-01", gone, gone), ("e5", "2030-01-01", A, B), ("e6", "2030-01-01", A, B)]
    events, chains, issues = run(spark, rows, A)
    assert {k: e.reasons for k, e in events.items()} == {"e1": ["invalid_planned_date"], "e2": ["missing_planned_date"], "e3": ["missing_planned_date"], "e4": ["unresolvable_identifier"], "e5": ["future_event"], "e6": ["duplicate_announcement"]}
    assert "no_past_events" in issues and chains["000100"].n_future == 1


def test_observations_fix_dates(spark):
    day = lambda m, d: dt.date(2020, m, d)
    rows = [("e1", "2020-05-01", A, B), ("e2", "2020-06-01", B, C), ("e3", "2020-07-01", C, D), ("e4", "2020-08-01", D, A), ("e5", "2020-05-01", state("000500"), state("000500", name="x"))]
    seen = [("e1", day(5, 1), "current_list_snapshot"), ("e2", day(7, 9), "official_notice"), ("e3", day(7, 1), "official_notice"), ("e3", day(7, 2), "official_notice"), ("e4", day(8, 1), "blog_post"), ("e5", day(5, 1), "official_notice"), ("zz", day(5, 1), "official_notice")]
    events, _, issues = run(spark, rows, A, seen=spark.createDataFrame(seen, "event_id string, observed_at date, kind string"))
    assert {k: (e.date_basis, e.confirmed_date) for k, e in events.items()} == {"e1": ("observed", day(5, 1)), "e2": ("unknown", None), "e3": ("unknown", None), "e4": ("planned", None), "e5": ("unknown", None)}
    assert sorted((r.event_id, r.detail) for r in issues["date_observation_conflict"]) == [("e2", None), ("e3", "observations_disagree")]
    assert {issues[c][0].event_id for c in ("date_observation_for_uncorroborated_event", "date_observation_unknown_event", "date_observation_kind_rejected")} == {"e5", "zz", "e4"}


def test_no_events_and_no_register(spark):
    assert run(spark, []) == ({}, {}, {})
    assert run(spark, [("e1", "2020-05-01", A, B)])[0]["e1"].reasons == ["anchor_mismatch"]


def test_followers_of_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 1000 == 0).alias("g"), (F.col("id") * 7 % 3001).alias("n"))
    out = followed(df, ["g"], ["n"], ["n"]).collect()
    for g in (True, False):
        mine = sorted((r.n, r.next and r.next.n) for r in out if r.g == g)
        assert [n for _, n in mine] == [n for n, _ in mine][1:] + [None]


EVENTS = f"event_id string, kind string, provenance string, status string, confirmed date, planned date, observed date, corroborated boolean, revises string, cancelled_by string, before {STATE}, after {STATE}, disabled boolean"


def event(eid, kind="relocation", confirmed=None, planned=None, corroborated=None, before=A, after=B, provenance="official", status="confirmed", observed=None, revises=None, cancelled_by=None, disabled=None):
    day = lambda s: s and dt.date.fromisoformat(s)
    return (eid, kind, provenance, status, day(confirmed), day(planned), day(observed), corroborated, revises, cancelled_by, before, after, disabled)


def history(spark, rows, *states, at="2026-01-31"):
    return fc.build_facility_history(spark.createDataFrame(rows, EVENTS), register(spark, *states), F.lit(at).cast("date"))


def spans(h):
    return sorted((r.facility, str(r.valid_from), str(r.valid_to), r.ident, r.address, r.exists) for r in h.states.collect())


def test_planned_dates_count_only_if_the_state_is_corroborated(spark):
    for row, label, n in ((event("e", planned="2026-02-01", corroborated=True), "planned", 2), (event("e", planned="2026-02-01", confirmed="2026-02-01", corroborated=True), "observed", 2), (event("e", planned="2026-02-01"), "none_applied", 1)):
        h = history(spark, [row], A)
        assert h.basis.first().label == label and len(spans(h)) == n
    both = history(spark, [event("e", planned="2026-02-01", corroborated=True), event("f", confirmed="2026-03-01", before=B, after=C)], A)
    assert tuple(both.basis.first()) == (1, 1, 0, "mixed")
    assert spans(both) == [("000100", "2026-02-01", "2026-03-01", "000100", B[3], True), ("000100", "2026-03-01", "None", "000100", C[3], True), ("000100", "None", "2026-02-01", "000100", A[3], True)]


def test_a_change_of_identifier_keeps_the_facility(spark):
    new, newer = state("000200"), state("000300")
    rows = [event("a", "office_type_change", "2026-02-01", before=A, after=new), event("b", "renamed", "2026-03-01", before=new, after=newer)]
    h = history(spark, rows, A, state("000900"))
    assert {(r.facility, r.ident, r.exists, r.confidence) for r in h.entities.collect()} == {("000100", "000100", True, "high"), ("000900", "000900", True, "medium")}
    assert {tuple(r) for r in h.lineage.collect()} == {("000100", "000300", "successor")}
    assert sorted(r.ident for r in h.identifiers().collect()) == ["000100", "000200", "000300", "000900"]
    late = history(spark, rows, newer)
    assert late.entities.first().ident == "000300" and {tuple(r) for r in late.lineage.collect()} == {("000100", "000100", "predecessor")}


def test_facilities_that_the_register_does_not_list(spark):
    rows = [event("a", "established", "2025-05-01", before=state("-"), after=state("000400")), event("b", "established", "2026-05-01", before=state("-"), after=state("000500")), event("c", "abolished", "2025-06-01", before=state("000600"), after=state("-"))]
    h = history(spark, rows)
    assert {r.facility: (r.ident, r.exists, r.valid_from) for r in h.entities.collect()} == {"000400": ("000400", True, None), "000500": ("-", False, None), "000600": ("-", False, None)}
    assert ("000600", "2025-06-01", "None", "", A[3], False) in spans(h)


def test_revised_cancelled_repeated_and_disabled_events_go(spark):
    rows = [event("old", confirmed="2026-02-01"), event("new", confirmed="2026-03-01", revises="old"), event("x", confirmed="2026-02-02", cancelled_by="y"), event("y", confirmed="2026-02-03"), event("twice", confirmed="2026-02-04"), event("twice", confirmed="2026-02-05"), event("off", confirmed="2026-02-06", disabled=True), event("ann", confirmed="2026-02-07", status="announced"), event("un", confirmed="2026-02-07", provenance="unofficial"), event("none", kind=None, confirmed="2026-02-07")]
    h = history(spark, rows, A)
    assert {r.event_id for r in h.states.collect()} == {None, "new"}
    assert {(r.code, r.event_id) for r in h.problems.collect()} == {("duplicate_event_id", "twice"), ("unofficial_structural_event", "un")}
    ring = history(spark, [event("a", confirmed="2026-02-01", revises="b"), event("b", confirmed="2026-02-02", revises="a"), event("c", confirmed="2026-02-03", revises="zz"), event("d", confirmed="2026-02-03", revises="d")], A)
    assert {(r.code, r.event_id) for r in ring.problems.collect()} == {("event_reference_cycle", "a"), ("event_reference_cycle", "b"), ("unresolved_event_reference", "c"), ("event_reference_cycle", "d")}
    assert {r.event_id for r in ring.states.collect()} == {None, "c"}


REPLAYED = f"entity string, at date, event_id string, kind string, provenance string, before {STATE}, after {STATE}"


def replayed(spark, rows, cutoffs, at="2026-01-01", exists=True):
    day = dt.date.fromisoformat
    e = spark.createDataFrame([("f", day(d), i, k, p, b, a) for i, k, d, p, b, a in rows], REPLAYED)
    anchor = spark.createDataFrame([("f", day(at), "postal_office", "000001", "中央郵便局", "東京都千代田区１－１", exists, True)], "entity string, anchor_at date, section string, ident string, name string, address string, exists boolean, available boolean")
    days = spark.createDataFrame([(day(c),) for c in cutoffs], "cutoff date")
    return {str(r.cutoff): r for r in fc.replay_states(e, anchor, days).collect()}


def test_closures_change_availability_alone(spark):
    rows = [("close", "temporarily_closed", "2026-02-01", "official", A, B), ("open", "reopened", "2026-03-01", "unofficial", A, B)]
    out = replayed(spark, rows, ["2026-01-15", "2026-02-15", "2026-04-01"])
    assert [(r.available, r.exists, r.address, r.n_applied, r.provenance) for _, r in sorted(out.items())] == [(True, True, "東京都千代田区１－１", 0, "official"), (False, True, "東京都千代田区１－１", 1, "official"), (True, True, "東京都千代田区１－１", 2, "mixed")]
    back = replayed(spark, rows, ["2026-01-15", "2026-02-15", "2026-04-01"], at="2026-05-01")
    assert [r.available for _, r in sorted(back.items())] == [True, False, True]


def test_identifier_and_section_fall_back_where_name_and_address_do_not(spark):
    rows = [("a", "renamed", "2026-02-01", None, state("", "", "x", section=""), state("000002", "n2", "x2", section="company")), ("b", "renamed", "2026-03-01", None, state("000002"), state("", "", "", section=None)), ("c", "abolished", "2026-04-01", None, state("000002"), state("-", "gone")), ("d", "renamed", "2026-05-01", None, state("-"), state(None, "after"))]
    out = replayed(spark, rows, ["2026-02-28", "2026-03-31", "2026-04-30", "2026-05-31"])
    got = [(r.section, r.ident, r.name, r.address, r.exists) for _, r in sorted(out.items())]
    assert got == [("company", "000002", "n2", "x2", True), ("company", "000002", "", "", True), ("postal_office", "-", "gone", A[3], False), ("postal_office", "-", "after", A[3], False)]
    back = replayed(spark, rows, ["2026-01-31", "2026-02-28"], at="2026-06-01")
    assert [(r.section, r.ident, r.name, r.address) for _, r in sorted(back.items())] == [("postal_office", "000002", "", "x"), ("postal_office", "000002", "甲郵便局", A[3])]


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_applying_events_one_by_one(spark, seed):
    import random

    rng = random.Random(seed)
    pick = lambda: state(rng.choice(["", "-", None, "000007", "000008"]), rng.choice(["", "p", "q"]), rng.choice(["", "u", "v"]), rng.choice(["", None, "s", "t"]))
    rows = [(f"e{i:02}", rng.choice(["temporarily_closed", "reopened", "relocation", "renamed"]), f"2026-{rng.randint(1, 6):02}-{rng.randint(1, 28):02}", rng.choice([None, "official", "unofficial"]), pick(), pick()) for i in range(25)]
    cutoffs = ["2025-12-31", "2026-02-14", "2026-03-10", "2026-03-15", "2026-05-01", "2026-07-01"]
    out = replayed(spark, rows, cutoffs, at="2026-03-10", exists=False)
    for cutoff in cutoffs:
        at, back = "2026-03-10", cutoff < "2026-03-10"
        entity = {"section": "postal_office", "ident": "000001", "name": "中央郵便局", "address": "東京都千代田区１－１", "exists": False, "available": True}
        met = sorted((r for r in rows if (cutoff < r[2] <= at if back else at < r[2] <= cutoff)), key=lambda r: (r[2], r[0]), reverse=back)
        for _, kind, _, _, before, after in met:
            if kind in ("temporarily_closed", "reopened"):
                entity["available"] = (kind == "reopened") != back
                continue
            s = before if back else after
            entity["section"], entity["ident"] = s[0] or entity["section"], s[1] or entity["ident"]
            entity["name"], entity["address"], entity["exists"] = s[2], s[3], (s[1] or entity["ident"]) not in ("", "-")
        r = out[cutoff]
        assert {f: r[f] for f in entity} == entity and r.n_applied == len(met) and (r.provenance == "mixed") == any(x[3] == "unofficial" for x in met)
