"""Places of calls that wait for others, against a plain walk in the order of the graph."""

import random

from netledger.llm import chat


def plain(calls, waits, results):
    """{id: (turn, step)}: calls are placed once all that they wait for are; the others keep their turn."""
    needs = {}
    for i, n in waits:
        if n in calls:
            needs.setdefault(i, set()).add(n)
    placed = {i: (t, 0) for i, t in calls.items() if i not in needs}
    while True:
        ready = [i for i in needs if i not in placed and needs[i] <= placed.keys()]
        if not ready:
            return {i: placed.get(i, (t, 0)) for i, t in calls.items()}
        for i in ready:
            at = (calls[i], 0)
            for n in needs[i]:
                turn, step = placed[n]
                end = max((turn, step + 1), (results[n], 0)) if n in results else (turn, step)
                at = max(at, (end[0], end[1] + 1))
            placed[i] = at


def placed(spark, calls, waits, results):
    first = spark.createDataFrame([(None, i, t) for i, t in calls.items()], "conv_id long, id string, call_turn long")
    edges = spark.createDataFrame([(None, i, n) for i, n in waits], "conv_id long, id string, needs string")
    answers = spark.createDataFrame([(None, i, t) for i, t in results.items()] + [(None, None, 5)], "conv_id long, id string, turn long")
    rows = chat.placed_calls(first, edges, answers).collect()
    assert len(rows) == len(calls)
    return {r.id: (r.place.turn, r.place.step) for r in rows}


def test_a_chain_of_a_thousand_calls(spark, monkeypatch):
    rounds, one = [], chat.stored
    monkeypatch.setattr(chat, "stored", lambda d: rounds.append(1) or one(d))
    calls = {f"c{i}": 1000 - i for i in range(1000)}
    waits = [(f"c{i}", f"c{i - 1}") for i in range(1, 1000)]
    results = {f"c{i}": 2000 + i % 7 for i in range(1000) if i % 3}
    assert placed(spark, calls, waits, results) == plain(calls, waits, results)
    assert len(rounds) < 30


def test_graphs_with_forks_joins_and_circles(spark):
    rng = random.Random(4)
    calls = {f"c{i}": rng.randrange(50) for i in range(150)}
    waits = [(f"c{i}", f"c{rng.randrange(max(i - 12, 0), i)}") for i in range(1, 100) for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))]
    waits += [("c101", "c100"), ("c102", "c101"), ("c100", "c102"), ("c103", "c102"), ("c104", "c103"), ("c104", "c5"), ("c105", "c106"), ("c106", "c105"), ("c106", "c3"), ("c105", "c4"), ("c110", "gone"), ("c111", "c110"), ("c111", "gone")]
    results = {i: rng.randrange(80) for i in calls if rng.random() < 0.6}
    assert placed(spark, calls, waits, results) == plain(calls, waits, results)


def test_calls_that_wait_for_nothing(spark):
    assert placed(spark, {"a": 3}, [("a", "gone")], {}) == {"a": (3, 0)}
