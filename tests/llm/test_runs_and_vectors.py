"""Periodic runs, vector codes and metric search on awkward tables and against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from netledger.llm import metric_search, periodic_runs, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, score string, node int, code int"


# 11 periodic runs


def slow_runs(words, least=24, powers=3):
    found = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, powers * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(rng, k):
    words = [rng.randrange(k) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        q, at = rng.randint(1, 9), rng.randint(0, len(words))
        words[at:at] = ([rng.randrange(k) for _ in range(q)] * 12)[: rng.randint(q, 12 * q)]
    return words


@pytest.mark.parametrize("pairs", [2, 0.001])  # few words heavy, all words heavy
def test_runs_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS_PER_STEP", pairs)
    rng = random.Random(5)
    for k in (1, 2, 3, 20) * 120:
        words = planted(rng, k)
        ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
        assert periodic_runs.runs_of(ids) == slow_runs(words)
        assert periodic_runs.runs_of(ids, 6, 2) == slow_runs(words, 6, 2)
        assert periodic_runs.lag_counts(ids, len(words) // 2).tolist() == [0] + [sum(a == b for a, b in zip(words, words[q:])) for q in range(1, len(words) // 2 + 1)]


def test_runs_of_awkward_rows(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("ab") for _ in range(60_000))
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t　 \x0b", 7), (4, "x " * 200_000, 7), (5, long, 7), (None, "a b c " * 30, 7), (6, "a b " * 6, 7), (6, "a b " * 6, 7), (7, "a b " * 5 + "a", None), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = periodic_runs.find_runs(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert all(got[i].n_words == n and got[i].runs == [] for i, n in ((1, 0), (2, 0), (3, 1), (8, 0)))
    assert got[4].runs == [(0, 200_000, 1)] and got[4].collapsed == "x" and got[5].n_words == 60_000
    assert got[None].runs == [(0, 60, 2)] and got[None].collapsed == "a b c" and got[None].text == rows[5][1]
    assert got[6].runs == [] and got[7].runs == []  # twelve and eleven words
    assert periodic_runs.find_runs(docs, least=11).filter("doc_id = 7").first().runs == [(0, 11, 2)]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_drill_query_equals_its_definition(spark, tmp_path):
    from zlib import crc32

    rng = random.Random(9)
    rows = [(i, " ".join(map(str, planted(rng, 4)))) for i in range(300)] + [(None, "a " * 40), (10, None), (11, "b " * 50), (11, "b " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc_id, text in rows:
        w = (text or "").split()
        h = crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
        runs = slow_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in periodic_runs.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and sum(r[1] > 0 for r in got) > 30


# 12 vector codes


def floors(v):
    return [int(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def slow_codes(rows, parts, entries, rounds):
    good = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(r[1]) for r in good) // parts)) * parts
    step = width // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for v in ([*floors(r[1]), *[0] * (width - len(r[1]))] for r in good)]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e))
    for _ in range(rounds):
        codes = [[nearest(v, p) for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, c in zip(cut, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for r, v in zip(good, cut):
        code = [nearest(v, p) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{c:02x}" for c in code), min(2**63 - 1, sum(far(v[p], books[p][c]) for p, c in enumerate(code)))))
    sums = {label: min(2**63 - 1, sum(r[3] for r in out if r[1] == label)) for label in {r[1] for r in out}}
    return [(*r, sums[r[1]]) for r in out], books


def vectors(rng, n, width=16):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([1, 1, 1, 2, None]), "x", 1, 2) for i in range(n)]
    rows += [(n + i, rows[0][1], 1, "x", 1, 2) for i in range(n // 3)]  # a vector that a third of the rows share
    rows += [(None, rows[1][1], 2, "x", 1, 2), (3, rows[2][1], 2, "x", 1, 2), rows[4], rows[4], (7000, rows[5][1][:5], 2, "x", 1, 2), (7001, [], None, "x", 1, 2)]
    bad = [None, [1.0, None], [float("nan")] * width, [float("inf")] * width, [-float("inf"), 1.0]]
    return rows + [(8000 + 50 * i, v, 1, None, None, None) for i, v in enumerate(bad)]


@pytest.mark.parametrize("parts,entries,rounds,scale", [(16, 8, 2, 1.0), (5, 70, 1, 1.0), (4, 4, 3, 1e12)])
def test_codes_equal_brute_force(spark, parts, entries, rounds, scale):
    rows = [(i, v and [x and x * scale for x in v], *rest) for i, v, *rest in vectors(random.Random(3), 150)]
    out, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(5), parts, entries, rounds)
    expected, plain = slow_codes(rows, parts, entries, rounds)
    assert books.tolist() == plain
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)


def test_codes_of_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 16, None, "x", 1, 2), (2, [-0.001] * 16, None, "x", 1, 2), (3, None, 1, "x", 1, 2)]
    df = spark.createDataFrame(rows, VECTORS)
    out, books = vector_codes.compress(df)
    assert books.shape == (16, 2, 1) and [(r.vec_id, r.code, r.error, r.label_error) for r in out.orderBy("vec_id").collect()] == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)]
    for none in (df.limit(0), df.filter("vec_id = 3")):
        out, books = vector_codes.compress(none)
        assert out.count() == 0 and books.size == 0
    out, _ = vector_codes.compress(spark.createDataFrame([(1, [], 1, "x", 1, 2)], VECTORS))
    assert [tuple(r) for r in out.collect()] == [(1, 1, "00" * 16, 0, 0)]


def test_rare_and_frequent_labels_get_their_sums(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 4)
    codes = spark.createDataFrame([(i, 1 if i % 2 else (None if i % 4 else i), "", i) for i in range(100)], "vec_id long, label int, code string, error long")
    got = {r.vec_id: r.label_error for r in vector_codes.with_label_sums(codes).collect()}
    assert len(got) == 100 and got[1] == sum(range(1, 100, 2)) and got[2] == sum(range(2, 100, 4)) and got[8] == 8


# 13 exact top-k search


def slow_top(rows, every, k):
    good = [(r[0], floors(r[1])) for r in usable(rows)]
    clip = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    out = []
    for i, (a, v) in enumerate(good):
        if a is not None and a % every == 0:
            scored = sorted(((-clip(sum(x * y for x, y in zip(v, w))), b is None, b or 0) for j, (b, w) in enumerate(good) if j != i))
            out += [(a, rank, None if void else b, -s) for rank, (s, void, b) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("scale,k,page", [(1.0, 5, 128), (1.0, 3, 7), (1e9, 5, 16), (1e-3, 5, 16)])
def test_search_equals_brute_force(spark, monkeypatch, scale, k, page):
    for name, value in (("PAGE", page), ("NODE", page), ("GROUP", 6 * page), ("BLOCK", 10)):
        monkeypatch.setattr(metric_search, name, value)
    rows = [(i, v and [x and x * scale for x in v], *rest) for i, v, *rest in vectors(random.Random(4), 300)]
    out = metric_search.top_k(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 10 == 0, k)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(slow_top(rows, 10, k), key=repr)


def test_search_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "x", 1, 2), (0, [1.0], 1, "x", 1, 2), (None, [2.0], 1, "x", 1, 2), (50, None, 1, "x", 1, 2)], VECTORS)
    asked = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, metric_search.top_k(df, asked).collect())) == [(0, 1, None, 131072), (0, 1, None, 131072), (0, 2, 0, 65536), (0, 2, 0, 65536)]
    for none in (df.limit(0), df.filter("vec_id = 50"), df.filter("vec_id is null"), df.filter("vec_id is null").union(df.filter("vec_id = 50"))):
        assert metric_search.top_k(none, asked).count() == 0


def test_bounds_spare_most_scores_of_clustered_vectors():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(40, 1, 8)) * 4 + rng.normal(size=(40, 100, 8)) * 0.05).reshape(-1, 8))
    bound = float((x * x).sum(axis=1).max()) + 1
    tree = metric_search.plant(x[rng.permutation(len(x))[:500]], 4 * metric_search.NODE * 100, bound, True)
    node, far = metric_search.route(x, tree)
    order, pages = np.lexsort((far, node)), []
    for n in np.unique(node):
        mine = order[node[order] == n]
        for at in range(0, len(mine), 32):
            own = mine[at : at + 32]
            d = metric_search.apart(x[own], x[own[:1]], bound)[:, 0]
            pages.append({"node": n, "radius": d.max(), "to_node": far[own[0]], "centre": 0, "rid": own, "name": own, "void": np.zeros(len(own), bool), "far": d, "v": x[own]})
    asked = np.arange(0, 100, 10)  # of one cluster
    best, computed = metric_search.visit(tree, x[asked], asked, np.full(10, metric_search.NONE), pages, 5)
    scores = (x[asked] @ x.T).astype(np.int64)
    scores[np.arange(10), asked] = metric_search.NONE
    assert (best.score == ~np.sort(~scores, axis=1)[:, :5]).all() and computed < scores.size / 4
