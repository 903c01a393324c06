"""Each operator on awkward tables, against brute force where it has no SQL."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netledger.llm import chat, embeddings, mixing, paragraphs, quality_classifier, quality_rules, secrets, sentencepiece_codec, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def prose(rng, n):
    return " ".join(rng.choice("the of and river stone garden window letter morning quiet table under light paper".split()) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and a clashing column."""
    rng = random.Random(1)
    long = prose(rng, 20_000)
    rows = [(i, prose(rng, 60), "en", f"s{i % 3}", 1, "x") for i in range(20)]
    rows += [(100, None, None, None, None, None), (None, "only text", "en", "s1", 9, "x"), (101, "", "en", "s0", 0, "x"), (102, " \n\t ", "en", "s0", 4, "x"), (103, long, "en", "s0", 1, "x")]
    rows += [rows[0], rows[0], (200, rows[1][1], "en", "s2", 1, "y"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# 1 SimHash


def fingerprint(text, k=3):
    from xxhash import xxh64_intdigest

    h = [xxh64_intdigest(s, 42) for s in simhash.shingles((text or "").encode(), k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_their_definition(awkward):
    got = {r.doc_id: r.f0 % 2**64 for r in simhash.fingerprints(awkward.filter("doc_id IS NOT NULL")).collect()}
    texts = {r.doc_id: r.text for r in awkward.filter("doc_id IS NOT NULL").collect()}
    assert got == {i: fingerprint(t) for i, t in texts.items()}
    assert got[100] == got[101] == got[102] == 0


@pytest.mark.parametrize("crowd", [1, 32])
def test_links_have_the_components_of_all_pairs(spark, crowd):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = set(centres)
    for c in centres[:10]:
        for _ in range(15):
            prints.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    near = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    classes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    got = [(r.a, r.b) for r in simhash.links(classes, crowd).collect()]
    assert set(map(tuple, map(sorted, got))) <= set(near)
    assert components(range(len(prints)), got) == components(range(len(prints)), near)


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[200] == 1 and by[0] == 0 and by[100] == by[101] == by[102] == 100
    assert simhash.near_duplicates(nothing).count() == 0


def test_drop_near_duplicates_keeps_one_of_each_group(spark, awkward, nothing):
    rng = random.Random(3)
    base = prose(rng, 300)
    words = base.split()
    copies = [(1000 + i, " ".join(words[:i * 9] + ["changed"] + words[i * 9 + 1 :]), "en", "s", 1, "x") for i in range(30)]
    docs = awkward.unionByName(spark.createDataFrame([(999, base, "en", "s", 1, "x"), *copies, (5000, prose(rng, 300), "en", "s", 1, "x")], DOCS))
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = collections.Counter(r.doc_id for r in out.collect())
    assert kept[999] == 1 and kept[5000] == 1 and not any(kept[1000 + i] for i in range(30))
    assert kept[0] == 1 and kept[1] == 1 and kept[200] == 0 and kept[103] == 1
    assert simhash.drop_near_duplicates(nothing).count() == 0


# 2 embeddings


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    rows = [v for v in base]
    for v in base[:12]:  # neighbours on both sides of the threshold
        for angle in np.arccos([0.999, 0.97, 0.945, 0.935, 0.925, 0.9]):
            w = rng.normal(size=64)
            w -= (w @ v) / (v @ v) * v
            rows.append(np.cos(angle) * v / np.linalg.norm(v) + np.sin(angle) * w / np.linalg.norm(w))
    rows += [rows[0] * 1e-150, rows[1]]
    x = np.array(rows)
    labels = np.arange(len(x)) % 40 % 2
    labels[40:] = np.repeat(np.arange(12) % 2, 6).tolist() + [0, 1]
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    bad = [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] + [1.0] * 63, 0), (904, x[0].tolist(), None), (905, [], 0), (906, [float("inf")] * 64, 0), (907, [1.0, 2.0], 0)]
    data = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))] + bad
    out = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(out) == len(data)
    parts = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    assert all((out[i].component_id, out[i].kept) == (parts[i], parts[i] == i) for i in range(len(x)))
    got, want = sum(out[i].n_links for i in range(len(x))), int(near.sum())
    assert got >= 0.9 * want and all(out[i].n_links <= near[i].sum() for i in range(len(x)))
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True) for i in range(900, 908))
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_a_common_vector_leaves_room_for_other_pivots(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0] * 16, 0, "x") for i in range(300)] + [(1000 + i, rng.normal(size=16).tolist(), 0, "x") for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h string")
    assert len(embeddings.choose_pivots(table.select(F.col("embedding").alias("v")).distinct())) > 40
    out = {r.vec_id: r for r in embeddings.link(table).collect()}
    assert {(out[i].n_links, out[i].component_id) for i in range(300)} == {(299, 0)} and len(out) == 360


# 3 paragraphs


def test_passages_within_running_text_are_found(spark, awkward, nothing):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(51))
    hosts = [prose(rng, 200).split() for _ in range(8)]
    rows = [(i, " ".join(h[: 17 * i] + [passage] + h[17 * i :]), "en", "s", 1, "x") for i, h in enumerate(hosts[:6])]
    rows += [(50 + i, " ".join(h), "en", "s", 1, "x") for i, h in enumerate(hosts[6:])]
    got = paragraphs.repeated(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == list(range(6))
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id][r.start : r.end] in passage and len(texts[r.doc_id][r.start : r.end].split()) >= 51 - 2 * (paragraphs.REACH - 1) for r in got)
    assert {r.doc_id for r in got if not r.kept} == set(range(1, 6)) and {r.keeper_doc_id for r in got} == {0}
    again = paragraphs.repeated(awkward).collect()
    assert {r.doc_id for r in again} == {1, 200}
    assert paragraphs.repeated(nothing).count() == 0


def test_runs_of_thirty_words_are_always_found(spark):
    # in other surroundings each time, with a word changed next to them
    rng = random.Random(15)
    word = lambda: f"u{rng.getrandbits(40)}"
    rows, want = [], set()
    for p in range(40):
        run = [word() for _ in range(paragraphs.BLOCK + paragraphs.REACH - 1)]
        for copy in range(2):
            rows.append((2 * p + copy, " ".join([word() for _ in range(rng.randint(0, 60))] + run + [word() for _ in range(rng.randint(0, 60))]), "en", "s", 1, "x"))
            want.add(2 * p + copy)
    assert {r.doc_id for r in paragraphs.repeated(spark.createDataFrame(rows, DOCS)).collect()} == want


def lines_by_brute_force(texts):
    """(doc, line) of each line of LINE words or more that goes, and those that stay for others."""
    lines = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate(t.split("\n")) if len(line.split()) >= paragraphs.LINE]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, _, line in lines for w in [line.lower().split()]]
    near = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parts = components(range(len(lines)), near)
    docs = collections.defaultdict(set)
    for n, c in parts.items():
        docs[c].add(lines[n][0])
    return {(lines[n][0], lines[n][1], n == c) for n, c in parts.items() if len(docs[c]) > 1}


@pytest.mark.parametrize("crowd", [1, 16])
def test_near_paragraphs_equal_brute_force(spark, crowd):
    # families of edited lines, stars, and unlike lines that share a frequent phrase
    rng = random.Random(16)
    word = lambda: f"v{rng.getrandbits(40)}"
    phrase = [f"p{i}" for i in range(12)]
    lines = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(49, 70))]
        lines.append(base)
        for _ in range(6):
            line = list(rng.choice([base, lines[-1]]))
            line[rng.randrange(len(line))] = word()
            lines.append(line)
    lines += [phrase + [word() for _ in range(25)] for _ in range(60)] + [[word()] + lines[0][1:] for _ in range(40)]
    rng.shuffle(lines)
    texts = ["\n".join(" ".join(x) for x in lines[i : i + 3]) for i in range(0, len(lines), 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)], DOCS)
    cut = paragraphs.units(docs).filter("n IS NOT NULL").collect()
    place = {(r.doc_id, r.start): r for r in cut}
    got = set()
    for r in paragraphs.repeated_units(docs, crowd).collect():
        if (r.doc_id, r.start) in place and r.end == place[r.doc_id, r.start].end:
            got.add((r.doc_id, texts[r.doc_id][: r.start].count("\n"), r.kept))
    want = lines_by_brute_force(texts)
    assert len(want) > 60 and got == want


def test_no_id_counts_as_no_document(spark):
    rng = random.Random(17)
    text = " ".join(f"z{rng.getrandbits(40)}" for _ in range(60))
    docs = lambda *ids: spark.createDataFrame([(i, text, "en", "s", 1, "x") for i in ids], DOCS)
    assert paragraphs.repeated(docs(None, None, 5)).count() == 0
    assert {(r.doc_id, r.kept) for r in paragraphs.repeated(docs(None, 5, 7, 7)).collect()} == {(None, False), (5, True), (7, False)}


# 4 classifier


def test_classifier_separates_held_out_rows(spark, nothing):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        docs.append((i, prose(rng, 80) if good else " ".join(["###", "$$$"] * 40), "en", "s", 1, "x"))
        labels.append((i, int(good), 0))
    docs += [(900, None, None, None, None, None), (901, "", "en", "s", 0, "x")]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(d, quality_classifier.learn(d, lab)).withColumn("h", quality_classifier.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.h and r.doc_id < 900]
    assert len(held) > 40 and np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    none = quality_classifier.learn(d, lab.limit(0))
    assert {r.score for r in quality_classifier.classify(d, none).collect()} == {0.5}
    assert quality_classifier.classify(nothing, none).count() == 0


def test_ranking_equals_a_slow_fit(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3))
    good = x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=120) > 0.4
    found = quality_classifier.fit(x, good)
    wins, losses, scale = x[good], x[~good], x.std(axis=0)
    n, few = max(len(wins), len(losses)), min(len(wins), len(losses))
    pairs = [(i, i + k * max(1, few // quality_classifier.OPPONENTS)) for i in range(n) for k in range(quality_classifier.OPPONENTS)]
    d = np.array([(wins[(i if len(wins) == n else j) % len(wins)] - losses[(j if len(wins) == n else i) % len(losses)]) / scale for i, j in pairs])
    w = np.zeros(3)
    for _ in range(20_000):  # plain descent on the same loss
        w -= 0.5 * (quality_classifier.RIDGE * w - (d / (1 + np.exp(d @ w))[:, None]).mean(axis=0))
    assert np.array(found.weights) * scale == pytest.approx(w, rel=1e-4, abs=1e-5)
    strengths = sorted(x @ np.array(found.weights))
    at = (~good).mean() * (len(strengths) - 1)
    low = int(at)
    assert found.cut == pytest.approx(strengths[low] + (at - low) * (strengths[min(low + 1, len(strengths) - 1)] - strengths[low]))


def test_every_labelled_row_is_learned_from(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["the", "of", "Ab", "word", "##", "long-word"]) for _ in range(rng.randint(1, 30)))) for i in range(26_000)]
    labels = [(i, int(len(text) + rng.gauss(0, 40) > 60)) for i, text in docs] + [(5, 1), (30_000, 1), (7, None), (None, 1)]
    d = spark.createDataFrame([*docs, docs[6], (None, "no id")], "doc_id long, text string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality_classifier.learn(d, lab)
    rows = quality_classifier.features(d).join(lab, "doc_id").filter(~quality_classifier.held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").select("quality", "features").collect()
    plain = quality_classifier.fit(np.array([r.features for r in rows]), np.array([r.quality == 1 for r in rows]))
    assert len(rows) > 20_500 and found.weights == pytest.approx(plain.weights, rel=1e-5, abs=1e-7) and found.cut == pytest.approx(plain.cut, rel=1e-6)
    values = [3.0, -1.0, 3.0, 7.5, 1e300, 3.0, -1e-300, 0.0]
    v = spark.createDataFrame([(x,) for x in values], "v double")
    assert [quality_classifier.order_statistic(v, i) for i in range(8)] == sorted(values)


def test_features_leave_other_columns_alone(spark):
    d = spark.createDataFrame([(1, "a b c", 5, 6, 7.5, "xx")], "doc_id long, text string, `measures` int, row int, `a.b` double, lang string")
    out = quality_classifier.classify(d, quality_classifier.Ranking((), 0.0))
    assert out.columns == [*d.columns, "score", "predicted"] and tuple(out.first())[:6] == (1, "a b c", 5, 6, 7.5, "xx")


# 5 WARC


PAGES = "page_id long, url string, html string, record string, archive string"


def test_audit_finds_damage_in_stored_files(spark, tmp_path):
    import gzip

    rows = [(i, f"http://h{i % 3}/{i}", f"<p>é {i}</p>\r\n\r\n<b>", "x", "y") for i in range(300)] + [(400, None, None, None, None), (1, "http://h1/1", "<p>é 1</p>\r\n\r\n<b>", "x", "y"), (500, "u\nv", "long " * 200_000, "x", "y"), (None, "no id", "", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    a, b = str(tmp_path / "a"), tmp_path / "b"
    warc.write(warc.resources(pages), a)
    index = warc.index(spark, a)
    assert index.count() == 303
    back = warc.read(spark, a)
    assert back.filter("url = 'http://h1/1'").first().html == "<p>é 1</p>\r\n\r\n<b>" and back.filter("page_id = 500").first().html == "long " * 200_000 and back.filter("page_id IS NULL").count() == 1
    assert {(r.level, r.status) for r in warc.audit(index, index).collect()} == {("archive", "match")}

    # spoil the files themselves: lose, lengthen, shorten, change, add and swap records
    source = next((tmp_path / "a").rglob("*.gz"))
    data = gzip.decompress(source.read_bytes())
    records = [data[at : at + n] for at, n, _, _ in warc.parsed(data)]
    ids = [f["warc-record-id"].strip("<>") for _, _, f, _ in warc.parsed(data)]
    assert b"".join(records) == data
    longer = records[20][:-4] + b"<!-- -->" + records[20][-4:]
    new = [r for i, r in enumerate(records) if i != 10]
    new[new.index(records[20])] = longer
    new[new.index(records[30])] = records[30][:-7] + records[30][-4:]
    new[new.index(records[40])] = records[40][:-6] + b"?" + records[40][-5:]
    new[new.index(records[60])] = b"garbage" + records[60]
    new.insert(50, b"WARC/1.1\r\nWARC-Type: metadata\r\n folded\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000000>\r\nContent-Length: 3\r\n\r\nnew\r\n\r\n")
    target = b / "archive=0" / "plain.warc"
    target.parent.mkdir(parents=True)
    target.write_bytes(b"".join(new))
    found = {(r.record_id, r.status) for r in warc.audit(index, warc.index(spark, str(b))).collect() if r.level == "record"}
    assert found == {(ids[10], "missing"), (ids[20], "corrupt"), (ids[30], "corrupt"), (ids[40], "corrupt"), (ids[60], "corrupt"), ("urn:uuid:00000000-0000-0000-0000-000000000000", "extra")}

    order = [*records[:70], records[71], records[70], *records[72:]]
    target.write_bytes(b"".join(order))
    moved = [r for r in warc.audit(index, warc.index(spark, str(b))).collect() if r.level != "archive"]
    assert {(r.level, r.status) for r in moved} <= {("range", "reordered")}
    target.write_bytes(gzip.compress(data[:5000]) + gzip.compress(data[5000:])[:-40])
    assert 0 < warc.index(spark, str(b)).count() <= 303
    assert warc.audit(index.limit(0), index.limit(0)).count() == 0 and warc.resources(pages.limit(0)).count() == 0


def test_archives_are_laid_by_one_shuffle_and_spoilt_by_none(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>é {i}</p>", "x", "y") for i in range(20_000)]
    good = warc.resources(spark.createDataFrame(rows + rows[:50], PAGES))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert good.count() == 20_000 and good.select("archive").distinct().count() == 3
    assert plan(warc.laid(good)).count("Exchange ") == 1
    warc.write(good, str(tmp_path / "a"))
    bad = warc.spoilt_files(spark, str(tmp_path / "a"))
    assert plan(warc.laid(bad, True)).count("Exchange ") == 0
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, warc.spoilt(good).collect()))
    warc.write(bad, str(tmp_path / "b"), whole=True)
    assert len(list((tmp_path / "b").rglob("*.gz"))) == 3


def test_spoilt_replicas_are_found_exactly(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>", "x", "y") for i in range(3000)], PAGES)
    good = warc.resources(pages)
    bad = warc.spoilt(good)
    warc.write(good, str(tmp_path / "a"))
    warc.write(bad, str(tmp_path / "b"))
    x, y = {r.key: (r.url, r.html) for r in good.collect()}, {r.key: (r.url, r.html) for r in bad.collect()}
    plain = lambda key: f"urn:uuid:{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:]}"
    want = {(plain(k), "missing") for k in x.keys() - y.keys()} | {(plain(k), "extra") for k in y.keys() - x.keys()} | {(plain(k), "corrupt") for k in x.keys() & y.keys() if x[k] != y[k]}
    got = {(r.record_id, r.status) for r in warc.audit(warc.index(spark, str(tmp_path / "a")), warc.index(spark, str(tmp_path / "b"))).collect() if r.level == "record"}
    assert len(want) > 20 and got == want and len({s for _, s in want}) == 3


# 6 SentencePiece


def test_codec_equals_the_library_and_round_trips(awkward, nothing):
    codec = sentencepiece_codec.Codec(open(sentencepiece_codec.MODEL, "rb").read())
    texts = ["", " ", "  a  b \n", "\x00", "😀 é à́", "a" * 300, "\t\tx\ny", "日本語 テキスト", "((((()))) ####### https://x.y/z?q=1", "    def f(x):\n        return x"]
    words = sorted({w for t in texts for w in codec.marked(t)})
    ids = dict(zip(words, codec.encode_sorted(words)))
    for t in texts:
        mine = [i for w in codec.marked(t) for i in ids[w]]
        assert mine == codec.library.encode(t) and codec.decode(mine) == t
    out = sentencepiece_codec.encode(awkward.withColumn("ids", F.lit("clash")), check=True).collect()
    assert len(out) == awkward.count() and all(r.restored if r.text is not None else r.ids is None for r in out)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(awkward)).filter("text <> decoded").count()
    assert back == 0 and sentencepiece_codec.encode(nothing).count() == 0


def test_unigram_recursion_equals_brute_force():
    codec = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    codec.bpe, codec.pairs, codec.byte = False, {}, list(range(256))
    pieces = {"a": -3.0, "b": -2.5, "ab": -4.0, "ba": -4.2, "aba": -6.0, "bb": -5.5, "abb": -5.0}
    codec.score, codec.ids, codec.longest, codec.worst = pieces, {p: 1000 + i for i, p in enumerate(pieces)}, 3, -20.0

    def best(word):
        found = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            parts.append(word[last:])
            if all(p in pieces for p in parts):
                found.append((sum(pieces[p] for p in parts), [codec.ids[p] for p in parts]))
        return max(found)[1]

    words = sorted("".join(t) for n in range(1, 8) for t in itertools.product("ab", repeat=n))
    scored = {codec.ids[p]: s for p, s in pieces.items()}
    for word, ids in zip(words, codec.encode_sorted(words)):
        assert sum(scored[i] for i in ids) == pytest.approx(sum(scored[i] for i in best(word)))


# 7 mixing


def test_mix_meets_targets_exactly(awkward, nothing, spark):
    out = mixing.mix(mixing.sized(awkward)).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(out) == awkward.count()
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for rows in by.values():
        assert sum(r.taken for r in rows) == round(rows[0].target)
    assert by[None][0].target == 0
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(r.size for r in out))
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(mixing.sized(awkward)).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()), key=str)
    copies = mixing.mixed(awkward)
    assert copies.columns == awkward.columns
    assert copies.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r.taken for r in out)
    assert mixing.mix(mixing.sized(nothing)).count() == 0 and mixing.mixed(nothing).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert (got["b"], got["c"], got[None]) == (3, 30, 0) and got["a"] == pytest.approx(978)


# 8 secrets


def test_secret_spans_and_links(spark, awkward, nothing):
    key = "aB3" * 9
    rows = [
        (1, 'password: token: abcdefghijklmnop'), (2, 'é token = "04dbebab91ab85687d33eeaaf9ac699e"'), (3, "AKIA" + "A" * 13 + " AKIA" + "B" * 14),
        (4, f"login=bob then {key}"), (5, f"{key} alone"), (6, "login=bob alone"), (7, f"login=bob {'.' * 400} {key}"),
        (8, f"see https://h.example/x login=bob {key}"), (9, "API_KEY='x'"), (9, "API_KEY='x'"), (None, f"login=bob {key}"), (10, None),
    ]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("s", secrets.written(F.col("spans"))).collect()
    assert len(out) == len(rows)
    got = collections.defaultdict(set)
    for r in out:
        got[r.doc_id].add(r.s)
    assert got[1] == {""} and got[2] == {"assign:2:43,hex:11:43"} and got[3] == {"access:18:36"}
    assert got[4] == {"ident:0:9,key:15:42"} and got[None] == {"ident:0:9,key:10:37"}
    assert got[5] == got[6] == got[7] == got[9] == got[10] == {""}
    assert got[8] == {"endpoint:4:23,ident:24:33,key:34:61"}
    # the scope counts what lies between two parts, not from start to start
    big = "aB3" * 100
    pair = spark.createDataFrame([(1, f"{big} login=bob"), (2, f"login=bob {big}"), (3, f"{big}{' ' * 256}login=bob"), (4, f"{big}{' ' * 257}login=bob")], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in secrets.scan(pair).collect()} == {1: 2, 2: 2, 3: 2, 4: 0}
    many = spark.createDataFrame([(1, " ".join(["0123456789abcdef"] * 5000))], "doc_id long, text string")
    assert len(secrets.scan(many).first().base) == 5000 and secrets.redact(many).first().text == " ".join(["[SECRET]"] * 5000)
    odd = spark.createDataFrame([(1, f"login=bob {key}", 1, "d")], "doc_id long, text string, `a.b` int, digest string")
    assert tuple(secrets.redact(odd).first()) == (1, "[SECRET] [SECRET]", 1, "d")
    red = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert red[2] == 'é [SECRET]"' and red[8] == "see [SECRET] [SECRET] [SECRET]" and red[10] is None and red[6] == rows[5][1]
    assert secrets.redact(awkward).columns == awkward.columns and secrets.scan(nothing).count() == 0


def test_links_of_credentials_equal_their_sql(spark, tmp_path):
    import duckdb
    from compare import assert_same

    rng = random.Random(18)
    bits = [lambda: f"login=u{rng.randint(0, 99)}", lambda: "aB3" * rng.randint(7, 90), lambda: f"https://h{rng.randint(0, 9)}.example/x", lambda: "AKIA" + "A" * 15, lambda: "password: " + "x" * 14, lambda: "0a" * 20, lambda: "word " * rng.randint(1, 70)]
    rows = [(i, " ".join(rng.choice(bits)() for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = secrets.query(spark, str(tmp_path))
    assert out.filter("spans LIKE '%ident%'").count() > 300 and out.filter("spans LIKE '%endpoint%'").count() > 50
    assert_same(out, con.sql(secrets.SQL))


# 9 chat


def test_chat_messages(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", 'see <tool_call>{"name":"search","id":"c1","arguments":{"query":"x","limit":3}}</tool_call>'),
        (1, 2, "tool", '{"tool_call_id":"c1","content":{"b":1,"a":[2,"é"]}}'), (2, 0, "tool", '{"tool_call_id":"k","content":"early"}'),
        (2, 1, "assistant", '<tool_call>{"id":"k","name":"fetch","arguments":{"url":5}}</tool_call>'), (3, 0, "assistant", "<tool_call>{bad</tool_call>"), (3, 1, "tool", "junk"),
        (4, 0, "assistant", '<tool_call>{"id":"u","name":"search","arguments":{"query":"q"}}</tool_call>'), (None, None, None, None), (5, 0, "user", "twice"), (5, 0, "user", "twice"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.withColumn("message", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 1].message == '{"content":"see","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"c1","name":"search"}]}'
    assert by[1, 2].message == '{"content":{"a":[2,"é"],"b":1},"role":"tool","tool_call_id":"c1"}' and by[1, 2].status == "ok"
    assert (by[2, 0].order_turn, by[2, 0].order_step) > (by[2, 1].order_turn, by[2, 1].order_step) and by[2, 1].status == "invalid_call"
    assert by[3, 0].status == "invalid_call" and by[3, 1].status == "orphan_result" and by[4, 0].status == "unanswered_call"
    # values of the wrong kind, numbers out of bounds, nested values, and whole numbers written with a fraction
    cases = [
        ('{"name":"search","arguments":{"query":"x","limit":1.0}}', 0), ('{"name":"search","arguments":{"query":"x","limit":1.5}}', 1), ('{"name":"search","arguments":{"query":"x","limit":101}}', 1),
        ('{"name":"search","arguments":{"query":"x","order":"date"}}', 0), ('{"name":"search","arguments":{"query":"x","order":"size"}}', 1), ('{"name":"search","arguments":{"query":"x","more":1}}', 1), ('{"name":"search","arguments":{"limit":1}}', 1),
        ('{"name":"calculate","arguments":{"values":[1,2.5]}}', 0), ('{"name":"calculate","arguments":{"values":[]}}', 1), ('{"name":"calculate","arguments":{"values":[1,"x"]}}', 1), ('{"name":"calculate","arguments":{"values":{"a":1}}}', 1),
        ('{"name":"fetch","arguments":{"url":"u","headers":{"accept":"t","b":1}}}', 0), ('{"name":"fetch","arguments":{"url":"u","headers":{}}}', 1), ('{"name":"fetch","arguments":[]}', 1), ('{"name":"search"}', 1), ('{"name":"none","arguments":{}}', 1),
    ]
    calls = spark.createDataFrame([(i, 0, "assistant", "<tool_call>" + c[:-1] + ',"id":"k"}</tool_call>') for i, (c, _) in enumerate(cases)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_invalid for r in chat.format_chats(calls).collect()} == {i: n for i, (_, n) in enumerate(cases)}
    assert by[None, None].message == '{"content":""}' and chat.format_chats(df.limit(0)).count() == 0


def test_chains_of_calls_are_ordered(spark):
    call = lambda i, *after: '<tool_call>{"id":"%s","name":"fetch","arguments":{"url":"u"},"after":[%s]}</tool_call>' % (i, ",".join(f'"{a}"' for a in after))
    result = lambda i: '{"tool_call_id":"%s","content":"%s"}' % (i, "long " * 5000)
    rows = []
    for conv in (1, None):  # logged in the wrong order; e and f wait for each other, g for nothing that is there
        rows += [(conv, 0, "assistant", call("d", "c", "a")), (conv, 1, "assistant", call("c", "b")), (conv, 2, "assistant", call("b", "a")), (conv, 3, "tool", result("d")), (conv, 4, "assistant", call("a")), (conv, 5, "tool", result("a")), (conv, 6, "tool", result("b"))]
        rows += [(conv, 7, "assistant", call("e", "f")), (conv, 8, "assistant", call("f", "e")), (conv, 9, "assistant", call("g", "zz", "g"))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in (1, None):
        order = [r.turn for r in sorted((r for r in out if r.conv_id == conv), key=lambda r: (r.order_turn, r.order_step, r.turn))]
        assert [t for t in order if t < 7] == [4, 5, 2, 6, 1, 0, 3] and [t for t in order if t > 6] == [7, 8, 9]


def test_one_conversation_with_most_turns(spark):
    rows = [(1, i, "user", "hi") for i in range(3000)] + [(1, 5000 + i, "assistant", f'<tool_call>{{"id":"k{i % 700}","name":"fetch","arguments":{{"url":"u"}}}}</tool_call>') for i in range(900)] + [(1, 9000 + i, "tool", f'{{"tool_call_id":"k{i}","content":1.0}}') for i in range(800)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    counts = {r.status: r["count"] for r in out.groupBy("status").count().collect()}
    assert counts == {"ok": 3000 + 900 + 700, "orphan_result": 100} and out.filter("turn = 9000").first().message == '{"content":1,"role":"tool","tool_call_id":"k0"}'


# 10 rules


def test_quality_rules_on_awkward_rows(awkward, nothing):
    out = quality_rules.quality_rules(awkward)
    assert out.count() == awkward.count() and set(awkward.columns) <= set(out.columns)
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert all(by[i].base_failed and not by[i].kept and by[i]["measures"]["n_words"] == 0 for i in (100, 101, 102))
    assert by[103]["measures"]["n_words"] == 20_000 and quality_rules.quality_rules(nothing).count() == 0


def test_repeated_words_cover_windows_once(spark):
    a = [f"a{i}" for i in range(10)]
    text = " ".join(a + ["x"] + a + ["y", "z"])
    got = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["measures"]
    assert got["n_repeat_words"] == 20 and got["n_words"] == 23


def test_other_languages_pass_the_stop_word_rule(spark):
    text = " ".join(f"slovo{i}" for i in range(40))
    d = spark.createDataFrame([(1, text, "pl", 1, 2), (2, text, "en", 1, 2), (3, text, None, 1, 2)], "doc_id long, text string, lang string, words int, `lines` int")
    out = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    assert (out[1].kept, out[2].kept, out[3].kept) == (True, False, False) and (out[1].words, out[1].lines) == (1, 2)
    assert quality_rules.quality_rules(d, stop_words=["slovo1"]).filter("kept").count() == 3
