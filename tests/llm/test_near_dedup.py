"""Near-dedup of whole documents against brute force over all pairs."""

import itertools
import random

from pyspark.sql import functions as F

from netledger.llm import simhash


def edited(rng, words, n):
    """``words`` with n words changed, each in five 5-word shingles of its own."""
    out = list(words)
    for at in rng.sample(range(1, len(words) // 5 - 1), n):
        out[5 * at] = f"n{rng.getrandbits(60)}"
    return out


def sets(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def kept(texts, similarity=0.8):
    """Least index of each group of texts linked by brute force."""
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = [sets(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(every[i] & every[j])
        if common >= similarity * (len(every[i]) + len(every[j]) - common):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {find(i) for i in range(len(texts))}


def left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}


def test_a_star_of_thousands_of_copies_leaves_one(spark):
    # each copy is at 90/110 of the original, two copies mostly at 80/120 of each other
    rng = random.Random(3)
    original = [f"w{rng.getrandbits(60)}" for _ in range(104)]
    texts = [" ".join(edited(rng, original, 2)) for _ in range(3000)]
    texts.insert(1500, " ".join(original))
    assert left(spark, texts) == {0}


def test_pairs_at_the_threshold_are_all_found(spark):
    # one change in 50 to 70 words: 0.80 to 0.86
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        words = [f"w{rng.getrandbits(60)}" for _ in range(rng.randint(49, 70))]
        texts += [" ".join(words), " ".join(edited(rng, words, 1))]
    want = kept(texts)
    assert 150 <= len(want) < 170 and left(spark, texts) == want


def test_mixed_lists_equal_brute_force(spark):
    # families of copies of copies that all share a passage, so lists hold many unlike texts
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for _ in range(12):
        family = [passage + [f"w{rng.getrandbits(60)}" for _ in range(70)]]
        for _ in range(24):
            family.append(edited(rng, rng.choice(family), rng.randint(1, 3)))
        texts += [" ".join(f) for f in family]
    texts += ["", "one", "one two", "One two", " ".join(passage)]
    rng.shuffle(texts)
    want = kept(texts)
    assert 20 < len(want) < 250 and left(spark, texts) == want


def test_the_index_of_fingerprints_links_near_copies(spark, monkeypatch):
    # without prefix lists, what is found is the work of the positional bytes
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = [f"w{rng.getrandbits(60)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(edited(rng, words, 1)), " ".join(edited(rng, words, 1))]
    texts += [" ".join(f"w{rng.getrandbits(60)}" for _ in range(100)) for _ in range(30)]
    none = lambda shared, *_: shared.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    monkeypatch.setattr(simhash, "led_pairs", none)
    monkeypatch.setattr(simhash, "unlinked_pairs", none)
    assert left(spark, texts) == kept(texts) and len(kept(texts)) == 70


def test_pairs_of_many_lists_are_made_in_few(spark, monkeypatch):
    # 60 unlike texts share a passage, and 40 pairs one of their own: many lists of the same texts
    rng = random.Random(8)
    new = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    passage, texts = new(60), []
    texts += [" ".join(passage + new(40)) for _ in range(60)]
    for _ in range(40):
        own = new(80)
        texts += [" ".join(own + new(20)), " ".join(own + new(30))]
    lists = []
    real = simhash.unlinked_pairs
    monkeypatch.setattr(simhash, "unlinked_pairs", lambda shared, *a: lists.append(shared) or real(shared, *a))
    assert left(spark, texts) == kept(texts)
    (shared,) = lists
    x, y = shared.alias("x"), shared.alias("y")
    rows = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & ~F.arrays_overlap("x.head", "y.head")).select("x.id", F.col("y.id").alias("other"))
    every = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select("x.id", F.col("y.id").alias("other"))
    assert rows.distinct().count() == every.distinct().count() >= 40 and rows.count() < 1.1 * every.distinct().count()


def test_counts_by_bucket_part_long_texts_and_lose_no_similar_ones(spark):
    rng = random.Random(10)
    draw = lambda n: rng.sample(range(-(2**31), 2**31), n)
    one = draw(9000)
    found = {0: one, 1: one[:8000] + draw(1000), 2: draw(9000), 3: [], 4: one[:4500] + draw(4500), 5: [-1], 6: [-1], 7: [-(2**31)]}
    sets = spark.createDataFrame(list(found.items()), "id long, s array<int>")
    pairs = spark.createDataFrame(list(itertools.combinations(found, 2)), "a long, b long")
    want = {(a, b) for a, b in itertools.combinations(found, 2) if len(set(found[a]) & set(found[b])) >= 0.8 * len(set(found[a]) | set(found[b]))}
    got = {(r.a, r.b) for r in simhash.counted_pairs(pairs, sets).collect()}
    assert want == {(0, 1), (5, 6)} and got >= want and not got & {(0, 2), (1, 2), (0, 3), (5, 7)}


def test_a_sieve_parts_rows_and_loses_none(spark):
    from pyspark.sql import functions as F

    from netledger.llm.common import may_hold, sieve

    keys = spark.range(0, 50_000, 2).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    rows = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    bits = sieve(keys, F.col("k"))
    there, gone = may_hold(rows, bits, F.col("k")), may_hold(rows, bits, F.col("k"), there=False)
    assert there.count() + gone.count() == 100_000 and there.join(keys, there["k"].eqNullSafe(keys["k"]), "left_semi").count() == 25_000
    assert there.count() < 26_000 and may_hold(rows, sieve(keys.limit(0), F.col("k")), F.col("k")).count() == 0


def test_mixed_rows_hold_the_words_that_the_mix_takes(spark):
    from pyspark.sql import functions as F

    from netledger.llm import mixing

    rows = [(1, "one two three", "a")] * 40 + [(i, "w " * (i % 5), None if i % 3 else "b") for i in range(200)] + [(None, "x y", "c")] * 7 + [(500, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1, 2, 3), (7, 1), (1, 100)):
        slim = mixing.sized(docs).select("doc_id", "source", "size", "digest")
        taken = {r.source: r.n for r in mixing.mix(slim, weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        out = {r.source: r.n for r in mixing.mixed(docs, weights).groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
        assert {k: out.get(k, 0) for k in taken} == taken
        by_doc = {r.doc_id: r.n for r in mixing.mix(slim, weights).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
        assert {r.doc_id: r.n for r in mixing.mixed(docs, weights).groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()} == {k: v for k, v in by_doc.items() if v}
    assert mixing.mixed(docs.limit(0)).count() == 0
