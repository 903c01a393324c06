"""SimHash near-dedup through an inverted index of positional bytes.

Fingerprints are computed in tasks, batch by batch. Documents with equal fingerprints form one class
before anything is compared, so copies cost one row of the index. Two fingerprints that differ in at
most RADIUS bits share at least 8 - RADIUS of their 8 positional bytes (byte value and place). Lists of
single bytes would hold a 256th of all fingerprints each, so the index holds conjunctions instead:
the bytes are taken in four pairs, and as two differing bits touch two pairs at most, any linked
fingerprints share one of the six conjunctions of two pairs. Pairs from a list are tallied over all
eight positions, kept at the guaranteed minimum of matches, and verified by their differing bits.

Lists of more than CROWD fingerprints (a family of near copies) are not paired. Their members meet at
the fingerprints one bit away instead: two fingerprints differ in two bits or fewer exactly if such a
meeting point is common to both, and at most 65 fingerprints meet at one point. That loses no link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netledger.llm.common import jaccard, may_hold, named, sieve, shingle_set, spare, spread, table
from netledger.operators.graph import connected_components
from netledger.session import checkpointed, stored

RADIUS = 2
CROWD = 32
SHINGLE = 3

#: Rows and shingles that a task handles at a time.
SLICE, FLUSH = 256, 1 << 18


def shingles(text: bytes | None, k: int) -> list[bytes]:
    """The k-word shingles of a UTF-8 text in lower case, repeats included."""
    found = (text or b"").lower().split()
    if len(found) < k:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*[found[i:] for i in range(k)])))


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """An independent 64-bit hash of a hash; lane 0 is the hash itself."""
    if lane == 0:
        return h
    h = h + np.uint64((lane * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents with the given numbers of hashes, which follow each other.

    Eight counters share a 64-bit word, so a run of up to 255 hashes is counted by word additions.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    at = np.repeat(np.cumsum(n) - n - 255 * first_run, runs) + 255 * np.arange(runs.sum())
    ones = np.uint64(0x0101010101010101)
    lanes = np.empty((len(at), 8), np.uint64)
    for bit in range(8):
        lanes[:, bit] = np.add.reduceat((hashes >> np.uint64(bit)) & ones, at)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(len(at), 64).astype(np.int64), first_run, axis=0)
    bits = (2 * sums > n[:, None]).reshape(len(full), 8, 8).transpose(0, 2, 1)
    out[full] = np.packbits(bits, axis=2, bitorder="little").reshape(len(full), 8).view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", k: int = SHINGLE, lanes: int = 1, distinct: bool = False, parities: int = 0) -> DataFrame:
    """(key, f0, f1, ..., p0, p1, ..., n): SimHash fingerprints of ``lanes`` times 64 bits of the whole texts.

    A bit is set if it is set in over half of the hashes of the shingles (XXH64, seed 42). Texts
    without words, null ones among them, have fingerprint zero. With ``parities`` follow as many times
    64 parity bits, each of the number of shingles whose hash falls on it, and the number of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def flush(held: list, hashes: list, counts: list) -> pa.RecordBatch:
            h = np.fromiter(hashes, np.uint64, len(hashes))
            n = np.array(counts, np.int64)
            columns = [majority(mixed(h, lane), n).view(np.int64) for lane in range(lanes)]
            if parities:
                bits = 64 * parities
                at = np.repeat(np.arange(len(n)) * bits, n) + (mixed(h, 99) % np.uint64(bits)).astype(np.int64)
                odd = (np.bincount(at, minlength=len(n) * bits) & 1).astype(np.uint8).reshape(len(n), bits)
                columns += [*np.ascontiguousarray(np.packbits(odd, axis=1).view(np.int64).T), n]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(held), *map(pa.array, columns)], names=[key, *names])

        for batch in batches:
            held, hashes, counts = [], [], []
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                held.append(part.column(0))
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    found = shingles(text, k)
                    if distinct:
                        found = set(found)
                    hashes.extend(map(xxh64_intdigest, found, repeat(42)))
                    counts.append(len(found))
                if len(hashes) > FLUSH:
                    yield flush(held, hashes, counts)
                    held, hashes, counts = [], [], []
            if held:
                yield flush(held, hashes, counts)

    kind = docs.schema[key].dataType.simpleString()
    names = [f"f{i}" for i in range(lanes)] + ([f"p{i}" for i in range(parities)] + ["n"] if parities else [])
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names)
    return docs.select(key, "text").mapInArrow(run, schema)


def _conjunctions(fp: Column, first: int = 0) -> Column:
    pair = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [
        F.lit((first + n) << 32) + pair[a] * F.lit(65536) + pair[b] for n, (a, b) in enumerate(combinations(range(4), 2))
    ]
    return F.array(*keys)


def shared_bytes(difference: Column) -> Column:
    """Number of equal positional bytes, from the exclusive or of two fingerprints."""
    same = [(F.shiftrightunsigned(difference, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total


def links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the ``rep`` of classes (fp, rep) of distinct fingerprints.

    The edges have the components of all pairs at RADIUS bits or fewer. Within lists of at most
    ``crowd`` fingerprints they are those pairs themselves.
    """
    postings = classes.select("fp", "rep", F.explode(_conjunctions(F.col("fp"))).alias("key"))
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = checkpointed(postings.join(sizes, "key"))
    few = shared.filter(F.col("n") <= crowd)
    difference = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pairs = (
        few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
        .filter(shared_bytes(difference) >= 8 - RADIUS)
        .filter(F.bit_count(difference) <= RADIUS)
        .select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    )
    crowded = shared.filter(F.col("n") > crowd).select("fp", "rep").distinct()
    around = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(v - 2**64 if (v := 1 << i) >= 2**63 else v)) for i in range(64)]]
    meeting = crowded.select("rep", F.explode(F.array(*around)).alias("point"))
    met = meeting.join(meeting.groupBy("point").agg(F.min("rep").alias("b")), "point")
    return pairs.union(met.select(F.col("rep").alias("a"), "b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints at RADIUS bits or fewer, a row's
    own fingerprint included. Repeated rows each appear. Rows without an id belong to the component
    of their fingerprint; it is null where no row of that fingerprint has an id.
    """
    prints = checkpointed(fingerprints(docs).withColumnRenamed("f0", "fp"))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(classes, crowd), "a", "b")
    labelled = checkpointed(
        classes.join(found, F.col("rep") == F.col("vertex"), "left").select(
            "fp", F.coalesce("component", "rep").alias("component_id")
        )
    )
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


#: For whole documents by similarity: shingle words, similarity, and lanes of 64 bits of the
#: fingerprints, by which equal documents form classes.
WORDS, SIMILARITY, LANES = 5, 0.8, 8
#: Lanes of parity bits, which rule out unlike pairs before their texts are read.
PARITIES = 16
#: Lanes of them folded to fewer, which go with the lists.
FOLDS = 4
#: Equal positional bytes of the wide fingerprints, and bits that differ, at which a pair of the index is
#: compared on its texts. At the similarity some 17 of 64 bytes are equal and 78 of 512 bits differ.
LEAST_BYTES, MOST_BITS = 8, 128
#: Lists of more members are first linked to a leader, so that linked pairs needn't be made.
PAIRED = 4
#: Buckets of hashes that are counted, a power of two.
BUCKETS = 1024
#: Lists of a text that go with its later ones, so that pairs of several lists are made in the first.
FIRSTS = 8
#: Frequent shingles: rows of the sample that tells them, rows that hold one, and how many go last.
SAMPLE, HOLD, FREQUENT = 20_000, 3, 200_000


def frequent_shingles(docs: DataFrame, total: int, k: int = WORDS, sample: int = SAMPLE) -> np.ndarray:
    """Hashes of shingles that many texts of a sample of the ``total`` rows (id, text) hold, rarest first.

    They only set the order of shingles, on which no result depends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                hashes = []
                for text in batch.column(0).slice(at, SLICE).cast(pa.binary()).to_pylist():
                    hashes.extend(map(xxh64_intdigest, set(shingles(text, k)), repeat(42)))
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64))], names=["h"])

    some = docs if total <= sample else docs.filter(F.pmod(F.xxhash64("id"), F.lit(total)) < sample)
    counts = some.select("text").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= HOLD)
    rows = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    return np.array([r.h for r in reversed(rows)], np.int64).view(np.uint64)


def prefixes(docs: DataFrame, frequent: np.ndarray, k: int = WORDS, similarity: float = SIMILARITY, heads: int = 0) -> DataFrame:
    """(id, n, key), with ``heads`` also head, of (id, text): the first of a text's n distinct shingles, in an order for all texts.

    Of n shingles, the first n - ceil(similarity * n) + 1 are taken; texts of the similarity share one
    of them in any order. Here ``frequent`` ones come last, others by their hash. ``head`` holds the
    first ``heads`` of the keys before a key.
    """
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def flush(ids: list, sizes: list, keys: list) -> pa.RecordBatch:
            taken = [len(x) for x in keys]
            columns = [np.repeat(np.array(ids, np.int64), taken), np.repeat(np.array(sizes, np.int32), taken), np.concatenate(keys).view(np.int64)]
            arrays = list(map(pa.array, columns))
            if heads:
                before = [np.minimum(np.arange(n), heads) for n in taken]
                ends = np.concatenate([[0], np.cumsum(np.concatenate(before))])
                values = np.concatenate([x[:m] for x, few in zip(keys, before) for m in few])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64))))
            return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "key", "head"][: len(arrays)])

        for batch in batches:
            ids, sizes, keys, held = [], [], [], 0
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    found = set(shingles(text, k))
                    if not found:
                        continue
                    h = np.sort(np.fromiter(map(xxh64_intdigest, found, repeat(42)), np.uint64, len(found)))
                    if len(known):
                        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        late = np.where(known[place] == h, by_hash[place] + 1, 0)
                        h = h[np.argsort(late, kind="stable")]
                    # a little below, so that no rounding shortens a prefix
                    h = h[: len(h) - math.ceil(similarity * len(h) - 1e-6) + 1]
                    ids.append(i)
                    sizes.append(len(found))
                    keys.append(h)
                    held += len(h)
                if held > FLUSH:
                    yield flush(ids, sizes, keys)
                    ids, sizes, keys, held = [], [], [], 0
            if held:
                yield flush(ids, sizes, keys)

    return docs.select("id", "text").mapInArrow(run, "id long, n int, key long" + ", head array<long>" * bool(heads))


def shared_prefixes(postings: DataFrame) -> DataFrame:
    """The postings (id, n, key) whose key several ids have, each once, with the length of its list."""
    w = Window.partitionBy("key")
    told = postings.select("*", F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi"), F.count(F.lit(1)).over(w).alias("length"))
    return told.filter("lo < hi").select(*postings.columns, "length").distinct()


def merged_lists(shared: DataFrame) -> DataFrame:
    """(id, n, key, length): one list of those that hold the same ids. A set of ids is known by its size and
    the exclusive or of 128 bits of each."""
    w = Window.partitionBy("key")
    bits = [F.bit_xor(F.xxhash64(F.lit(i), "id")).over(w).alias(f"s{i}") for i in range(2)]
    told = shared.select("id", "n", "key", F.count(F.lit(1)).over(w).alias("length"), *bits)
    return told.groupBy("s0", "s1", "length", "id").agg(F.min("key").alias("key"), F.first("n").alias("n")).select("id", "n", "key", "length")


def with_firsts(shared: DataFrame, firsts: int = FIRSTS) -> DataFrame:
    """``shared`` with ``head``: the first of the id's lists, ``firsts`` at most, that stand before this one in an
    order for all lists, long ones first. Two ids have no list in both heads where they first meet."""
    w = Window.partitionBy("id").orderBy(F.desc("length"), "key")
    numbered = shared.withColumn("rank", F.row_number().over(w))
    every = F.collect_list(F.when(F.col("rank") <= firsts, F.col("key"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return numbered.withColumn("head", F.slice(every, F.lit(1), F.least(F.col("rank") - 1, F.lit(firsts)))).drop("rank")


def folded(parity: DataFrame, lanes: int = FOLDS) -> DataFrame:
    """(id, q0, ...) of (id, p0, ...): parity bits of fewer and larger sets of hashes."""
    out = []
    for i in range(lanes):
        lane = F.col(f"p{i}")
        for j in range(i + lanes, PARITIES, lanes):
            lane = lane.bitwiseXOR(F.col(f"p{j}"))
        out.append(lane.alias(f"q{i}"))
    return parity.select("id", *out)


def folds_of(shared: DataFrame) -> list[str]:
    """The columns of parity bits that go with lists."""
    return [c for c in shared.columns if c[:1] == "q" and c[1:].isdigit()]


def fits(x: str, y: str, similarity: float, folds: list[str]) -> Column:
    """Whether sizes and folded parity bits of two sides allow the similarity."""
    size = F.least(f"{x}n", f"{y}n") >= similarity * F.greatest(f"{x}n", f"{y}n") - 1e-6
    differ = [F.bit_count(F.col(x + q).bitwiseXOR(F.col(y + q))) for q in folds]
    return size & (sum(differ[1:], differ[0]) <= (1 - similarity) / (1 + similarity) * (F.col(f"{x}n") + F.col(f"{y}n")) + 1e-6)


def led_pairs(shared: DataFrame, similarity: float = SIMILARITY, paired: int = PAIRED) -> DataFrame:
    """Pairs (a, b) of ids: each member of a list of more than ``paired`` with the leader of the list.

    The leader is the member that shares most with all others, as the original of a family does.
    """
    long = shared.filter(F.col("length") > paired)
    score = long.groupBy("id").agg(F.sum("length").alias("score"))
    leader = long.join(score, "id").groupBy("key").agg(F.max(F.struct("score", "id", "n", *folds_of(shared))).alias("l"))
    led = long.join(leader, "key").filter(fits("", "l.", similarity, folds_of(shared)))
    return led.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).filter("a <> b").distinct()


def unlinked_pairs(shared: DataFrame, groups: DataFrame, similarity: float = SIMILARITY, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """All pairs (a, b) of ids that share a list, may have the similarity by ``fits``, and are not in
    one of ``groups`` (vertex, component) together.

    Of two members in different groups one is outside the commonest group of the list, so only those
    are paired with all.
    """
    labelled = shared.join(groups, F.col("id") == F.col("vertex"), "left").select(*shared.columns, F.coalesce("component", "id").alias("label"))
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("m", "label"))["label"].alias("main")).filter("labels > 1").select("key", "main")
    several = keep(labelled.join(main, "key"))
    alike = fits("x.", "y.", similarity, folds_of(shared))
    if "head" in shared.columns:
        alike = alike & ~F.arrays_overlap("x.head", "y.head")
    met = several.filter("label <> main").alias("x").join(several.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & alike)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def possible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (a, b) whose parity bits (id, p0, ..., n) don't show that they lack the similarity.

    Bits that differ are at most as many as shingles that aren't common, so no similar pair goes.
    """
    sides = [nodes.select(F.col("id").alias(i), F.col("n").alias(f"{i}n"), *[F.col(f"p{j}").alias(f"{i}{j}") for j in range(PARITIES)]) for i in ("a", "b")]
    differ = [F.bit_count(F.col(f"a{j}").bitwiseXOR(F.col(f"b{j}"))) for j in range(PARITIES)]
    most = (1 - similarity) / (1 + similarity) * (F.col("an") + F.col("bn")) + 1e-6
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(sum(differ[1:], differ[0]) <= most).select("a", "b")


def indexed_pairs(prints: DataFrame, least: int = LEAST_BYTES, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of (id, f0, f1, ...) by the inverted index of positional bytes of all lanes.

    Lists are kept per lane and conjunction of four bytes. Each member of a list meets its least id, so a
    family of copies costs a row per list and member. Pairs are tallied over all positional bytes, kept at
    ``least`` equal ones, and verified by their differing bits, ``most`` at most.
    """
    lanes = [c for c in prints.columns if c[:1] == "f" and c[1:].isdigit()]
    keys = [_conjunctions(F.col(c), 6 * i) for i, c in enumerate(lanes)]
    w = Window.partitionBy("key")
    postings = prints.select("id", F.explode(F.flatten(F.array(*keys))).alias("key"))
    met = postings.select(F.min("id").over(w).alias("a"), F.col("id").alias("b")).filter("a < b").distinct()
    sides = [prints.select(F.col("id").alias(x), *[F.col(c).alias(x + c) for c in lanes]) for x in ("a", "b")]
    differ = [F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}")) for c in lanes]
    tally, bits = [shared_bytes(d) for d in differ], [F.bit_count(d) for d in differ]
    tallied = met.join(sides[0], "a").join(sides[1], "b").filter(sum(tally[1:], tally[0]) >= least)
    return tallied.filter(sum(bits[1:], bits[0]) <= most).select("a", "b")


def parities(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """(id, p0, ..., n) of (id, text): parity bits and numbers of the distinct shingles."""
    return fingerprints(texts, "id", k, 0, True, PARITIES)


def counted_pairs(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (a, b) whose numbers of hashes by bucket, of the sets (id, s), don't show that they lack the similarity.

    The numbers differ by as many as hashes that aren't common at most, so no similar pair goes. For long texts
    this tells more than parity bits, and spares shuffling their sets beside each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.bincount(x.values.to_numpy() & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32) for x in batch.column(1)]
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], names=["id", "c"])

    counts = stored(sets.select("id", "s").mapInArrow(run, "id long, c array<int>").select("id", "c", F.aggregate("c", F.lit(0), lambda x, y: x + y).alias("m")))
    sides = [counts.select(F.col("id").alias(x), F.col("c").alias(f"{x}c"), F.col("m").alias(f"{x}m")) for x in ("a", "b")]
    differ = F.aggregate(F.zip_with("ac", "bc", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    most = (1 - similarity) / (1 + similarity) * (F.col("am") + F.col("bm")) + 1e-6
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(differ <= most).select("a", "b")


def similar_links(each: DataFrame, parity: DataFrame, sets: Callable[[DataFrame], DataFrame], k: int = WORDS, similarity: float = SIMILARITY, lanes: int = FOLDS, heads: int = 0, keep: Callable[[DataFrame], DataFrame] = checkpointed, total: int | None = None, prints: DataFrame | None = None, firsts: int = 0) -> DataFrame:
    """Links (a, b) between texts (id, text) with the components of all pairs at the similarity.

    Texts that share a shingle of their prefixes are compared unless they are linked already, so no
    pair at the similarity is lost. ``sets`` gives (id, s), their shingle sets, of a table of some ids. For
    families of many texts that are nearly similar, more ``lanes`` of parity bits go with the lists, and
    ``heads`` keys before each, by which a pair is made in the first list that both are in only. ``keep``
    materialises the lists, and ``total`` is the number of texts, if known. With ``prints`` (id, f0, ...), wide
    fingerprints, what their index finds is linked first. With ``firsts`` lists of the same texts are merged, and
    each row holds so many lists before it, to the same end as ``heads``.
    """
    keys = prefixes(each, frequent_shingles(each, each.count() if total is None else total, k), k, similarity, heads)
    shared = merged_lists(shared_prefixes(keys)) if firsts else shared_prefixes(keys)
    shared = shared.join(folded(parity, lanes), "id")
    shared = keep(with_firsts(shared, firsts) if firsts else shared)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(possible_pairs(pairs, parity, similarity))
        needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        mine = sets(needed)
        if firsts:
            pairs = checkpointed(counted_pairs(pairs, mine, similarity))
        both = pairs.join(mine.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(mine.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return checkpointed(both.filter(jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b"))

    led = led_pairs(shared, similarity)
    first = linked(led if prints is None else indexed_pairs(prints).union(led).distinct())
    return first.union(linked(unlinked_pairs(shared, connected_components(first, "a", "b"), similarity, keep)))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without all but one document of each group.

    Documents are linked at a Jaccard similarity of ``similarity`` or more of their k-word shingles
    in lower case. Equal documents form classes by wide SimHash fingerprints. Classes that meet in the
    inverted index of the positional bytes of these, and pass its tally and the count of differing bits, are
    compared on their texts; so are classes that share a shingle of their prefixes unless they are linked
    already, so no pair at the similarity is lost. Of a group the row of the least doc_id stays, a null id before others;
    of repeated rows one stays. Texts without words, null ones among them, form one group. Other
    columns are untouched.
    """
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = spare("digest", columns)
    node = F.struct("doc_id", F.col(mark).alias("digest"))
    marked = docs.withColumn(mark, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
    prints = [f"f{i}" for i in range(LANES)]
    found = checkpointed(fingerprints(marked.select(node.alias("node"), "text"), "node", k, LANES, True, PARITIES))
    bits = ["n", *(f"p{i}" for i in range(PARITIES))]
    classes = checkpointed(found.groupBy(*prints).agg(F.min(F.struct("node", *bits)).alias("c")).select(*prints, "c.*"))
    parity = classes.select(F.xxhash64("node").alias("id"), *bits)
    wide = classes.select(F.xxhash64("node").alias("id"), *prints).filter("n > 0")
    nodes = classes.select(F.xxhash64("node").alias("id"), "node")
    here = F.struct(F.col("m.doc_id").alias("doc_id"), F.col(f"m.{mark}").alias("digest"))

    # texts of one document of each class: those of the others, which are fewer, meet what tells them
    copies = checkpointed(found.select("node").distinct().join(classes.select("node"), "node", "left_anti"))
    sifting = sieve(copies, F.col("node"))
    some = may_hold(marked.select("doc_id", "text", mark), sifting, node).alias("m").join(copies.alias("n"), here == F.col("n.node"), "left_anti")
    each = may_hold(marked.select("doc_id", "text", mark), sifting, node, there=False).unionByName(some).select(F.xxhash64(node).alias("id"), "text")

    def sets(ids: DataFrame) -> DataFrame:
        """(id, s): the shingle sets of some texts; sets, not texts, are shuffled."""
        ids = checkpointed(ids)
        able = may_hold(marked.select(F.xxhash64(node).alias("id"), "text"), sieve(ids, F.col("id")), F.col("id"))
        return stored(able.select("id", shingle_set(F.col("text"), k).alias("s")).join(ids, "id").groupBy("id").agg(F.first("s").alias("s")))

    links = similar_links(each, parity, sets, k, similarity, total=nodes.count(), prints=wide, firsts=FIRSTS)
    groups = connected_components(links, "a", "b").join(nodes, F.col("vertex") == F.col("id")).select("id", "component", "node")
    least = groups.groupBy("component").agg(F.min("node").alias("stays"))
    joined = checkpointed(groups.join(least, "component").select("node", "stays"))
    labelled = checkpointed(classes.join(joined, "node", "left").select(*prints, F.coalesce("stays", "node").alias("stays")))
    # rows that go, and rows that are there several times over; all others stay where they are
    gone = checkpointed(found.join(labelled, prints).filter("node <> stays").select("node").distinct())
    many = found.groupBy("node").count().filter("count > 1").select("node")
    sifting = sieve(gone.union(many), F.col("node"))
    some = may_hold(marked, sifting, node).alias("m").join(gone.alias("n"), here == F.col("n.node"), "left_anti").dropDuplicates(["doc_id", mark])
    return may_hold(marked, sifting, node, there=False).unionByName(some).select(*map(named, columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
