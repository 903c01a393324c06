"""Substring dedup: repeated passages found as exact blocks, and paragraphs by MinHash banding.

A passage may be pasted anywhere, so every text is cut twice. Blocks of BLOCK words start at anchors,
which the text itself decides: in each stretch of REACH words the one with the least hash of its next
five words (winnowing). Texts that share REACH + BLOCK - 1 = 30 words share a whole block, and as
anchors lie no farther apart than a block is long, the blocks of a shared passage cover it but for
REACH - 1 words at either end. A change breaks five shingles, so a passage of 60 words or more at a
similarity of 0.8 always holds such a run. Equal blocks form classes by an aggregate.

Paragraphs are the lines of at least LINE words, and whole texts of MIN_WORDS words that are shorter.
They are compared by the sets of their 5-word shingles: BANDS bands of one minimum each find a pair of
similarity 0.8 with a chance of 1 - 0.2 ** BANDS = 0.998. Paragraphs that collide are joined and verified
by exact Jaccard similarity. The members of lists of more than CROWD paragraphs are not paired within
them: they are compared by prefixes of their shingle sets, which lose no pair at the similarity.

The components of verified pairs, of equal paragraphs and of equal blocks decide what goes: where one
reaches over two documents or more, all but its first place by document and start. What overlaps or
touches in a text is reported as one span.

Null and empty texts have no passages; repeats within one document alone are left in place; rows
without an id take part under the null id, which counts as no document. Texts are told apart by id and
content, so repeated rows give their spans once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from netledger.llm.common import bounded, jaccard, shingle_set, spread, table
from netledger.llm.simhash import PARITIES, mixed, parities, shingles, similar_links
from netledger.operators.graph import connected_components
from netledger.session import checkpointed, stored

SHINGLE, SIMILARITY = 5, 0.8
BLOCK, REACH = 16, 15
LINE, MIN_WORDS = 20, 8
BANDS = 4
CROWD = 16
#: Keys before a key by which pairs of crowded lists are made once.
HEADS = 8

#: Texts and shingles that a task handles at a time.
SLICE, FLUSH = 256, 1 << 18
_BAND = [f"b{i}" for i in range(BANDS)]


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Positions that hold the least hash of some stretch of REACH positions, or of all if fewer.

    Where equal hashes follow each other within a stretch, the first stands for all of them.
    """
    if len(hashes) <= REACH:
        return np.array([hashes.argmin()])
    stretches = np.lib.stride_tricks.sliding_window_view(hashes, REACH)
    found = np.unique(stretches.argmin(axis=1) + np.arange(len(stretches)))
    kept, last = [], -REACH
    for at, h in zip(found.tolist(), hashes[found].tolist()):
        if at - last >= REACH or h != value:
            kept.append(at)
            last, value = at, h
    return np.array(kept)


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a UTF-8 text, in code points, and the numbers of their lines."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    line = np.concatenate([[0], np.cumsum(raw == 10)])
    return points[edge[::2]], points[edge[1::2]], line[edge[::2]]


def paragraphs_of(lines: np.ndarray) -> list[tuple[int, int]]:
    """Places [a, b) of the words of each paragraph, from the line number of every word."""
    n = len(lines)
    if n < LINE:
        return [(0, n)]
    cuts = [0, *(np.flatnonzero(np.diff(lines)) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a >= LINE]


def block_hash(h: np.ndarray, at: np.ndarray, lane: int) -> np.ndarray:
    """A hash of the BLOCK words at each place, from the shingles that cover them."""
    out = np.full(len(at), lane, np.uint64)
    for step in [*range(0, BLOCK - SHINGLE, SHINGLE), BLOCK - SHINGLE]:
        out = mixed(out ^ h[at + step], lane)
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash); the hash tells apart texts of one id."""
    return docs.select("doc_id", "text", F.hash(F.coalesce("text", F.lit(""))).alias("text_hash"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, d1, d2, n, mask, b0, b1, ...) of every block and paragraph.

    d1 and d2 are 96 bits of a hash of its words in lower case. For paragraphs n is the number of
    different shingles, mask the parity of those that fall on each of 64 bits, and b0, b1, ... the keys
    of the bands; blocks have null there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest, xxh64_intdigest

        def flush(blocks: list, lines: list, sets: list) -> Iterator[pa.RecordBatch]:
            if blocks:
                ids, texts, *rest = zip(*blocks)
                n = [len(x) for x in rest[0]]
                which = np.repeat(np.arange(len(n)), n)
                columns = [np.concatenate(c) for c in rest]
                none = len(which)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, kind).take(pa.array(which)), pa.array(np.array(texts, np.int32)[which]), *[pa.array(c.astype(np.int32)) for c in columns[:2]],
                    pa.array(columns[2].view(np.int64)), pa.array((columns[3] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.nulls(none, pa.int32()), *[pa.nulls(none, pa.int64())] * (1 + BANDS),
                ], names=names)
            if lines:
                ids, texts, starts, ends, digests = zip(*lines)
                n = np.array([len(x) for x in sets])
                at, h = np.cumsum(n) - n, np.concatenate(sets)
                d1, d2 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64), np.array([d & (2**32 - 1) for d in digests], np.uint32).view(np.int32)
                mask = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(h, 77) >> np.uint64(58)), at)
                bands = [mixed(np.minimum.reduceat(mixed(h, 1 + i), at), 101 + i) for i in range(BANDS)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, kind), pa.array(texts, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(d1), pa.array(d2),
                    pa.array(n.astype(np.int32)), *[pa.array(c.view(np.int64)) for c in (mask, *bands)],
                ], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            blocks, lines, sets, held = [], [], [], 0
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, text, content in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                    found = (text or b"").lower().split()
                    if len(found) < MIN_WORDS:
                        continue
                    k = shingles(text, SHINGLE)
                    h = np.fromiter(map(xxh64_intdigest, k, repeat(42)), np.uint64, len(k))
                    starts, ends, line = words_of(text)
                    if len(found) >= BLOCK:
                        where = anchors(h[: len(found) - BLOCK + 1])
                        blocks.append((doc_id, content, starts[where], ends[where + BLOCK - 1], block_hash(h, where, 1), block_hash(h, where, 2)))
                    for a, b in paragraphs_of(line):
                        lines.append((doc_id, content, starts[a], ends[b - 1], xxh3_128_intdigest(b" ".join(found[a:b]))))
                        sets.append(np.unique(h[a : b - SHINGLE + 1]))
                    held += len(k)
                    if held > FLUSH:
                        yield from flush(blocks, lines, sets)
                        blocks, lines, sets, held = [], [], [], 0
            yield from flush(blocks, lines, sets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "start", "end", "d1", "d2", "n", "mask", *_BAND]
    schema = f"doc_id {kind}, text_hash int, start int, end int, d1 long, d2 int, n int, mask long, " + ", ".join(f"{b} long" for b in _BAND)
    return hashed(docs).mapInArrow(run, schema)


def fits(x: str, y: str, similarity: float = SIMILARITY):
    """Whether sizes and parity bits of two sides allow the similarity: every shingle that only one of
    them has changes one bit."""
    size = F.least(f"{x}n", f"{y}n") >= similarity * F.greatest(f"{x}n", f"{y}n") - 1e-6
    return size & (F.bit_count(F.col(f"{x}mask").bitwiseXOR(F.col(f"{y}mask"))) <= (1 - similarity) / (1 + similarity) * (F.col(f"{x}n") + F.col(f"{y}n")) + 1e-6)


def band_lists(paragraphs: DataFrame) -> DataFrame:
    """(d1, n, mask, key, length) of the lists of bands that hold several different paragraphs."""
    postings = paragraphs.select("d1", "n", "mask", F.explode(F.array(*_BAND)).alias("key"))
    several = postings.groupBy("key").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo < hi").select("key")
    shared = stored(postings.join(several, "key").distinct())
    return shared.join(shared.groupBy("key").agg(F.count(F.lit(1)).alias("length")), "key")


def texts_of(docs: DataFrame, paragraphs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text): the text of one place of each wanted paragraph (id)."""
    where = (
        paragraphs.select("d1", "doc_id", "text_hash", "start", "end").join(bounded(checkpointed(wanted.select(F.col("id").alias("d1")))), "d1")
        .groupBy("d1").agg(F.min(F.struct("doc_id", "text_hash", "start", "end")).alias("p")).select("d1", "p.*")
    )
    cut = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    at = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    rows = hashed(docs).alias("d").join(bounded(checkpointed(where)).alias("w"), at)
    return rows.select(F.col("d1").alias("id"), cut.alias("text")).groupBy("id").agg(F.first("text").alias("text"))


def links(docs: DataFrame, paragraphs: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """Verified links (a, b) between the d1 of different paragraphs that share a band."""
    listed = stored(band_lists(paragraphs))
    few, many = listed.filter(F.col("length") <= crowd), listed.filter(F.col("length") > crowd).select(F.col("d1").alias("id")).distinct()
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.d1") < F.col("y.d1")) & fits("x.", "y.", similarity))
    pairs = checkpointed(pairs.select(F.col("x.d1").alias("a"), F.col("y.d1").alias("b")).distinct())
    texts = stored(texts_of(docs, paragraphs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(many).distinct()))
    sets = stored(texts.select("id", shingle_set(F.col("text"), SHINGLE).alias("s")))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    found = both.filter(jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b")
    many = checkpointed(many)
    if many.isEmpty():
        return found
    crowded = texts.join(many, "id", "left_semi")
    return found.union(similar_links(crowded, stored(parities(crowded, SHINGLE)), lambda ids: sets.join(ids, "id", "left_semi"), SHINGLE, similarity, PARITIES, HEADS, stored))


def classes_of(found: DataFrame) -> DataFrame:
    """(d1, d2, first, last): first place and greatest id of each class of equal units; null ids come last."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    return found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max("doc_id").alias("last"))


def repeated_units(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_hash, start, end, keeper_doc_id, keeper_start, kept) of every unit that repeats across documents."""
    cut = stored(units(docs))
    blocks, paragraphs = cut.filter("n IS NULL").select("doc_id", "text_hash", "start", "end", "d1", "d2"), cut.filter("n IS NOT NULL")
    # most blocks stand alone: those that don't are told by 64 bits first, so little else is shuffled with them
    several = blocks.groupBy("d1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("d1")
    common = stored(blocks.join(several.hint("merge"), "d1"))
    equal = classes_of(common).filter(F.col("first.doc_id") < F.col("last")).select("d1", "d2", F.col("first").alias("keeper"))
    found = common.join(equal, ["d1", "d2"])

    joined = connected_components(links(docs, paragraphs, crowd=crowd), "a", "b")
    labelled = checkpointed(
        classes_of(paragraphs).join(bounded(joined), F.col("d1") == F.col("vertex"), "left")
        .filter(F.col("vertex").isNotNull() | (F.col("first.doc_id") < F.col("last")))
        .select("d1", "d2", "first", "last", F.coalesce("component", "d1").alias("component"), F.when(F.col("vertex").isNull(), F.col("d2")).alias("alone"))
    )
    whole = labelled.groupBy("component", "alone").agg(F.min("first").alias("keeper"), F.max("last").alias("most"), F.max("first.doc_id").alias("other"))
    # a component reaches over documents if any of its ids is above the least one
    whole = whole.filter(F.col("keeper.doc_id") < F.greatest("most", "other"))
    near = labelled.alias("l").join(whole.alias("w"), (F.col("l.component") == F.col("w.component")) & F.col("l.alone").eqNullSafe(F.col("w.alone"))).select("d1", "d2", "w.keeper")
    placed = found.unionByName(paragraphs.select("doc_id", "text_hash", "start", "end", "d1", "d2").join(bounded(checkpointed(near)), ["d1", "d2"]))
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("start") == F.col("keeper.start"))
    return placed.select(
        "doc_id", "text_hash", "start", "end", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.start").alias("keeper_start"), F.coalesce(kept, F.lit(False)).alias("kept")
    ).distinct()


def merged_spans(found: DataFrame) -> DataFrame:
    """Units that overlap or touch in a text, and are all kept or all not, as one span with the keeper
    of the first of them. A window holds the units of one text."""
    text = Window.partitionBy("doc_id", "text_hash", "kept").orderBy("start", "end", "keeper_doc_id", "keeper_start")
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(1))
    run = found.withColumn("opens", opens).withColumn("run", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = run.groupBy("doc_id", "text_hash", "kept", "run").agg(
        F.min(F.struct("start", "end", "keeper_doc_id", "keeper_start")).alias("f"), F.max("end").alias("end")
    )
    return spans.select("doc_id", "text_hash", F.col("f.start").alias("start"), "end", F.col("f.keeper_doc_id").alias("keeper_doc_id"), F.col("f.keeper_start").alias("keeper_start"), "kept")


def repeated(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per passage that repeats across documents: (doc_id, start, end, keeper_doc_id, keeper_start,
    kept), places in code points. The keeper is the first of its component by doc_id and start; rows with
    ``kept`` are such first places, all others are to be removed."""
    return merged_spans(repeated_units(docs, crowd)).drop("text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
