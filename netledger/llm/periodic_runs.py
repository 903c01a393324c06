"""Periodic runs of words: stretches that repeat one block of words at least three times.

A stretch has period q if words q apart are equal. Per text, matches are counted for every lag up to a
third of its length before any stretch is looked for: words that are frequent there (heavy) add the
autocorrelation of their places, by FFT of 0/1 vectors, whose sums are whole numbers below 2 ** 53 and
round exactly; of the others (light) all differences of places are counted. A run of period q holds
``max(least - q, (powers - 1) * q)`` matches in a row at lag q, so lags with fewer matches hold none, and
only the others get an island scan. The scan looks at every h-th match first, where h is half of what is
needed, and reads the whole lag only if h matches follow one of them.

Lags go up. A run of period q is an island at every multiple of q, and just that; its matches are taken off
the counts there, so that a text of one word is scanned at lag 1 alone.

One text is the unit of work. Its cost is bounded by n ** 1.5 log n for the counts and by the matches
looked at; memory is a few arrays of its length. Nothing shuffles, so hot sources and groups of copies
don't matter. Null and blank texts have no words and no runs; a text shorter than ``least`` words has no
runs. Rows come out as often as they come in. Columns ``n_words``, ``runs`` and ``collapsed`` are added; of
columns of the same names the new ones win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from netledger.llm.common import named, spare, spread, table, words

#: Least words of a run, and least periods.
LEAST, POWERS = 24, 3
#: Pairs of places that cost as much as one element of an FFT per halving.
PAIRS_PER_STEP = 2
#: Differences that are gathered before they are counted.
FLUSH = 1 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """At q, how many i have ids[i] == ids[i + q], for q from 0 (left at 0) to ``most``."""
    counts = np.zeros(most + 1, np.int64)
    often = np.bincount(ids)
    width = 1 << (len(ids) + most).bit_length()
    heavy = often * (often - 1) // 2 > PAIRS_PER_STEP * width * width.bit_length()
    if heavy.any():
        power = np.zeros(width // 2 + 1)
        for word in np.flatnonzero(heavy):
            wave = np.fft.rfft(ids == word, width)
            power += wave.real**2 + wave.imag**2
        counts[1:] = np.rint(np.fft.irfft(power, width)[1 : most + 1])
    order = np.argsort(ids, kind="stable")
    order = order[~heavy[ids[order]] & (often[ids[order]] > 1)]
    group = ids[order]
    # the k-th next place of the same word; once there is none, or it is too far, later ones are no nearer
    left, k, held, n = np.arange(len(order)), 1, [], 0
    while len(left):
        left = left[: np.searchsorted(left, len(order) - k)]
        gap = order[left + k] - order[left]
        near = (group[left + k] == group[left]) & (gap <= most)
        left, k = left[near], k + 1
        held.append(gap[near])
        n += len(left)
        if n > FLUSH or not len(left):
            counts += np.bincount(np.concatenate(held), minlength=most + 1)
            held, n = [], 0
    return counts


def islands(ids: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """[start, end) of all maximal stretches of ``need`` or more matches at ``lag``."""
    half = (need + 1) // 2
    at, seen = np.arange(0, len(ids) - lag - half + 1, half), 0
    while seen < half and len(at):
        more = np.arange(seen, min(half, 2 * seen + 1))
        places = at[:, None] + more
        at, seen = at[(ids[places] == ids[places + lag]).all(axis=1)], int(more[-1]) + 1
    if not len(at):
        return []
    same = np.concatenate([[False], ids[:-lag] == ids[lag:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    return [tuple(e) for e in edges[edges[:, 1] - edges[:, 0] >= need].tolist()]


def runs_of(ids: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. ``ids`` numbers the words from 0."""
    n = len(ids)
    most = n // powers
    if n < least or not most:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(np.maximum(least - lags, (powers - 1) * lags), 1)
    left = lag_counts(ids, most)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(left >= need).tolist():
        if left[q] < need[q]:
            continue  # what remained were islands of shorter periods
        for start, end in islands(ids, q, int(need[q])):
            length = end - start + q
            if (start, length) not in found:
                found[start, length] = q
                multiples = np.arange(2 * q, min(most, length - 1) + 1, q)
                left[multiples] -= length - multiples
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds beyond its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start and period) and collapsed, the text with
    one period left of each run, its words joined by one space."""
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    source = spare("text_of_runs", kept)
    rows = docs.select(*[named(c) for c in kept], F.coalesce(named(text), F.lit("")).alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, collapsed = [], [], []
            for value in batch.column(len(kept)):
                tokens = value.as_py().encode().split()  # bytes split at x20 and x09 to x0D alone
                number = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
                ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                found = runs_of(ids, least, powers)
                if found:
                    tokens = [tokens[i] for i in np.flatnonzero(kept_words(len(tokens), found)).tolist()]
                n.append(len(ids))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(b" ".join(tokens).decode())
            extra = [pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *extra], names=[*kept, "n_words", "runs", "collapsed"])

    fields = [*rows.schema.fields[: len(kept)], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))


_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def drilled(docs: DataFrame) -> DataFrame:
    """(doc_id, text): words joined by one space, where every document whose crc32 of the id ends in 0 repeats
    a block of its own words from some word on to its end. A document without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", words(F.col("text")).alias("w"), h.alias("h")).withColumn("n", F.size("w").cast("long"))
    g = F.floor(F.col("h") / 10)
    a = g % F.col("n")
    rows = rows.select("doc_id", "w", "n", "h", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), a).alias("a"), g.alias("g"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")
    repeated = F.transform("w", lambda _, i: F.get("w", place(i)))
    return rows.select("doc_id", F.array_join(F.when(F.col("a").isNull(), F.col("w")).otherwise(repeated), " ").alias("text"))


def longest_by_period(runs: Column) -> Column:
    """The first of the runs (in their order) with the greatest exact length / period; null if there is none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(drilled(spread(table(spark, sf_dir, "documents"))))
    line = lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = longest_by_period(F.col("runs"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def _byte(c: str) -> str:
    """SQL of crc32's register after eight bits, from a list of the register with a byte mixed in."""
    for _ in range(8):
        c = f"[xor(x >> 1, 3988292384 * (x & 1)) FOR x IN {c}]"
    return c


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda s, b: ({_byte("[xor(s, b)]")})[1]), 4294967295) AS h FROM documents
), g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
t AS (SELECT r, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE [w[(CASE WHEN x >= a THEN a + (x - a) % p ELSE x END)::BIGINT + 1] FOR x IN range(n)] END) AS w FROM p),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM t AS x JOIN t AS y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // {POWERS}),
lag AS (SELECT r, q FROM m GROUP BY ALL HAVING count(*) >= greatest({LEAST} - q, {POWERS - 1} * q)),
i AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m JOIN lag USING (r, q)),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM i GROUP BY r, q, island HAVING count(*) >= greatest({LEAST} - q, {POWERS - 1} * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY ALL),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length // period DESC, (length % period)::DOUBLE / period DESC, start, period) = 1
), listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.r = d.r LEFT JOIN listed ON listed.r = d.r LEFT JOIN kept ON kept.r = d.r"""
