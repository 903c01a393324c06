"""Quality classifier by Bradley-Terry ranking.

A document's strength is linear in features of its text. Preference pairs put a good document against
a bad one; the chance that the good one wins is the logistic function of the difference of their
strengths, so the weights come from a logistic loss on feature differences. The cut between kept and
rejected is a quantile of the strengths of the labelled rows: the share of bad ones among them.

Learning sees every labelled row that is not held out: each of the larger kind meets OPPONENTS of the
other, spread evenly over it, and so does all of the other. The pairs are a table; a step of Newton's
method is one pass over it, of which tasks return sums. The quantile is found by counts in bins. All
features are column expressions over one row; scoring is one projection over the whole table. Null and empty texts have zero features and get a score like any other. Without
labels of both kinds every document scores 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netledger.llm import quality_rules
from netledger.llm.common import named, table, words
from netledger.session import stored

#: Opponents of each row, and the strength of the ridge.
OPPONENTS, RIDGE = 16, 1e-3
#: Steps of Newton's method at most, and bins of a round of counts.
STEPS, BINS = 25, 1024
#: Score of a document at the cut.
CUT = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (.., text) with the array column ``features`` of the whole text, which replaces one of that
    name. Only the text counts."""
    distinct, whole = "distinct", "row"
    m = docs.select(F.struct(*[named(c) for c in docs.columns]).alias(whole), "text").withColumn(distinct, F.size(F.array_distinct(words(F.col("text")))))
    m = quality_rules.measured(m)
    measure, d = F.col(quality_rules.MEASURES), F.col(distinct)
    n = F.greatest(measure["n_words"], F.lit(1)).cast("double")
    ratio = quality_rules.measures()
    root = lambda c: F.sqrt(c)  # noqa: E731  spreads small shares
    x = [
        F.log1p(measure["n_words"].cast("double")),
        F.least(F.log1p(measure["n_words"].cast("double")), F.lit(4.0)),
        F.least(ratio["mean_word_chars"], F.lit(12.0)),
        root(F.least(ratio["symbols_per_word"], F.lit(3.0))),
        root(F.least(ratio["upper_ratio"], F.lit(1.0))),
        F.greatest(ratio["upper_ratio"] - 0.3, F.lit(0.0)),
        root(ratio["stop_word_ratio"]),
        F.least(ratio["stop_word_ratio"], F.lit(0.12)),
        ratio["dup_line_ratio"],
        F.least(measure["n_repeat_words"] / n, F.lit(1.0)),
        # a text of n random words has about n ** 0.9 distinct ones; what falls short is repetition
        F.least(d / F.pow(n, 0.9), F.lit(1.2)),
        F.least(d / n, F.lit(0.5)),
        F.least(measure["n_lines"] / n, F.lit(0.5)),
    ]
    others = [F.col(whole).getField(c).alias(c) for c in docs.columns if c != "features"]
    return m.select(*others, F.array(*[c.cast("double") for c in x]).alias("features"))


@dataclass(frozen=True)
class Ranking:
    """Learned weights; ``cut`` is the strength at which the score is CUT."""

    weights: tuple[float, ...]
    cut: float

    def score(self, x: Column) -> Column:
        if not self.weights:
            return F.lit(0.5)
        strength = F.lit(-self.cut)
        for i, w in enumerate(self.weights):
            strength = strength + F.lit(w) * F.get(x, F.lit(i))
        return 1 / (1 + F.exp(-strength - float(np.log(CUT / (1 - CUT)))))


def _sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of differences, and their gradient and Hessian of the logistic loss, in one row."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return np.concatenate([[len(d)], -(d.T @ p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Weights of least loss, from ``sums`` over all differences at given weights."""
    w = np.zeros(width)
    for _ in range(STEPS):
        found = sums(w)
        gradient = RIDGE * w + found[1 : width + 1] / found[0]
        hessian = found[width + 1 :].reshape(width, width) / found[0] + RIDGE * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray) -> Ranking:
    """Ranking from features and labels of rows at hand, in a fixed order; ``rank`` does the same for tables."""
    wins, losses = x[good], x[~good]
    if not len(wins) or not len(losses):
        return Ranking((), 0.0)
    scale = np.maximum(x.std(axis=0), 1e-6)
    # each side meets OPPONENTS rows of the other, spread evenly over it
    n = max(len(wins), len(losses))
    i = np.repeat(np.arange(n), OPPONENTS)
    j = (np.arange(n)[:, None] + np.arange(OPPONENTS) * max(1, min(len(wins), len(losses)) // OPPONENTS)).ravel()
    a, b = (i, j) if n == len(wins) else (j, i)
    d = (wins[a % len(wins)] - losses[b % len(losses)]) / scale
    w = _newton(lambda w: _sums(d, w), x.shape[1]) / scale
    return Ranking(tuple(map(float, w)), float(np.quantile(x @ w, (~good).mean())))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, good, features) with ``at``, the number of a row within its kind in an order by hash.

    Rows are numbered within 4,096 ranges of hashes, after the numbers of rows in the ranges before.
    """
    ranges = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("r", F.shiftright("h", 52))
    before = Window.partitionBy("good").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("good", "r").count().select("good", "r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("good", "r").orderBy("h", "doc_id", "features"))
    return ranges.withColumn("own", own).join(F.broadcast(sizes), ["good", "r"]).select("good", "features", (F.col("before") + F.col("own") - 1).alias("at"))  # at most 8,192 sizes


def pairs(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """(d): features of a good row less those of a bad one, for all pairs of ``numbered`` rows that meet."""
    few, more_good = min(n_good, n_bad), n_good >= n_bad
    j = (F.col("at") + F.col("k") * max(1, few // OPPONENTS)) % few
    more = rows.filter(F.col("good") == more_good).select("at", F.col("features").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(OPPONENTS - 1))).alias("k")).select("x", j.alias("at"))
    met = more.join(rows.filter(F.col("good") != more_good).select("at", F.col("features").alias("y")), "at")
    return met.select(F.zip_with("x", "y", lambda x, y: x - y if more_good else y - x).alias("d"))


def order_statistic(values: DataFrame, at: int) -> float:
    """The value (v) at place ``at``, from 0, by counts in ever narrower bins."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        part = F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1))
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        for _, n, low, high in inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)), F.min("v"), F.max("v")).orderBy("part").collect():  # noqa: B007  BINS rows at most
            if at < n:
                break
            at -= n
    return low


def rank(featured: DataFrame, labels: DataFrame) -> Ranking:
    """Ranking from all labelled rows of (doc_id, features) that are not held out."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("quality").cast("int") == 1).alias("good"))
    rows = stored(featured.select("doc_id", "features").join(chosen, "doc_id"))
    sizes = {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(sizes) < 2:
        return Ranking((), 0.0)
    width = len(rows.select("features").first().features)
    scale = np.maximum(np.array(rows.agg(*[F.stddev_pop(F.get("features", F.lit(i))) for i in range(width)]).first()), 1e-6)
    met = stored(pairs(stored(numbered(rows)), sizes[True], sizes[False]))

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(1 + width + width * width)
            for batch in batches:
                out += _sums(batch.column(0).flatten().to_numpy().reshape(-1, width) / scale, w)
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["s"])

        return np.sum([r.s for r in met.mapInArrow(run, "s array<double>").collect()], axis=0)  # one row of a task

    # rounded, so that the order of sums doesn't show
    w = [float(f"{v:.9g}") for v in _newton(sums, width) / scale]
    strength = sum((F.lit(v) * F.get("features", F.lit(i)) for i, v in enumerate(w)), F.lit(0.0))
    values = rows.select(strength.alias("v"))
    place = sizes[False] / (sizes[True] + sizes[False]) * (sizes[True] + sizes[False] - 1)
    low = order_statistic(values, int(place))
    high = order_statistic(values, min(int(place) + 1, sizes[True] + sizes[False] - 1))
    return Ranking(tuple(w), low + (place - int(place)) * (high - low))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Ranking from all labelled rows of (doc_id, text) that are not held out."""
    return rank(features(docs.select("doc_id", "text")), labels)


def scored(featured: DataFrame, ranking: Ranking) -> DataFrame:
    """``featured`` with ``score`` and ``predicted`` instead of ``features``."""
    return featured.withColumn("score", ranking.score(F.col("features"))).withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop("features")


def classify(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names, and one named features, are replaced."""
    return scored(features(docs), ranking)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = stored(features(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "features"))
    out = scored(featured, rank(featured, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
