"""Rule-based quality filter: a threshold table compiled into one Spark projection.

Every measure is a built-in column expression over one row, so the filter is a map without a
shuffle: a hot source or a group of copies costs what its rows cost. Null and blank texts have no
words and fail the length rule; documents without lines or words have ratios of zero. The stop-word
rule passes documents whose column ``lang`` names a language that the word list doesn't cover; without
that column, or where it is null, all are held to the list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netledger.llm.common import SPACE, let, spare, table, words

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at this have from or by not but what all were when "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an aus er hat dass "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur se ne ce il sont avec "
    "el los del las una con no su para al lo como o pero sus ha si"
).split()

#: The languages of those words.
LANGUAGES = ("en", "de", "fr", "es")

#: The column of all measures.
MEASURES = "measures"

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Reject where ``measure`` lies outside [least, most]."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules; whoever fails one is rejected whatever the table says.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: The threshold table of the method.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbols_per_word", most=0.25),
    Rule("upper_ratio", most=0.6),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
)


def _repeat_words(tokens: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def twice(ordered: Column) -> Column:
            return F.filter(
                ordered,
                lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
            )

        def total(starts: Column) -> Column:
            gaps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        starts = let(F.sort_array(numbered), lambda o: F.sort_array(F.transform(twice(o), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(starts, total)).otherwise(F.lit(0).cast("long"))

    def windows(hashed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashed, i, WINDOW))
        )

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) > WINDOW, let(let(hashed, windows), covered)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, stop_words: list[str] | tuple[str, ...] = STOP_WORDS, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` with the struct column ``measures``; other columns stay as they are, but one of that name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    w, l = spare("words", docs.columns), spare("lines", docs.columns)
    first = docs.withColumn(w, words(F.col("text"))).withColumn(l, lines)
    stops = sorted({form for word in stop_words for form in (word, word.capitalize())})
    foreign = F.coalesce(~F.col("lang").isin(*languages), F.lit(False)) if "lang" in docs.columns else F.lit(False)
    return first.withColumn(
        MEASURES,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.size(l).cast("long").alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(l, lambda s: s.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullets"),
            _repeat_words(F.col(w)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda word: word.isin(stops))).cast("long").alias("n_stop_words"),
            foreign.alias("foreign"),
        ),
    ).drop(w, l)


def _ratio(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.col(MEASURES)[top].cast("double"), F.col(MEASURES)[bottom]), F.lit(0.0))


def measures() -> dict[str, Column]:
    """The ratios that rules may name."""
    return {
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "upper_ratio": _ratio("n_upper", "word_chars"),
        "stop_word_ratio": F.when(F.col(MEASURES)["foreign"], 1.0).otherwise(_ratio("n_stop_words", "n_words")),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": _ratio("n_bullets", "n_lines"),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    ratio, holds = measures(), F.lit(True)
    for rule in rules:
        if rule.least is not None:
            holds = holds & (ratio[rule.measure] >= rule.least)
        if rule.most is not None:
            holds = holds & (ratio[rule.measure] <= rule.most)
    return holds


def base_failed() -> Column:
    m = F.col(MEASURES)
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: list[str] | tuple[str, ...] = STOP_WORDS, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` with the struct ``measures`` and the booleans ``base_failed`` and ``kept``; columns of these
    names are replaced.

    A row fails alone: copies, repeated rows and rows without an id get the same verdict as any
    other row with their text.
    """
    return (
        measured(docs, stop_words, languages)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(compiled(rules)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(MEASURES)[n].alias(n) for n in names], "base_failed", "kept")


def _sql() -> str:
    stops = ", ".join(f"'{f}'" for f in sorted({form for w in STOP_WORDS for form in (w, w.capitalize())}))
    ratio = {
        "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
        "upper_ratio": ("n_upper", "word_chars"), "stop_word_ratio": ("n_stop_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_line_ratio": ("n_bullets", "n_lines"),
    }
    tests = []
    for r in RULES:
        value = "coalesce({0}::DOUBLE / nullif({1}, 0), 0)".format(*ratio[r.measure])
        if r.measure == "stop_word_ratio":
            value = f"CASE WHEN lang NOT IN ({', '.join(repr(x) for x in LANGUAGES)}) THEN 1 ELSE {value} END"
        tests += [f"{value} >= {r.least}"] * (r.least is not None) + [f"{value} <= {r.most}"] * (r.most is not None)
    span = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, WINDOW)]])
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, lang, t, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d
), p AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), q AS (
  SELECT r, i, {span} AS s FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM q WHERE s IS NOT NULL
), n AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY r
), m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[ 	-
]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ 	]*[-*•]')))::BIGINT AS n_bullets,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN n USING (r)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept
FROM b"""


SQL = _sql()
