"""Secret scan with multipart credential linking, in built-in column functions.

One pass over the texts finds the strong spans and the weak parts of every document. Strong spans
are always reported. A weak part (an identifier, an opaque key, an endpoint) is reported only when
the parts that complete it lie within the same scope of the text, at most SCOPE characters between
the two, which an interval join decides: the ends of parts are dealt into blocks of SCOPE characters,
joined on (document, side, block) with the two blocks that reach from a weak part to either side, and
compared exactly. Matches of a kind don't overlap, so a block holds a bounded number.

Null and empty texts have no spans. Rows are told apart by id and text, so repeated rows and rows
without an id get their own results; rows equal in both get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netledger.llm.common import let, may_hold, named, sieve, spare, table
from netledger.session import checkpointed

#: Kinds in the order in which spans of equal start are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")

#: The patterns of the strong kinds and the least number of characters they need.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Weak parts.
IDENT = r"""(?:[Uu]ser(?:name|_id)?|[Ll]ogin|[Cc]lient_?[Ii]d|[Aa]ccount_?[Ii]d|[Aa]ccess_?[Kk]ey_?[Ii]d)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,64}"""
KEY = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"""

#: Characters between two parts of one credential.
SCOPE = 256

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def running(values: Column, merge) -> Column:
    """What ``merge`` makes of 0 and all integers before each one of an array, such as their sums.

    An array grows by copies, so it is made in chunks of the square root of its size: the work is that
    of the size to the power of 1.5, not its square.
    """
    def scan(chunk: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(chunk, start, lambda acc, n: F.struct(merge(acc["at"], n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def place(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda x, n: merge(x, n)))
        return F.flatten(F.zip_with(chunks, scan(totals, F.lit(0)), scan))

    def cut(entries: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(entries))).cast("int")
        return let(F.transform(F.sequence(F.lit(0), ((F.size(entries) - 1) / size).cast("int")), lambda c: F.slice(entries, c * size + 1, size)), place)

    return let(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches; ``keep`` tests the text of ``group``.

    Spark has no function for match positions: what lies between matches comes from a split by the
    same pattern, and the running sum of both gives starts and ends in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.transform(found, lambda s: keep(s) if keep else F.lit(True))
    pieces = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"))),
        tested,
        lambda p, ok: F.struct(p["gap"].alias("gap"), p["n"].alias("n"), F.coalesce(ok, F.lit(False)).alias("ok")),
    )

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + x["n"]), lambda x, y: x + y)
        spans = F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + x["gap"] + x["n"]).alias("end"), x["ok"].alias("ok")))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return let(pieces, placed)


def _where(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_SPAN))


def parts(text: Column) -> tuple[Column, Column]:
    """Strong spans and weak parts of a text. A run of hex digits of the least length or more is
    what a match of that least length extends to, so the quantifier may name it; likewise access."""
    hexes, access = HEX.replace("+", f"{{{LEAST['hex']},}}"), ACCESS.replace("+", f"{{{LEAST['access'] - 4},}}")
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[A-Z]") & s.rlike("[a-z]")
    strong = F.concat(
        _where(text.rlike(ASSIGN), _spans(text, ASSIGN, "assign", lambda s: F.length(s) >= LEAST["assign"], 2)),
        _where(F.contains(text, F.lit("AKIA")), _spans(text, access, "access")),
        _where(text.rlike(hexes), _spans(text, hexes, "hex")),
    )
    weak = F.concat(
        _where(text.rlike(IDENT), _spans(text, IDENT, "ident")),
        _where(text.rlike(KEY), _spans(text, KEY, "key", mixed)),
        _where(text.rlike(ENDPOINT), _spans(text, ENDPOINT, "endpoint")),
    )
    return strong, weak


def _linked(found: DataFrame) -> DataFrame:
    """Weak spans of each (doc_id, digest) whose complementary parts lie within the scope."""
    keys = ["doc_id", "digest"]
    one = found.filter(F.size("weak") > 0).groupBy(*keys).agg(F.first("strong").alias("strong"), F.first("weak").alias("weak"))
    block = lambda at: F.floor(at / SCOPE).cast("int")
    reach = lambda *ends: F.explode(F.array(*[F.struct(F.lit(side).alias("side"), block(at).alias("block")) for side, at in ends]))
    part = one.select(*keys, F.explode(F.concat("strong", "weak")).alias("p")).select(
        *keys, F.col("p.start").alias("at"), F.col("p.end").alias("until"),
        F.when(F.col("p.kind").isin(KINDS.index("access"), KINDS.index("ident")), "id")
        .when(F.col("p.kind") == KINDS.index("endpoint"), "endpoint").otherwise("key").alias("role"),
    )
    part = part.select("*", reach(("before", F.col("until")), ("after", F.col("at"))).alias("r")).select(*keys, "at", "until", "role", "r.*")
    weak = one.select(*keys, F.explode("weak").alias("w"))
    start, end = F.col("w.start"), F.col("w.end")
    probe = weak.select(*keys, "w", reach(("before", start - SCOPE), ("before", start), ("after", end), ("after", end + SCOPE)).alias("r")).select(*keys, "w", "r.*")
    # a part inside the candidate or around it is the same piece of text, not its complement
    between = F.when(F.col("x.side") == "before", F.col("x.w.start") - F.col("y.until")).otherwise(F.col("y.at") - F.col("x.w.end"))
    near = probe.alias("x").join(
        part.alias("y"),
        F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.digest") == F.col("y.digest")) & (F.col("x.side") == F.col("y.side")) & (F.col("x.block") == F.col("y.block"))
        & between.between(0, SCOPE),
    )
    has = lambda role: F.max(F.col("y.role") == role)
    roles = near.groupBy("x.doc_id", "x.digest", "w").agg(has("id").alias("id"), has("key").alias("key"), has("endpoint").alias("endpoint"))
    kind = F.col("w.kind")
    complete = (
        F.when(kind == KINDS.index("ident"), F.col("key"))
        .when(kind == KINDS.index("key"), F.col("id"))
        .otherwise(F.col("id") & F.col("key"))
    )
    return roles.filter(complete).groupBy(*keys).agg(F.sort_array(F.collect_list("w")).alias("added"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, base, spans) of every row of ``docs`` (doc_id, text).

    ``base`` holds the strong spans and ``spans`` all that are reported, both ordered by start, then
    kind; ``digest`` is the XXH64 of the text, by which callers join the result back.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    strong, weak = parts(text)
    found = checkpointed(
        docs.select("doc_id", F.xxhash64(text).alias("digest"), F.sort_array(strong).alias("strong"), weak.alias("weak"))
    )
    added = _linked(found).alias("a")
    joined = found.alias("f").join(
        added, F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.digest") == F.col("a.digest")), "left"
    )
    return joined.select(
        F.col("f.doc_id"), F.col("f.digest"), F.col("f.strong").alias("base"),
        F.sort_array(F.concat("f.strong", F.coalesce("a.added", F.array().cast(_SPAN)))).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (doc_id, text, ...) with every reported span replaced by ``mark``; overlapping spans are
    replaced as one. Rows without spans, null texts among them, and other columns but n_chars stay as
    they are."""
    found = checkpointed(scan(docs).filter(F.size("spans") > 0).select("doc_id", "digest", "spans").distinct())
    digest = spare("digest", docs.columns)
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    key = (F.col("doc_id"), F.col(digest))
    bits = sieve(found, F.col("doc_id"), F.col("digest"))
    plain = may_hold(marked, bits, *key, there=False).select(*map(named, docs.columns))
    joined = may_hold(marked, bits, *key).alias("m").join(found.alias("s"), F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"m.{digest}") == F.col("s.digest")), "left")
    text = F.col("m.text")

    def cut(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        pieces = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))

    clean = F.when(F.col("s.spans").isNull(), text).otherwise(let(F.col("s.spans"), cut))
    changed = {"text": clean} | ({"n_chars": F.when(F.col("s.spans").isNull(), F.col("m.n_chars")).otherwise(F.length(clean))} if "n_chars" in docs.columns else {})
    return plain.unionByName(joined.select(*[changed.get(c, named(c, "m")).alias(c) for c in docs.columns]))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for kind, pattern, group, keep in (
        ("assign", ASSIGN, 2, f"length(g) >= {LEAST['assign']}"),
        ("access", ACCESS, 0, f"length(g) >= {LEAST['access']}"),
        ("hex", HEX, 0, f"length(g) >= {LEAST['hex']}"),
        ("ident", IDENT, 0, "true"),
        ("key", KEY, 0, "regexp_matches(g, '[0-9]') AND regexp_matches(g, '[A-Z]') AND regexp_matches(g, '[a-z]')"),
        ("endpoint", ENDPOINT, 0, "true"),
    ):
        p = quoted(pattern)
        rows.append(f"""
  SELECT r, {KINDS.index(kind)} AS kind, until - length(m) AS a, until AS b FROM (
    SELECT r, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS until FROM (
      SELECT r, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS g,
        unnest(string_split_regex(t, {p})[:-2]) AS gap, unnest(range(len(regexp_extract_all(t, {p}, 0)))) AS i
      FROM d WHERE regexp_matches(t, {p}))) WHERE {keep}""")
    role = (
        f"CASE WHEN kind IN ({KINDS.index('access')}, {KINDS.index('ident')}) THEN 'id' "
        f"WHEN kind = {KINDS.index('endpoint')} THEN 'endpoint' ELSE 'key' END"
    )
    names = ", ".join(f"'{k}'" for k in KINDS)
    listed = f"string_agg(([{names}])[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(rows)}),
n AS (
  SELECT w.r, w.kind, w.a, w.b, bool_or(p.role = 'id') AS id, bool_or(p.role = 'key') AS k
  FROM s AS w JOIN (SELECT *, {role} AS role FROM s) AS p
    ON w.r = p.r AND (w.a - p.b BETWEEN 0 AND {SCOPE} OR p.a - w.b BETWEEN 0 AND {SCOPE})
  WHERE w.kind >= 3 GROUP BY ALL
), kept AS (
  SELECT r, kind, a, b FROM s WHERE kind < 3
  UNION ALL SELECT r, kind, a, b FROM n WHERE CASE kind WHEN 3 THEN k WHEN 4 THEN id ELSE id AND k END
), x AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce({listed.replace("ORDER BY a, kind)", "ORDER BY a, kind) FILTER (kind < 3)")}, '') AS base, {listed} AS spans
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (r)"""


SQL = _sql()
