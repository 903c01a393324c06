"""Capture indexes of web archives: reading them in pieces of any file size, and auditing what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netledger.operators import graph
from netledger.operators.running import ranked
from netledger.session import stored
from netledger.sources.html import allowed_url

#: Members of a capture that are read.
FIELDS = ("original", "url", "timestamp", "digest", "length", "mime", "status", "redirect", "coverage_date")


def _pieces(spark: SparkSession, files: list[str], end: str) -> DataFrame:
    """(file, ord, value): what stands before each ``end`` in the files, which are read in splits."""
    if not files:
        return spark.createDataFrame([], "file string, ord struct<block:bigint,pos:bigint>, value string")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    return spark.read.option("lineSep", end).text(files).select(F.col("_metadata.file_path").alias("file"), at.alias("ord"), "value")


def _members(text: Column) -> list[Column]:
    """Whether a text isn't a JSON object, and its members."""
    v = F.try_parse_json(text)
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
    return [(~whole).alias("malformed"), *[F.when(whole, F.try_variant_get(v, f"$.{name}", "string")).alias(name) for name in FIELDS]]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, malformed, and ``FIELDS`` as texts) of capture indexes.

    A file holds JSON objects by line, a list of objects, or a list of lists whose first names the members. Its
    first characters tell which. Lists are read up to each closing bracket, so no file or list is ever one
    row. Rows that aren't readable, such as those with that bracket inside a text, are malformed, not lost.
    ``ord`` orders the rows of a file.
    """
    starts = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    forms = starts.filter("block = 0").groupBy("file").agg(F.regexp_extract(F.min_by("value", "pos"), r"^\s*(\[?)\s*([\[{]?)", 0).alias("form"))
    found: dict[str, list[str]] = {}
    for row in forms.withColumn("form", F.regexp_replace("form", r"\s", "")).collect():  # names of files, which the driver lists anyway
        found.setdefault(row.form, []).append(row.file)

    lines = _pieces(spark, [f for form, names in found.items() if not form.startswith("[") for f in names], "\n").filter(F.trim("value") != "")
    out = lines.select("file", "ord", *_members(F.col("value")))

    objects = _pieces(spark, found.get("[{", []), "}").filter(~F.col("value").rlike(r"^\s*\]?\s*$"))
    out = out.unionByName(objects.select("file", "ord", *_members(F.concat(F.regexp_replace("value", r"^[\s,\[]*", ""), F.lit("}")))))

    lists = _pieces(spark, found.get("[[", []), "]").filter(~F.col("value").rlike(r"^\s*$"))
    lists = lists.select("file", "ord", F.from_json(F.concat(F.regexp_replace("value", r"^[\s,]*\[?\s*(?=\[)", ""), F.lit("]")), "array<string>").alias("row"))
    header = lists.groupBy("file").agg(F.min(F.struct("ord", "row")).alias("h")).select("file", F.col("h.ord").alias("first"), F.col("h.row").alias("names"))
    rows = lists.join(header, "file").filter(F.col("ord") != F.col("first"))
    return out.unionByName(rows.select("file", "ord", F.col("row").isNull().alias("malformed"), *[F.get("row", F.array_position("names", name).cast("int") - 1).alias(name) for name in FIELDS]))


def capture_rows(spark: SparkSession, path: str) -> DataFrame:
    """(url, captured_at, digest, ord) of capture indexes, without rows that lack an address or a time of 14 digits."""
    rows = read_captures(spark, path).filter(F.col("timestamp").rlike("^[0-9]{14}$")).withColumn("address", F.coalesce("original", "url"))
    return rows.filter("address IS NOT NULL").select(F.col("address").alias("url"), F.col("timestamp").alias("captured_at"), "digest", F.struct("file", "ord").alias("ord"))


def _plain_url(url: Column, hosts: list[str], path: str) -> Column:
    """An allowed address as scheme, host in lower case and path; null for any other, or with a query, fragment or escape."""
    ok = allowed_url(F.regexp_replace(url, r"^[hH][tT][tT][pP][sS]://", "https://"), hosts, path) & ~url.rlike("[?#%]")
    return F.when(ok, F.concat(F.lit("https://"), F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))))


def audit_captures(rows: DataFrame, hosts: list[str], path: str, coverage_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (url, captured_at, coverage_date, digest, length, mime, status, redirect, supersedes) of captures
    as ``read_captures`` gives them, and problems (code, url, captured_at, ord).

    Invalid rows go with the first reason that holds. The first row of a (url, digest) counts, the others are
    ``duplicate_capture``. ``supersedes`` is the capture of the address before it, set before captures of one
    moment with different digests go as ``conflicting_capture``. The last redirect of an address is followed:
    ``redirect_cycle`` and ``redirect_target_missing`` name the address from which a circle, or an end that was not captured, is
    reached. Redirects are pointers whose walks double their strides, not a walk per address.
    """
    url = _plain_url(F.coalesce(F.nullif("original", F.lit("")), "url"), hosts, path)
    moment = F.when(F.col("timestamp").rlike("^[0-9]{14}$"), F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss")))
    covered = F.coalesce(F.nullif("coverage_date", F.lit("")), F.lit(coverage_date).cast("string"))
    length, target = F.col("length").try_cast("bigint"), _plain_url(F.col("redirect"), hosts, path)
    known = rows.withColumns({"address": url, "moment": moment, "covered": covered, "bytes": length, "target": target})
    there = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    why = (
        F.when(F.col("malformed"), "malformed_row").when(F.col("address").isNull(), "invalid_url").when(F.col("moment").isNull(), "invalid_timestamp")
        .when(~there("digest") | ~there("mime") | F.col("status").isNull() | F.col("length").isNull(), "missing_fields").when(F.col("bytes").isNull() | (F.col("bytes") < 0), "invalid_length")
        .when(F.coalesce(F.try_to_date("covered", "yyyy-MM-dd").isNull() | ~F.col("covered").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.lit(True)), "missing_coverage_date")
    )
    order = F.struct("file", "ord")
    judged = stored(known.select(
        "address", F.col("timestamp").alias("captured_at"), F.col("covered").alias("coverage_date"), "digest", F.col("bytes").alias("length"), "mime", "status", "redirect", "target", order.alias("ord"), why.alias("code")))
    problem = lambda d, code: d.select(code.alias("code") if isinstance(code, Column) else F.lit(code).alias("code"), F.col("address").alias("url"), "captured_at", "ord")
    problems = problem(judged.filter("code IS NOT NULL"), F.col("code"))
    fine = judged.filter("code IS NULL").drop("code")
    first = fine.groupBy("address", "digest").agg(F.min("ord").alias("first"))
    told = fine.join(first, ["address", "digest"])
    problems = problems.unionByName(problem(told.filter("ord <> first"), "duplicate_capture"))
    kept = told.filter("ord = first").drop("first")
    turned = there("redirect")
    wrong = turned & (~F.col("status").startswith("3") | F.col("target").isNull())
    problems = problems.unionByName(problem(kept.filter(wrong), "invalid_redirect"))
    kept = stored(kept.filter(~wrong).withColumn("redirect", F.when(turned, F.col("target"))).drop("target"))

    by = ["address", "coverage_date"]
    placed = stored(ranked(kept, by, ["captured_at", "ord"]).drop("n"))
    linked = placed.join(placed.select(*by, (F.col("rank") + 1).alias("rank"), F.col("captured_at").alias("supersedes")), [*by, "rank"], "left")
    conflict = kept.groupBy("address", "coverage_date", "captured_at").agg(F.count_distinct("digest").alias("n"), F.min("ord").alias("ord")).filter("n > 1")
    records = linked.join(conflict.select("address", "coverage_date", "captured_at"), ["address", "coverage_date", "captured_at"], "left_anti")
    ends = graph.chain_ends(kept.filter("redirect IS NOT NULL").groupBy(F.col("address").alias("id")).agg(F.max_by("redirect", "ord").alias("to")))
    nowhere = ends.filter("end IS NOT NULL").join(kept.select(F.col("address").alias("end")).distinct(), "end", "left_anti")
    for code, d in (("redirect_cycle", ends.filter("end IS NULL")), ("redirect_target_missing", nowhere)):
        problems = problems.unionByName(d.select(F.lit(code).alias("code"), F.col("id").alias("url"), F.lit(None).cast("string").alias("captured_at"), F.lit(None).cast(kept.schema["ord"].dataType).alias("ord")))
    problems = problems.unionByName(problem(conflict, "conflicting_capture"))
    return records.select(F.col("address").alias("url"), "captured_at", "coverage_date", "digest", "length", "mime", "status", "redirect", "supersedes"), problems
