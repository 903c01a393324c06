"""Sealed bundles: a table with a manifest of content hashes, and its verification.

A bundle is a folder of Parquet files and a one-row ``_manifest`` table. Hashes are computed where the
files are, by Spark; only the manifest passes the driver. The manifest also names the code that made the bundle,
by a hash of the library's sources.
"""

from __future__ import annotations

import hashlib
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def _hashes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _content_id(hashes: DataFrame) -> DataFrame:
    """One row: number of files, bytes, and a hash over the files' hashes in order."""
    return hashes.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("content_id"))


@cache
def code_hash() -> str:
    """SHA-256 over the names and contents of the library's sources, in order of their names."""
    root = Path(__file__).resolve().parents[1]
    whole = hashlib.sha256()
    for source in sorted(root.rglob("*.py"), key=lambda f: f.relative_to(root).as_posix()):
        whole.update(f"{source.relative_to(root).as_posix()}\0{hashlib.sha256(source.read_bytes()).hexdigest()}\n".encode())
    return whole.hexdigest()


def seal(df: DataFrame, path: str, kind: str, qa: DataFrame | None = None) -> None:
    """Write ``df`` as a bundle. ``qa`` (kind, ..) is kept beside it; its errors are counted in the
    manifest. An existing bundle is not written over.

    The manifest is made of the stored checksums and written last. Then all files are hashed once more: if one has changed in
    the meantime, this raises, and the bundle stays as one that does not verify."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data")
    qa = qa if qa is not None else spark.createDataFrame([], "kind string")
    qa.write.mode("errorifexists").json(f"{path}/qa")
    errors = qa.filter("kind = 'error'").count()
    _hashes(spark, path).write.mode("errorifexists").parquet(f"{path}/_checksums")
    manifest = _content_id(spark.read.parquet(f"{path}/_checksums")).select(
        "*", F.lit(kind).alias("kind"), F.lit(errors).cast("long").alias("qa_errors"), F.lit(df.schema.json()).alias("schema"), F.lit(code_hash()).alias("code"))
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/_manifest")
    found = verify(spark, path).take(5)
    if found:
        raise ValueError(f"{path} changed while it was sealed: {[tuple(r) for r in found]}")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of a bundle: ``changed``, ``missing``, ``extra`` files, or a changed ``manifest``."""
    then = spark.read.parquet(f"{path}/_checksums").alias("t")
    now = _hashes(spark, path).alias("n")
    met = then.join(now, "file", "full_outer")
    problem = F.when(F.col("n.sha256").isNull(), "missing").when(F.col("t.sha256").isNull(), "extra").when(F.col("t.sha256") != F.col("n.sha256"), "changed")
    files = met.select("file", problem.alias("problem")).filter("problem IS NOT NULL")
    sealed = spark.read.parquet(f"{path}/_manifest").select(F.col("content_id").alias("was"))
    same = _content_id(spark.read.parquet(f"{path}/_checksums")).crossJoin(F.broadcast(sealed)).filter("content_id <> was")  # one row each
    return files.unionByName(same.select(F.lit("_manifest").alias("file"), F.lit("manifest").alias("problem")))


def open_sealed(spark: SparkSession, path: str, kind: str, strict_code: bool = False) -> DataFrame:
    """The table of a bundle, after verification; raises if it isn't of the kind, has QA errors, or differs, and with
    ``strict_code`` also if other code than this has made it, or an unnamed one."""
    manifest = spark.read.parquet(f"{path}/_manifest").first()
    if strict_code and manifest.asDict().get("code") != code_hash():
        raise ValueError(f"{path}: made by other code than this")
    if manifest["kind"] != kind or manifest["qa_errors"]:
        raise ValueError(f"{path}: {manifest['kind']} with {manifest['qa_errors']} QA errors, not a clean {kind}")
    found = verify(spark, path).take(5)
    if found:
        raise ValueError(f"{path}: {[tuple(r) for r in found]}")
    return spark.read.parquet(f"{path}/data")


def qa_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row (errors, other) over QA lines; a malformed line counts as an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | (F.get_json_object("value", "$.kind") == "error")
    return lines.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("errors"), F.count_if(~F.coalesce(bad, F.lit(False))).alias("other"))


def canonical_jsonl(df: DataFrame, path: str) -> None:
    """One object per line with keys in order, without blanks; null members are written."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.mode("errorifexists").text(path)


def fixed_csv(df: DataFrame, path: str, digits: dict[str, int]) -> None:
    """Gzipped CSV with fixed decimals."""
    shown = df.withColumns({c: F.format_string(f"%.{n}f", F.col(c)) for c, n in digits.items()})
    shown.write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(path)
