"""A corpus pipeline: quality rules, near-dedup, secret scan, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it left. All but
the last return the columns of ``documents``.

Rows with null or blank texts fail the quality rules. Of repeated rows, and of rows without an id that
have the same text, the near-dedup leaves one; of a group of near copies it leaves the one of the least
id, a null id before others. Rows of one id with different texts are told apart. A null source is a
source of its own. Ties in the mix are ordered by id, size and content, so reruns agree. No documents give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netledger.llm import mixing, quality_rules, secrets, sentencepiece_codec, simhash

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).filter("kept").select(*DOCUMENTS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8)."""
    return simhash.drop_near_duplicates(docs).select(*DOCUMENTS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs).select(*DOCUMENTS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs).select(*DOCUMENTS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row."""
    out = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", rules_stage),
    ("simhash near-dedup", dedup_stage),
    ("secret scan", secrets_stage),
    ("mixing to target weights", mixing_stage),
    ("sentencepiece encoding", tokens_stage),
]

#: SQL has neither the near-dedup nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
