"""Queries of register lists, printed from the suppliers with drifting columns and blank cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.plans.common import table
from netledger.sources import register_lists


def _printed(spark, sf_dir):
    """(file, page, line, text): a file per nation; every third nation's list is of the other section."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    other = n % 3 == 2
    at = lambda c, text: F.rpad(c, text, " ")
    drift = k % 5 - 2
    mark = lambda i: F.when((k + i) % 4 == 0, " ").when((k + i) % 4 == 1, "×").otherwise("○")
    bare = k % 7 == 0
    head = F.concat(F.lpad(k.cast("string"), 6, " "), F.lit(" "), F.lpad((k % 1000000).cast("string"), 6, "0"), F.when(other, "a").otherwise(""), F.when(bare, "  村").otherwise("  石川県"), k.cast("string"), F.lit("郵便局"), F.when((k % 3 == 0) & ~bare, " ○ ").otherwise("  "), F.when(bare, "区画").otherwise("石川県金沢市"), (k % 90).cast("string"))
    line = at(head, 70 + drift)
    line = F.concat(line, at(F.lit("○"), 4), at(mark(0), 6), at(mark(1), 6))
    line = F.concat(line, F.when(other, at(mark(2), 6)).otherwise(at(mark(2), 5)), F.when(other, at(mark(3), 6)).otherwise(at(mark(3), 10)), at(mark(4), 6), F.when(k % 2 == 0, "支店|備考").otherwise("支店"), F.lit("      "), F.when(k % 6 == 0, "一時閉鎖").when(k % 13 == 0, "").otherwise("営業中"))
    title = F.when(other, "別記様式（会社の営業所）").otherwise("別記様式（郵便局）")
    s = table(spark, sf_dir, "supplier").select(n.cast("string").alias("file"), k.alias("line"), line.alias("text"))
    return s.select("file", F.lit(1).alias("page"), "line", "text").unionByName(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file"), F.lit(1).alias("page"), F.lit(-1).cast("long").alias("line"), F.when(F.col("n_nationkey") % 3 == 2, "別記様式（会社の営業所）").otherwise("別記様式（郵便局）").alias("text")))


def list_rows(spark, sf_dir):
    rows, _ = register_lists.list_rows(_printed(spark, sf_dir))
    return rows.select("file", "line", "section", "serial", "ident", "name", "simple", "address", "area", F.array_join(F.transform("services", lambda m: F.when(m == "", "_").otherwise(m)), "").alias("services"), "related", "notes", "status", "confidence")


def list_problems(spark, sf_dir):
    _, problems = register_lists.list_rows(_printed(spark, sf_dir))
    return problems.select("file", "line", "code")


QUERIES = {"list_rows": list_rows, "list_problems": list_problems}

_MARK = "CASE WHEN (k + {0}) % 4 = 0 THEN '_' WHEN (k + {0}) % 4 = 1 THEN '×' ELSE '○' END"

ORACLE_SQL = {
    "list_rows": f"""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_suppkey % 13 <> 0 OR s_suppkey % 6 = 0)
SELECT n::VARCHAR AS file, k AS line, CASE WHEN n % 3 = 2 THEN 'company_office' ELSE 'postal_office' END AS section, k AS serial, lpad((k % 1000000)::VARCHAR, 6, '0') || CASE WHEN n % 3 = 2 THEN 'a' ELSE '' END AS ident,
  CASE WHEN k % 7 = 0 THEN '村' ELSE '石川県' END || k || '郵便局' AS name, CASE WHEN k % 3 = 0 AND k % 7 <> 0 THEN '○' ELSE '' END AS simple, CASE WHEN k % 7 = 0 THEN '区画' ELSE '石川県金沢市' END || k % 90 AS address, '○' AS area,
  {" || ".join(_MARK.format(i) for i in range(5))} AS services, '支店' AS related, CASE WHEN k % 2 = 0 THEN '備考' ELSE '' END AS notes, CASE WHEN k % 6 = 0 THEN '一時閉鎖' ELSE '営業中' END AS status, 'high' AS confidence FROM s""",
    "list_problems": """
SELECT s_nationkey::VARCHAR AS file, s_suppkey AS line, 'missing_status' AS code FROM supplier WHERE s_suppkey % 13 = 0 AND s_suppkey % 6 <> 0""",
}
