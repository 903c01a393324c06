"""Queries of change notices, printed from the suppliers: a file per nation, a record per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from netledger.plans.common import table
from netledger.sources import notices


def _printed(spark, sf_dir):
    """(file, page, line, text). By its number a record is plain, has a wrapped address, a wrapped reason, its
    address before the row, its marks behind it, no date, or no second row."""
    k = F.col("s_suppkey")
    shape, ident = k % 7, F.lpad((k % 1000000).cast("string"), 6, "0")
    number = k.cast("string")
    row = lambda side, address, marks: F.concat(F.lit(f"          {side} 郵便局 "), ident, F.lit(" 局"), number, F.lit(" ○ "), address, F.lit(" "), marks)
    full = F.lit("- ○ ○ × ○ ○ -")
    old, new = F.concat(F.lit("東京都港区１－"), number), F.concat(F.lit("東京都府中市２－"), number)
    date = F.concat(F.lit("R6."), (k % 14).cast("string"), F.lit("."), (k % 28 + 1).cast("string"))
    lines = F.array(
        F.lit("別紙"), row("変更前", F.when(shape == 1, "東京都港区１－").otherwise(old), full), F.when(shape == 1, F.concat(F.lit(" " * 24), number)).when(shape == 2, "過疎地区"),
        F.when(shape != 5, F.concat(date, F.when(shape == 2, "").when(k % 11 == 0, " 未知").otherwise(" 移転・改称"))), F.when(shape == 2, "分の変更").when(shape == 3, F.concat(F.lit(" " * 24), new)),
        F.when(shape != 6, row("変更後", F.when(shape == 3, "").otherwise(new), F.when(shape == 4, "- ○ ○").otherwise(full))), F.when(shape == 4, F.lit(" " * 40 + "× ○ ○ -")), F.lit("注 整理番号"),
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("file"), F.lit(1).alias("page"), k.alias("k"), F.posexplode(lines).alias("i", "text")).filter("text IS NOT NULL")
    return s.select("file", "page", (F.col("k") * 10 + F.col("i")).alias("line"), "text")


def notice_events(spark, sf_dir):
    out = notices.notice_events(_printed(spark, sf_dir))
    side = lambda s: [F.col(f"{s}.ident").alias(f"{s}_ident"), F.col(f"{s}.name").alias(f"{s}_name"), F.col(f"{s}.address").alias(f"{s}_address"), F.array_join(f"{s}.services", "").alias(f"{s}_services")]
    return out.select("file", "line", "date_raw", F.col("planned").cast("string").alias("planned"), "reason", F.array_join("kinds", ",").alias("kinds"), *side("before"), *side("after"), F.array_join("problems", ",").alias("problems"))


QUERIES = {"notice_events": notice_events}

ORACLE_SQL = {
    "notice_events": """
WITH s AS (
  SELECT s_suppkey AS k, s_nationkey::VARCHAR AS file, s_suppkey % 7 AS shape, lpad((s_suppkey % 1000000)::VARCHAR, 6, '0') AS ident, '局' || s_suppkey AS name, '東京都港区１－' || s_suppkey AS old, '東京都府中市２－' || s_suppkey AS new,
    'R6.' || s_suppkey % 14 || '.' || (s_suppkey % 28 + 1) AS d, try_cast('2024-' || lpad((s_suppkey % 14)::VARCHAR, 2, '0') || '-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS DATE)::VARCHAR AS day FROM supplier
), t AS (SELECT *, CASE WHEN shape = 5 THEN NULL WHEN shape = 2 THEN '過疎地区分の変更' WHEN k % 11 = 0 THEN '未知' ELSE '移転・改称' END AS reason FROM s)
SELECT file, k * 10 + 1 AS line, CASE WHEN shape <> 5 THEN d END AS date_raw, CASE WHEN shape <> 5 THEN day END AS planned, reason,
  CASE reason WHEN '移転・改称' THEN 'relocation,renamed' WHEN '過疎地区分の変更' THEN 'disadvantaged_area_change' ELSE '' END AS kinds,
  ident AS before_ident, name AS before_name, old AS before_address, '○○×○○' AS before_services,
  CASE WHEN shape <> 6 THEN ident END AS after_ident, CASE WHEN shape <> 6 THEN name END AS after_name, CASE WHEN shape <> 6 THEN new END AS after_address, CASE WHEN shape <> 6 THEN '○○×○○' END AS after_services,
  concat_ws(',', CASE WHEN shape = 6 THEN 'unpaired' END, CASE WHEN shape = 5 THEN 'unmatched_pair_date_or_reason' END, CASE WHEN shape <> 5 AND day IS NULL THEN 'invalid_change_date' END, CASE WHEN reason = '未知' THEN 'unknown_reason' END) AS problems FROM t""",
}
