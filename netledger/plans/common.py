"""What the registered queries share: tables, and the roles that their columns play.

A nation stands for a municipal unit, a region for a prefecture, a supplier for a facility, customers
for population, and arithmetic on keys for coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Kinds of the test table's events that stand for structural ones, for closing and for opening again.
STRUCTURAL, CLOSED, REOPENED = ("signup", "purchase"), "error", "click"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: Column) -> Column:
    return 20 + (key * 37 % 2600) / 100


def lon(key: Column) -> Column:
    return 122 + (key * 91 % 3200) / 100


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, n_name, r_name, n, p): facilities and people of each nation."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("p"))
    facilities = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = nation.join(people, "n_nationkey", "left").join(facilities, "n_nationkey", "left")
    return out.select("n_nationkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(0)).alias("p"))


#: The same as a common table expression.
UNITS = """units AS (
  SELECT n_nationkey, n_name, r_name, coalesce(n, 0) AS n, coalesce(p, 0) AS p
  FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS p FROM customer GROUP BY 1) AS c ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) AS s ON s_nationkey = n_nationkey
)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Float sums differ in their last bits between plans; compared columns are rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
