"""A streaming face of the ledger: events arrive as files and are counted per window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from netledger.session import checkpointed


def windowed_counts(events: DataFrame, at: str, key: str, kind: str, late: str, width: str) -> DataFrame:
    """(start, kind, n, total): events per window, each identifier once, dropped if later than ``late``."""
    once = events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    out = once.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def run_available(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """Run a streaming aggregate over all files that are there and read back what it wrote.

    Each batch replaces the rows of its windows, so the last batch of a window has its final count.
    The sink and the query's own checkpoint stand in the session's checkpoint folder.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(0))
    base = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{base}/sink")

    query = counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/query").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/sink")
    keys = [c for c in counted.columns if c not in ("n", "total")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct("n", "total"), "_batch").alias("l")).select(*keys, "l.*")
