"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder. It is the one the session names in ``spark.checkpoint.dir``; a folder of our
    own is set only on a single machine, where none is named. On a cluster a missing name is an error, as
    no local folder is shared by its machines."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        name = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not name and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(name or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    """A path in the checkpoint folder that nothing has used."""
    return f"{_folder(spark)}/{uuid.uuid4()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, but as a Parquet table in the same folder: smaller on disk, and read
    by columns. For wide or large intermediate tables that several later steps read in part."""
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
