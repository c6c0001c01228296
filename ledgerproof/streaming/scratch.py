"""A folder that driver and executors share, and what a task's Python is handed at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a session on one machine may do without it, and has a local folder."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = (root or "file:///tmp/checkpoints/ledgerproof").rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands Python batches bounded by rows and bytes, so a task's memory doesn't depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder: what several parts of a plan read is computed once, and a lost executor costs nothing of it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
