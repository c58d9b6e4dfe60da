"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def table_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one on one machine, where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return folder or "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df written there as Parquet and read back: computed once, however often it is used, and safe from lost executors."""
    path = f"{table_folder(df.sparkSession).rstrip('/')}/framecut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of images: small enough that a task reads the next ones while Python works on these.
IMAGE_BATCH = 4 << 20


@contextlib.contextmanager
def image_batches(spark: SparkSession):
    """Within it, jobs send IMAGE_BATCH bytes to Python at a time; afterwards the session is as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(IMAGE_BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)
