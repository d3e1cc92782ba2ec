"""Cutting lineage so that a lost executor costs a reread, not a recomputation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in `spark.checkpoint.dir`. Only on a single machine, as in tests, a temporary
    one takes its place; a cluster without a shared folder is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp()


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the session's shared checkpoint folder and read back."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder that Spark has written, wherever it lies."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
