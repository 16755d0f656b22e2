"""The folder that all executors share, cutting lineage in it, and intermediate tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a local session, as in tests, makes one of its own; on a
    cluster nothing could be shared through such a folder, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame, path: str) -> DataFrame:
    spark, freed = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed)
    spark.conf.set(freed, "true")  # the table replaces this write's shuffle files
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(freed, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, and lost executors cost no rerun."""
    return _written(df, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}")


class Steps:
    """Stored tables that a computation needs only until its result is stored: leaving the block removes them.

        with Steps(spark) as step:
            a = step.stored(...)
            result = stored(... a ...)
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._folder = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"

    def __enter__(self) -> Steps:
        return self

    def stored(self, df: DataFrame) -> DataFrame:
        return _written(df, f"{self._folder}/{uuid.uuid4().hex}")

    def __exit__(self, *_) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
