"""Steps of a long job, written where all executors read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of shuffle files that Spark gives to a task. Rows of ids and names take several times as much memory, and with
#: Spark's own 64 MB their sorts spill.
_TASK, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16 << 20


def _folder(spark: SparkSession) -> str | None:
    """The folder that the cluster names for checkpoints, on one machine else a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="spark-")
    return named.rstrip("/") if named else None


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read again: it is computed once, and its shuffle files go as soon as it is written.

    A cluster that names no folder gets `df` as it is, which each reader then computes."""
    spark = df.sparkSession
    folder = _folder(spark)
    if folder is None:
        return df
    path, before = f"{folder}/step-{uuid.uuid4().hex}", {_CLEANUP: spark.conf.get(_CLEANUP, "false"), _TASK: spark.conf.get(_TASK)}
    spark.conf.set(_CLEANUP, "true")
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[_TASK]) > TASK_BYTES:
        spark.conf.set(_TASK, str(TASK_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        if at := getattr(table, "stored_at", None):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
