"""Shared working storage: the folder all executors can reach, staged tables, cut lineage."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), a temporary one.

    The fallback is set in the session once, so that later calls see the same folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks that ran on it; nothing is kept in executors' memory or
    local disks between the steps of an operator.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_of(df: DataFrame) -> str:
    """The folder of a staged table."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, from file sizes, 0 where it has none; sizes partitions, never results."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def partitions_for(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """How many partitions of about `each` bytes hold `size` bytes, never under the session's own count."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, -(-size // each)))
