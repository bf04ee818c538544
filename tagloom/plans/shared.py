"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/") if base else tempfile.mkdtemp(prefix="spark-")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system delete a folder of intermediate results, made here if it is not there, when the driver's JVM ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)


def intermediate_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the driver ends, as frames that read it may be used until then."""
    path = f"{shared_path(spark)}/{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: it is made once, and a lost executor costs a read."""
    path = f"{intermediate_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished in this folder."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
