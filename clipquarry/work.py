"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master (tests), and an error on a cluster, whose executors would not share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="work-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended before the interpreter
        pass


def passing(spark: SparkSession, path: str) -> str:
    """path, which goes when the driver ends."""
    atexit.register(_at_exit, spark, path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, outlives lost executors, goes when the driver ends."""
    spark = df.sparkSession
    path = passing(spark, f"{work_dir(spark)}/work/{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that saved() made, once nothing reads it any more."""
    if path := getattr(df, "_work_path", None):
        delete(df.sparkSession, path)
