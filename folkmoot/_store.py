"""Results of a step kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where that is unset, a local session gets a temporary folder; on a cluster, whose
    executors share no local folder, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """Written to the shared folder (or to one ``within`` it) and read again. It is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{within or shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if within is None:
        delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """When the application ends; the folder has to be there already."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[str]:
    """A new shared folder for intermediate tables, deleted at the end of the block; what is to outlive it is kept elsewhere by
    then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    try:
        yield path
    finally:
        delete(spark, path)


def few(df: DataFrame, most: int) -> bool:
    """Whether there are at most ``most`` rows; reads no more of them than it has to."""
    return df.limit(most + 1).count() <= most
