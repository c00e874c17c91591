"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1000  # fewer than so many groups can hold more than one row in HOT_SHARE, at any size


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing, a local session gets a temporary folder; on a cluster, whose executors share no local
    folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """Write to the shared folder (or to one ``within`` it) and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name) if within is None else f"{within}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[str]:
    """A new shared folder for intermediate tables, deleted at the end of the block; its results are stored elsewhere by
    then."""
    path = scratch(spark, name)
    try:
        yield path
    finally:
        delete(spark, path)


@contextmanager
def bucketed(df: DataFrame, column: str, name: str) -> Iterator[DataFrame]:
    """Written to the shared folder in buckets of ``column``, as many as shuffles have partitions; later joins on the
    column read it without a shuffle. It is deleted at the end of the block, whose results are to be stored by then."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    table_name = f"{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", path).saveAsTable(table_name)
    try:
        yield spark.table(table_name)
    finally:
        spark.sql(f"DROP TABLE {table_name}")
        delete(spark, path)


def joined_by_group(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """``rows`` with the other columns of the group of their ``key``, of which each has one; ``size`` counts its rows.

    A group of more than one row in ``HOT_SHARE`` is told to every task, so its rows are not shuffled; there are fewer than
    ``HOT_SHARE`` of these. The rest is joined by a shuffle. ``groups`` has to be stored, as it is read three times.
    """
    total = groups.agg(F.sum(size).alias("n")).first()["n"] or 0
    hot = F.col(size) > total // HOT_SHARE
    few, others = F.broadcast(groups.filter(hot)), groups.filter(~hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(groups.filter(hot).select(*key)), key, "left_anti").join(others.hint("merge"), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
