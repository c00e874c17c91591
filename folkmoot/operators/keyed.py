"""Tables kept by key bucket, merged in place (inventory E3, E4, E14).

A table lies in one folder for each bucket of its key. A merge reads the buckets that hold keys of the incoming rows, and
no other; what comes out is compared with what was there, bucket by bucket, and only buckets that changed are written
again, by dynamic partition overwrite. So a load costs what it touches, and loading the same rows again changes no file.
Between reading and writing, the merged buckets are kept in the shared folder, so a bucket is never read while it is
overwritten, and a job that fails leaves the old one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folkmoot._store import kept, workspace


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _written(df: DataFrame, path: str, key: list[str]) -> None:
    """A full bucket is several files: ranges of its keys."""
    df.repartitionByRange("bucket", *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _contents(df: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, rows and hashes of all of them): buckets with equal ones hold the same rows, in any order."""
    whole = F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns])
    return df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(whole).alias("x"), F.sum(whole.cast("decimal(20,0)")).alias("s"))


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    schema: StructType
    key: list[str]
    buckets: int

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> KeyedTable:
        _written(_bucketed(rows, key, buckets), path, key)
        return cls(rows.sparkSession, path, rows.schema, key, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = 64) -> KeyedTable:
        """The table at the path, which has to have as many buckets; an empty one where there is none."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return cls.create(spark.createDataFrame([], schema), path, key, buckets)
        return cls(spark, path, schema, key, buckets)

    def stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.stored().drop("bucket")

    def merge(self, incoming: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """The buckets that changed. ``merged`` takes the stored rows of some buckets and the incoming ones, and gives the rows
        to store; it has to leave the keys in their buckets."""
        with workspace(self.spark, "merge") as folder:
            new = kept(_bucketed(incoming, self.key, self.buckets), "incoming", folder)
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # self.buckets at most
            if not touched:
                return []
            old = self.stored().filter(F.col("bucket").isin(touched))
            out = merged(old.drop("bucket"), new.drop("bucket")).select(self.schema.names)
            out = kept(_bucketed(out, self.key, self.buckets), "merged", folder)
            was, now = (_contents(df, self.schema.names) for df in (old, out))
            same = was.join(now, ["bucket", "n", "x", "s"]).select("bucket")
            changed = [r["bucket"] for r in now.join(same, "bucket", "left_anti").select("bucket").collect()]
            if changed:
                _written(out.filter(F.col("bucket").isin(changed)), self.path, self.key)
            return sorted(changed)
