"""Exact deduplication by content sort, in DataFrame operations only.

Rows are dealt by sampled splitters over the first characters of the text and a 64-bit hash of it (both without case),
sorted externally inside each range so that equal texts are neighbours, and told apart by comparing whole neighbouring
texts. One row of each group stays: the smallest identifier by default, the largest on request.

A text with very many copies would fill one range. Copies are first counted by hash (eight bytes a row, combined before
the shuffle). A hash with more than ``hot_rows`` rows and more than one row in ``HOT_SHARE`` is dealt over several
ranges by a salt, and the few results of each salted text are added up afterwards. There are fewer than ``HOT_SHARE``
such hashes at any size of the input, so they are broadcast.

Null texts count as empty, and empty texts are equal to each other. Repeated identifiers stay separate rows. A null
identifier loses to any other. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.llm._common import stored

SPLIT_CHARS = 32  # of the text in a splitter, so that samples stay small however long texts are
HOT_SHARE = 100_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; where no other letter has a lower case, ``lower`` does the same and is much faster."""
    plain = ~text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _dealt(docs: DataFrame, id_col: str, text_col: str, keep: str, hot_rows: int, salts: int) -> DataFrame:
    """Rows (row struct, doc_id, salt, norm, place, keep_id, group_size), with equal texts of one salt together."""
    pick = F.max if keep == "max" else F.min
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col(f"row.{id_col}").cast("long").alias("doc_id"))
    rows = rows.withColumn("hash", F.xxhash64(F.lower(text)))  # equal normalised texts are equal in lower case
    least = max(hot_rows, docs.count() // HOT_SHARE)
    hot = stored(rows.groupBy("hash").count().filter(F.col("count") > least).select("hash", F.lit(True).alias("hot")), "hot-texts")
    # By partition as well as by id, as copies may share an id or have none. A task that runs again has the same rows, so they
    # get the same salts.
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts))).otherwise(F.lit(-1))
    dealt = rows.join(F.broadcast(hot), "hash", "left").withColumns({"salt": salt, "head": F.lower(F.substring(text, 1, SPLIT_CHARS))})
    ranged = dealt.select("row", "doc_id", "hash", "salt", "head").repartitionByRange("head", "hash", "salt")
    same = Window.partitionBy("head", "hash", "salt", "norm")
    return ranged.withColumn("norm", ascii_lower(text)).select(
        "row",
        "doc_id",
        "salt",
        F.sha2("norm", 256).alias("text_sha256"),
        pick("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        F.row_number().over(same.orderBy(F.desc("doc_id") if keep == "max" else F.asc_nulls_last("doc_id"))).alias("place"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hot_rows: int = 2000, salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    pick = F.max if keep == "max" else F.min
    found = stored(_dealt(docs.select(id_col, text_col), id_col, text_col, keep, hot_rows, salts).drop("row"), "text-groups")
    # What the salted parts of a text found, added up; other texts have one part each and need no second look.
    salted = found.filter("salt >= 0")
    best = F.struct(F.col("keep_id").isNotNull() if keep == "max" else F.col("keep_id").isNull(), "keep_id", "salt")
    totals = salted.filter("place = 1").groupBy("text_sha256").agg(pick("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"), pick(best)["salt"].alias("all_salt"))
    salted = salted.join(totals, "text_sha256").select("doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"), ((F.col("place") == 1) & (F.col("salt") == F.col("all_salt"))).alias("kept"), "text_sha256")
    return found.filter("salt < 0").select("doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256").unionByName(salted)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hot_rows: int = 2000, salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    first = _dealt(docs, id_col, text_col, keep, hot_rows, salts).filter("place = 1")
    parts = first.filter("salt >= 0")  # one row for each text and salt
    order = F.desc("doc_id") if keep == "max" else F.asc_nulls_last("doc_id")
    parts = parts.withColumn("of_parts", F.row_number().over(Window.partitionBy("text_sha256").orderBy(order, "salt"))).filter("of_parts = 1")
    return first.filter("salt < 0").select("row.*").unionByName(parts.select("row.*"))
