"""A corpus pipeline of five operators: language ID, exact dedup, n-gram join, mixing, piece encoding.

Each stage works on all rows that the one before it kept, and all but the last return the columns of ``documents``, in
their order and under their names, whatever further columns there are. Rows that share a doc_id, or have none, are told
apart by their text and source, so each stays, goes or repeats on its own. Null texts count as empty; an empty table
goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkmoot.llm import exact_dedup, lang_id, mixing, ngram_join, piece_sampling
from folkmoot.llm._common import stored, table
from folkmoot.llm.queries import PIECE_MODEL, tokenizer_path


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, source, row_key): rows whole, and a key of doc_id, source and text. Rows of one key are alike to
    all stages."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.select("row", "row.doc_id", "row.text", "row.source")
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("source", F.col("source").isNull())), F.hex(F.xxhash64("text", F.col("text").isNull()))]
    return rows.withColumn("row_key", F.concat_ws("/", *parts))


def numbered(rows: DataFrame) -> DataFrame:
    """With the place of a row among those of its row_key, by all of its columns."""
    return rows.withColumn("alike", F.row_number().over(Window.partitionBy("row_key").orderBy(F.xxhash64("row"))))


def chosen(rows: DataFrame, keys: DataFrame, condition: Column) -> DataFrame:
    """Rows joined to what is known of their keys: as many keys as rows, so by a shuffle at any size."""
    return numbered(rows.select("row", "row_key")).join(keys.hint("merge"), "row_key").filter(condition)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model trained on the labelled ones is sure of."""
    model = lang_id.fit(docs)
    told = lang_id.identify(F.col("text"), model)
    return docs.filter(~told["rejected"])


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity of 0.8 or more, the one with the smallest doc_id."""
    rows = keyed(docs)
    classes = ngram_join.ngram_join(rows.select("doc_id", "text", "row_key"), key_col="row_key")
    first = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("row_key"))
    # More than one only for rows without shingles: each of them is a class of its own.
    first = first.groupBy("row_key").agg(F.count(F.lit(1)).alias("stay"))
    return chosen(rows, first, F.col("alike") <= F.col("stay")).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = keyed(docs)
    # Rows of one source take two numbers of copies at most, so these say all of the rows of one key.
    taken = mixing.mix(rows.select("doc_id", "text", "source", "row_key"), key_col="row_key").groupBy("row_key", "copies").agg(F.count(F.lit(1)).alias("n"))
    taken = taken.groupBy("row_key").agg(F.max(F.struct("copies", "n")).alias("most"), F.min("copies").alias("least"))
    times = F.when(F.col("alike") <= F.col("most.n"), F.col("most.copies")).otherwise(F.col("least")).cast("int")
    return chosen(rows, taken, times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document: doc_id, piece_ids, n_pieces, ids_crc32, lossless."""
    return piece_sampling.encode_pieces(docs, tokenizer_path(PIECE_MODEL))


STAGES = [("language", language), ("copies", copies), ("near_copies", near_copies), ("mixture", mixture), ("pieces", pieces)]
ORACLE_SQL = None  # trained models and sampling stand between the tables and the rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
