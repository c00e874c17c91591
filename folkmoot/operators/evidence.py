"""Shaping results as evidence (inventory 2.K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkmoot.functions.columns import best_file_url, looks_like_symbol, nonempty, normalize_symbol, preview


def capped(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """K1: at most n rows, and whether there were more; one row more than n is looked at, never all."""
    more = len(df.select(F.lit(1)).take(n + 1)) > n
    return df.limit(n), more


def stringify(df: DataFrame) -> DataFrame:
    """K2: all columns as strings; null stays null."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def evidence_union(*parts: tuple[str, DataFrame]) -> DataFrame:
    """K3: results of several tools in one table of strings, with their kind; analyses come first."""
    rows = [stringify(df).withColumn("evidence", F.lit(kind)).withColumn("priority", F.lit(0 if kind == "analysis" else 1)) for kind, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def pick_text(df: DataFrame, order: list, n: int | None = 5) -> DataFrame:
    """K4: the first text of body_text, text, doc_metadata.text and title that is not empty; the first n rows."""
    have = [c for c in ("body_text", "text") if c in df.columns]
    texts = [nonempty(F.trim(c)) for c in have]
    if "doc_metadata" in df.columns:
        texts.append(nonempty(F.trim(F.get_json_object("doc_metadata", "$.text"))))
    if "title" in df.columns:
        texts.append(nonempty(F.trim("title")))
    rows = df.withColumn("picked", F.coalesce(*texts)).filter("picked is not null")
    return rows if n is None else rows.orderBy(*order).limit(n)


def evidence_text(df: DataFrame, order: list, n: int | None = 100) -> DataFrame:
    """K5: (line): ``column: value`` of the cells that hold something, long values cut in the middle."""
    cells = [F.when(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) != "", F.concat(F.lit(f"{c}: "), preview(F.col(f"`{c}`").cast("string"), 0, "middle"))) for c in df.columns]
    rows = df if n is None else df.orderBy(*order).limit(n)
    return rows.select(F.concat_ws("\n", *cells).alias("line"))


def source_links(df: DataFrame, docs: DataFrame) -> DataFrame:
    """K6: (symbol, url): distinct symbols in columns named after symbols or documents, with the best link of each."""
    columns = [c for c in df.columns if "symbol" in c.lower() or "document" in c.lower()]
    cells = df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("symbol"))
    symbols = cells.filter(looks_like_symbol(F.col("symbol"))).select(normalize_symbol(F.col("symbol"), "ui").alias("symbol")).distinct()
    return symbols.join(docs.select("symbol", "files"), "symbol", "left").select("symbol", best_file_url(F.col("files"), F.col("symbol")).alias("url"))
