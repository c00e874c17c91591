"""Writers (inventory 2.A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], directory: str, mode: str = "overwrite") -> None:
    """A7."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{directory.rstrip('/')}/{name}")


def write_csv(df: DataFrame, path: str, max_rows: int = 500) -> None:
    """With header; null is an empty cell, a quote inside of a cell is doubled; at most ``max_rows`` rows."""
    df.limit(max_rows).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A9."""
    df.write.mode("overwrite").json(path)


def mermaid_id(c: Column) -> Column:
    safe = F.regexp_replace(c, r"[^0-9A-Za-z_]+", "_")
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("n_"), safe)).otherwise(safe)


def graph_mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A10: (ord, line) of a left-to-right graph; edges whose ends are no nodes are left out."""
    head = nodes.sparkSession.createDataFrame([("0", "graph LR")], "ord string, line string")
    label = F.regexp_replace(F.coalesce("title", "id"), r'"', "'")
    node_lines = nodes.select(F.concat(F.lit("1"), "id").alias("ord"), F.concat(F.lit("    "), mermaid_id(F.col("id")), F.lit('["'), label, F.lit('"]')).alias("line"))
    known = nodes.select("id")
    e = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    edge_lines = e.select(F.concat_ws("|", F.lit("2"), "source", "target", "relation").alias("ord"), F.concat(F.lit("    "), mermaid_id(F.col("source")), F.lit(" -->|"), F.col("relation"), F.lit("| "), mermaid_id(F.col("target"))).alias("line"))
    return head.unionByName(node_lines).unionByName(edge_lines)


def write_mermaid(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A10 as text files in order."""
    graph_mermaid_lines(nodes, edges).orderBy("ord").select("line").write.mode("overwrite").text(path)
