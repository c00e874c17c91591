"""A stored index for vector look-ups: an inverted file of cells (inventory I1 to I3).

Centroids are fitted once, by MLlib's k-means for cosine distance on a bounded sample of the rows (``sample_rows``, a
parameter). Every row goes to the cell of its nearest centroid, and the vectors are written as Parquet partitioned by cell,
so a look-up reads the folders of its cells only. Of each cell the index knows the centroid, the number of rows, and the
radius: the largest angle between the centroid and a row.

Two ways to look up. Exact: no row of a cell is nearer to a query than the angle to the centroid less the radius, so cells
that cannot reach ``min_similarity`` are left out, and all others are read. Approximate: the ``probes`` nearest cells of
each query are read; how many are needed for ``target_recall`` of the true neighbours is measured on rows of the table.
What is read is compared exactly in both. Cells are dealt to shares of about as many rows, and a query goes to a share once,
with the cells that it asks for there; a row goes to each block of the queries of its share.

Vectors that are null, empty, zero, hold null or non-finite entries, or have another length than most take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folkmoot._store import delete_at_end, kept, shared_folder
from folkmoot.operators.vectors import _best_of_blocks, semantic_search_batch

MOST_CELLS = 4096
ROWS_IN_SHARE = 32_768
SHARES = 32  # of smaller tables
QUERIES_IN_BLOCK = 8192
ASKED_AT_ONCE = 65_536  # cells of some queries
SLACK = 1e-6  # of angles


def usable(df: DataFrame, id_col: str, vector: str, dim: int | None = None) -> DataFrame:
    """(id, v) of the rows that take part; of ``dim`` dimensions, or as many as most have."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    v = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    if dim is None:
        usual = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = usual["dim"] if usual else 0
    return v.filter(F.size("v") == dim)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(centroids: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = _unit(f["v"].tolist()) @ centroids.T
                cell = near.argmax(1)
                yield f.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(f)), cell], -1, 1)))

    return run


@dataclass
class Cells:
    """An index: rows (id, v, cell) below ``path``, and of each cell its centroid, radius and number of rows."""

    path: str
    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    probes: int

    def angles(self, queries: list) -> np.ndarray:
        return np.arccos(np.clip(_unit(queries) @ self.centroids.T, -1, 1))

    def reaching(self, query: list[float], min_similarity: float) -> list[int]:
        """The cells that may hold a row of at least this similarity to a query."""
        most = math.acos(max(-1.0, min(1.0, min_similarity)))
        return np.flatnonzero((self.angles([query])[0] - self.radius <= most + SLACK) & (self.counts > 0)).tolist()

    def near(self, query: list[float], min_similarity: float | None = None, probes: int | None = None) -> DataFrame:
        """(id, v, cell) of the cells of a query: exact for a ``min_similarity``, else the ``probes`` nearest ones."""
        if min_similarity is not None:
            cells = self.reaching(query, min_similarity)
        else:
            cells = np.argsort(self.angles([query])[0], kind="stable")[: probes or self.probes].tolist()
        return self.rows.filter(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, query_id: str = "query_id", query_vector: str = "query_vector", k: int = 10, min_similarity: float = -1.0, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, rank, id, similarity) as ``semantic_search_batch`` gives them, from the cells of each query alone."""
        first, many = _shares(self.counts)
        queries = kept(usable(queries, query_id, query_vector, self.centroids.shape[1]), "asked")
        asked = queries.mapInArrow(_asked(self, min_similarity, probes or self.probes, exact, first, many), "id long, v array<double>, share int, cells array<int>")
        told = asked.select("share", F.posexplode("cells").alias("pos", "cell")).groupBy("share", "cell").agg(F.count_if(F.col("pos") == 0).alias("queries")).collect()  # as many as there are cells and shares
        of_share = np.zeros(int((first + many).max()), np.int64)
        for r in told:
            of_share[r["share"]] += r["queries"]
        listed = lambda x: F.array(*[F.lit(int(n)) for n in x])
        blocks = listed(np.maximum(1, -(-of_share // QUERIES_IN_BLOCK)))[F.col("share")]
        share = listed(first)[F.col("cell")] + F.pmod(F.xxhash64("id"), listed(many)[F.col("cell")]).cast("int")
        met = self.rows.filter(F.col("cell").isin(list({r["cell"] for r in told}))).withColumn("share", share)
        met = met.select(F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "share", F.lit(False).alias("is_query"), "cell", "id", F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("array<int>").alias("cells"))
        met = met.unionByName(asked.select(F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "share", F.lit(True).alias("is_query"), F.lit(-1).alias("cell"), "id", "v", "cells"))
        dealt = met.repartition("block", "share").sortWithinPartitions("block", "share", F.desc("is_query"), "cell")
        found = dealt.mapInArrow(_best_of_blocks(k, min_similarity), "query_id long, id long, similarity double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity"))


def _shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its first share and how many it has: cells next to each other have one together, a large one has several."""
    most = min(ROWS_IN_SHARE, max(1, -(-int(counts.sum()) // SHARES)))
    first, many = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // most))
    at, held = 0, 0
    for cell, n in enumerate(counts):
        if held and held + n > most:
            at, held = at + 1, 0
        first[cell], held = at, held + n
        if many[cell] > 1:
            at, held = at + many[cell], 0
    return first, many


def _asked(index: Cells, min_similarity: float, probes: int, exact: bool, first: np.ndarray, many: np.ndarray):
    """A query once a share, with the cells of the share that it asks for."""
    centroids, radius, counts = index.centroids, index.radius, index.counts
    most = math.acos(max(-1.0, min(1.0, min_similarity)))
    some = max(1, ASKED_AT_ONCE // int(many.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(0, batch.num_rows, some):
                part = batch.slice(p, some)
                v = part.column("v")
                angles = np.arccos(np.clip(_unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)) @ centroids.T, -1, 1))
                if exact:
                    row, cell = np.nonzero((angles - radius <= most + SLACK) & (counts > 0))
                else:
                    cell = np.argsort(angles, axis=1, kind="stable")[:, :probes].ravel()
                    row = np.repeat(np.arange(len(v)), len(cell) // len(v))
                times = many[cell]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                share = first[cell] + nth
                order = np.lexsort((cell, share, row))
                row, share, cell = row[order], share[order], cell[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (share[1:] != share[:-1])]) if len(row) else np.zeros(0, np.int64)
                cells = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row[new])), v.take(pa.array(row[new])), pa.array(share[new], pa.int32()), cells], names=["id", "v", "share", "cells"])

    return run


def build(df: DataFrame, id_col: str, vector: str, cells: int | None = None, sample_rows: int = 65_536, target_recall: float = 0.95, k: int = 10, measured: int = 128, seed: int = 5) -> Cells | None:
    """Written to the shared folder; nothing where no row takes part. There are about as many cells as the root of the rows."""
    spark = df.sparkSession
    v = kept(usable(df, id_col, vector), "vectors")
    n = v.count()
    if not n:
        return None
    sample = v.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows) if n > sample_rows else v
    wanted = min(cells or math.isqrt(n), MOST_CELLS, n)
    ready = kept(sample.select(array_to_vector("v").alias("features")), "sample")
    if wanted > 1:
        model = KMeans(k=wanted, distanceMeasure="cosine", maxIter=10, seed=seed).fit(ready)
        centroids = _unit([c.tolist() for c in model.clusterCenters()])
    else:
        centroids = _unit([r["features"].toArray().tolist() for r in ready.limit(1).collect()])
    placed = kept(v.mapInPandas(_placed(centroids), "id long, v array<double>, cell int, angle double"), "placed")
    radius, counts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        radius[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    kind = dict(df.dtypes)[vector]
    path = f"{shared_folder(spark)}/cells-{np.random.default_rng().integers(1 << 62):x}"
    laid = placed.select("id", F.col("v").cast(kind if kind.startswith("array") else "array<double>").alias("v"), "cell")
    laid.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(path)  # a full cell is several tasks
    delete_at_end(spark, path)
    index = Cells(path, spark.read.schema(f"id long, v {kind}, cell int").parquet(path), centroids, radius, counts, len(centroids))
    index.probes = _needed(index, placed, k, measured, target_recall, seed)
    return index


def _needed(index: Cells, placed: DataFrame, k: int, measured: int, target_recall: float, seed: int) -> int:
    """Cells that hold ``target_recall`` of the true neighbours of some rows, in the order in which they are read."""
    queries = kept(placed.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(measured).select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")), "measured")
    near = semantic_search_batch(placed, queries, "id", "v", k=k).join(placed.select("id", "cell"), "id").select("query_id", "cell").collect()  # measured * k rows
    if not near:
        return 1
    asked = {r["query_id"]: r["query_vector"] for r in queries.collect()}
    place = {q: np.argsort(np.argsort(a, kind="stable"), kind="stable") for q, a in zip(asked, index.angles(list(asked.values())))}
    return int(np.quantile([place[r["query_id"]][r["cell"]] + 1 for r in near], target_recall, method="higher"))
