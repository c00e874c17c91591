"""Whitening of embeddings by a weighted multiplicity covariance.

Components c become long integers x = floor(1024 * c) + 100000. Identical x vectors are grouped first (counts are combined
before the shuffle); everything after that works on distinct vectors with a weight, which is the number of their rows
(``weights="count"``, so the fit list is all rows) or one (``weights="one"``: every distinct vector once). Sums are exact
integers; each vector is centred before it is multiplied: a task adds up the weighted product of the matrix of its batches
with itself, and Spark adds up the parts. The eigenvectors of that matrix, whose size depends on the dimensions alone, are
found on the driver. Every distinct vector is whitened once, and rows take the result of their group: a group with more
than one row in 1,000 is told to every task, others are joined by a shuffle.

Vectors that are null or hold null or non-finite entries take no part, nor do empty ones and those of another length than
most. Rows of one id, or without one, are rows of their own. Components beyond +-2**43 (x beyond +-2**53) count as that. A
component without variance (its eigenvalue is below 1e-12 of the trace) cannot be scaled: ``whitened`` is 0 there, and
``identity_error`` leaves it out. ``deviation`` is null where it does not fit into a long. There are as many components
as dimensions, ``k`` at most. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkmoot.llm._common import joined_by_group, stored, workspace

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 43)
NO_VARIANCE = 1e-12


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).filter(F.size("c") > 0)
    v = v.filter(F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    usual = v.groupBy(F.size("c").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()
    v = v.filter(F.size("c") == (usual["dim"] if usual else 0))
    bounded = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    return v.select("vec_id", F.transform("c", lambda c: F.floor(SCALE * bounded(c)).cast("long") + SHIFT).alias("x"))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Sums of w * x by column, as whole numbers of any size; halves of x are added apart, so no sum overflows."""
    high, low = x >> 27, x & ((1 << 27) - 1)
    out = [0] * x.shape[1]
    step = 1 << 8
    for a in range(0, len(x), step):  # 2**8 rows of weight below 2**28 at a time; larger weights are added as whole numbers
        part = w[a : a + step]
        if part.max() < 1 << 28:
            h, s = part @ high[a : a + step], part @ low[a : a + step]
            out = [o + (int(i) << 27) + int(j) for o, i, j in zip(out, h, s)]
        else:
            for row, weight in zip(x[a : a + step].tolist(), part.tolist()):
                out = [o + weight * v for o, v in zip(out, row)]
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for b in batches:
        if b.num_rows:
            own = exact_sums(matrix(b, "x"), b.column("weight").to_numpy())
            total = [p + q for p, q in zip(total, own)] if total else own
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["dim", "s"])


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S in 64 bits; what does not fit wraps, and is told by ``_centred``."""
    wrap = np.array([v & ((1 << 64) - 1) for v in s], np.uint64).view(np.int64)
    with np.errstate(over="ignore"):
        return x * np.int64(n) - wrap


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - S / n, from the exact difference n * x - S where that fits into 64 bits."""
    rough = x.astype(np.float64) - np.array([v / n for v in s])
    fits = np.abs(rough) * n < 2.0**62
    return np.where(fits, _deviations(x, n, s) / n, rough)


def _squares(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n * x - S)**2. Wrapped sums are right wherever the true one is below 2**63."""
    size = ((_centred(x, n, s) * n) ** 2).sum(1)
    with np.errstate(over="ignore"):
        d = _deviations(x, n, s)
        total = (d * d).sum(1)
    out: list[int | None] = [int(t) if z < 2.0**62 else None for t, z in zip(total, size)]
    for i in np.flatnonzero((size >= 2.0**62) & (size < 2.0**64)):
        exact = sum((n * int(v) - m) ** 2 for v, m in zip(x[i], s))
        out[i] = exact if exact < 1 << 63 else None
    return out


def _products(centred):
    """Upper half of the sums of weight * a * b over pairs of columns of ``centred`` (batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = centred(b)
                part = z.T @ (b.column("weight").to_numpy()[:, None] * z)
                total = part if total is None else total + part
        i, j = np.triu_indices(0 if total is None else len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.zeros(0) if total is None else total[i, j])], names=["i", "j", "p"])

    return run


def covariance(groups: DataFrame, centred, dims: int, n: int) -> np.ndarray:
    """A task's part is half a matrix; tasks are as many as run at a time, so the parts are, too."""
    few = groups.select(*[c for c in groups.columns if c in ("x", "z", "weight")]).coalesce(max(1, groups.sparkSession.sparkContext.defaultParallelism))
    out = np.zeros((dims, dims))
    for r in few.mapInArrow(_products(centred), "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # dims**2 rows at most
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["p"] / n
    return out


def _whitened(n: int, s: list[int], axes: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, "x")
            z = (_centred(x, n, s) @ axes) * scale
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("copies"), b.column("weight"), pa.array(_squares(x, n, s), pa.int64()), flat], names=["x", "copies", "weight", "deviation", "z"])

    return run


def whiten(df: DataFrame, k: int = 8, weights: str = "count", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to
    ``k``, from 1 by falling eigenvalue. ``explained`` is the eigenvalue's share of the trace (0 where there is none), and
    ``identity_error`` the largest entry by which the covariance of what comes out misses the identity."""
    if weights not in ("count", "one"):
        raise ValueError("weights are count or one")
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with workspace(spark, "whitening") as folder:
        rows = stored(integer_vectors(df, id_col, vector_col), "vectors", folder)
        counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
        groups = stored(counted.withColumn("weight", F.col("copies") if weights == "count" else F.lit(1).cast("long")), "groups", folder)
        n = groups.agg(F.sum("weight").alias("n")).first()["n"]
        if not n:
            return spark.createDataFrame([], schema)
        sums = groups.select("x", "weight").mapInArrow(_sums, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        s = [int(r["s"]) for r in sorted(sums, key=lambda r: r["dim"])]  # one row for each dimension
        v = covariance(groups, lambda b: _centred(matrix(b, "x"), n, s), len(s), n)
        values, vectors = np.linalg.eigh(v)
        best = np.argsort(-values, kind="stable")[:k]
        values, axes, trace = values[best], vectors[:, best], float(np.trace(v))
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive, so reruns agree
        real = values > NO_VARIANCE * trace
        scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
        done = stored(groups.mapInArrow(_whitened(n, s, axes, scale), "x array<long>, copies long, weight long, deviation long, z array<double>"), "whitened", folder)
        means = np.array(done.agg(*[F.sum(F.col("weight") * F.col("z")[i]) for i in range(len(values))]).first()) / n
        error = np.abs(covariance(done, lambda b: matrix(b, "z") - means, len(values), n) - np.eye(len(values)))[np.ix_(real, real)]
        joined = joined_by_group(rows, done.drop("weight"), ["x"], "copies").select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
        share = F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in values])
        out = joined.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(error.max(initial=0.0))).alias("identity_error"))
        return stored(out, "whitened")
