"""Approximate nearest neighbours with a forest of random-projection trees.

``fit_forest`` splits a bounded sample (``sample_rows`` vectors, at most) at the median of its projection on a random
direction, again and again, once per tree; all nodes of a level share its direction, so a row takes ``depth`` products a
tree. Every row of the table is then told its leaf in each tree. A query walks all trees at once through one priority
queue, nearest cells first (by the squared distances to the split planes that part it from them), until the leaves it
has reached hold enough rows. The rows of these leaves are its candidates, whose exact distances decide.

Each vector is stored once and shuffled once, to the node of the first tree that holds about ``BLOCK_ROWS`` rows. What
leaves of all trees the rows of a node lie in is told to every query (a word of 64 cells for a node and tree); a query goes
to the nodes that have rows in cells it has reached, and there meets those rows only that lie in a reached leaf.

How many rows are enough is measured, not set: for ``probes`` rows of the table the exact neighbours among all rows are
found in one pass, and the walk goes on as far as ``target_recall`` of them need. So the share that a search reaches
falls as the data have more structure or more rows, at every size by the same rule.

A leaf holds about ``LEAF_ROWS`` rows until the trees are ``MOST_DEPTH`` deep (8 million rows); the model and the counts of
leaves stay small enough to send to every task. A node with many rows, for instance copies of one vector, is dealt over
several blocks, so a task holds one block of rows and one of queries.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Rows of
one id count as one candidate at its nearest vector, in every block and over all of them. A query never finds its own
id. Rows are dealt by their place, so an id with very many rows is split, too. A query that finds fewer than k candidates
meets all rows. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StructField, StructType

from folkmoot.llm._common import stored, workspace

BLOCK_ROWS = 4096
LEAF_ROWS = 512
LEAST_DEPTH, MOST_DEPTH = 4, 14
CELLS = 6  # levels of a tree that a word of 64 bits tells apart
SAMPLE_VALUES = 8_000_000  # components of the sample, at most
BUFFERED = 200_000  # found pairs that a task holds before it keeps the best of each query


class Tree:
    """Node k of level n splits at ``direction[n] . x <= cut[k]`` into 2k+1 and 2k+2; the last level's nodes are the leaves."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth, self.inner = depth, (1 << depth) - 1
        self.direction = rng.standard_normal((depth, sample.shape[1]))
        self.direction /= np.linalg.norm(self.direction, axis=1, keepdims=True)
        self.cut = np.zeros(self.inner)
        along = sample @ self.direction.T
        members = [np.arange(len(sample))]
        for level in range(depth):
            below = []
            for k, own in enumerate(members, (1 << level) - 1):
                values = along[own, level]
                self.cut[k] = np.median(values) if len(own) else 0.0
                left = values <= self.cut[k]
                below += [own[left], own[~left]]
            members = below

    def leaves(self, x: np.ndarray) -> np.ndarray:
        along, at = x @ self.direction.T, np.zeros(len(x), np.int64)
        for level in range(self.depth):
            at = 2 * at + 1 + (along[:, level] > self.cut[at])
        return at - self.inner


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree(sample, depth, rng) for _ in range(trees)]


def search(forest: list[Tree], x: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order of one shared queue over all trees, until their rows are enough. A cell's place in
    the queue is the sum of squares of the distances to the planes that part it from the query."""
    along = [(t.direction @ x).tolist() for t in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    reached, seen = [], 0
    while queue and seen < enough:
        far, t, k = heapq.heappop(queue)
        inner, cut = forest[t].inner, forest[t].cut
        while k < inner:  # down to the nearest leaf; the other sides wait in the queue
            margin = along[t][(k + 1).bit_length() - 1] - float(cut[k])
            right = margin > 0
            heapq.heappush(queue, (far + margin**2, t, 2 * k + 1 + (not right)))
            k = 2 * k + 1 + right
        reached.append((t, k - inner))
        seen += int(counts[t, k - inner])
    return reached


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(vec_id, x) of the rows that take part, their number and their length; x stays single precision where it is."""
    single = isinstance(df.schema[vector_col].dataType.elementType, FloatType)
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("x", lambda c: c != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    usual = v.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    n, dim = (usual["n"], usual["dim"]) if usual else (0, 0)
    return v.filter(F.size("x") == dim), n, dim


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _route(forest: list[Tree]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _matrix(f["x"])
                yield f.assign(leaves=list(np.stack([t.leaves(x) for t in forest], 1).astype(np.int32)))

    return run


def _reach(forest: list[Tree], counts: np.ndarray, enough: int, nodes: np.ndarray, cells: np.ndarray, shift: int):
    """Queries with the nodes they go to and a bit for each leaf they reach, all trees in turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bits, go = [], []
            for x in f["x"]:
                tree, leaf = np.array(search(forest, np.array(x, np.float64), counts, enough), np.int64).reshape(-1, 2).T
                reached = np.zeros(counts.shape, bool)
                reached[tree, leaf] = True
                words = np.zeros(len(forest), np.uint64)
                np.bitwise_or.at(words, tree, np.uint64(1) << (leaf >> shift).astype(np.uint64))
                bits.append(np.packbits(reached).tobytes())
                go.append(nodes[(cells & words).any(1)])
            yield pd.DataFrame({"vec_id": f["vec_id"], "x": f["x"], "reached": bits, "nodes": go})

    return run


def _best(f: pd.DataFrame, k: int) -> pd.DataFrame:
    f = f.sort_values(["query_id", "score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
    return f[f.groupby("query_id").cumcount() < k]


def _nearest_of(who: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows, one row an id, without the query's own."""
    other = ids != who
    ids, score = ids[other], np.sqrt(((x[other] - q) ** 2).sum(1))
    if len(np.unique(ids)) == len(ids) > k:
        some = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])  # with all ties
        ids, score = ids[some], score[some]
    order = np.lexsort((ids, score))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]  # of rows of one id the nearest
    return ids[order], score[order]


def _measure(trees: int, width: int, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come in order of key, a block's rows before its queries."""
        at, rows, queries = None, [], []
        kept: list[pd.DataFrame] = []

        def flush() -> None:
            if rows and queries:
                ids, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
                leaf = np.array([r[2] for r in rows], np.int64) + width * np.arange(trees)
                for who, one, bits in queries:
                    reached = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[leaf].any(1)
                    if reached.any():
                        near, score = _nearest_of(who, np.array(one, np.float64), ids[reached], x[reached], k)
                        kept.append(pd.DataFrame({"query_id": who, "vec_id": near, "score": score}))
            queries.clear()

        for f in frames:
            for key, vec_id, x, leaves, bits in zip(zip(f["node"], f["block"]), f["vec_id"], f["x"], f["leaves"], f["reached"]):
                if key != at:
                    flush()
                    at, rows = key, []
                if bits is None:
                    rows.append((vec_id, x, leaves))
                else:
                    queries.append((vec_id, x, bits))
                    if len(queries) >= BLOCK_ROWS:
                        flush()
            if sum(map(len, kept)) > BUFFERED:
                kept = [_best(pd.concat(kept), k)]
                if len(kept[0]) > BUFFERED // 2:
                    yield kept.pop()
        flush()
        if kept:
            yield _best(pd.concat(kept), k)

    return run


def _exact(trees: int, ids: np.ndarray, probes: np.ndarray, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k nearest rows of each probe in this task, as their leaves."""
        score, leaves = np.zeros((len(ids), 0)), np.zeros((len(ids), 0, trees), np.int32)
        own = (probes**2).sum(1)
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["x"])
            d = own[:, None] - 2 * probes @ x.T + (x**2).sum(1)
            d[ids[:, None] == f["vec_id"].to_numpy()[None, :]] = np.inf
            of = np.broadcast_to(np.array(f["leaves"].tolist(), np.int32), (len(ids), len(x), trees))
            some = np.argpartition(d, k, axis=1)[:, :k] if len(x) > k else np.broadcast_to(np.arange(len(x)), d.shape)
            score = np.concatenate([score, np.take_along_axis(d, some, 1)], 1)
            leaves = np.concatenate([leaves, np.take_along_axis(of, some[:, :, None], 1)], 1)
            best = np.argsort(score, axis=1, kind="stable")[:, :k]
            score, leaves = np.take_along_axis(score, best, 1), np.take_along_axis(leaves, best[:, :, None], 1)
        which, rank = np.nonzero(np.isfinite(score))
        yield pd.DataFrame({"probe": which, "score": score[which, rank], "leaves": list(leaves[which, rank])})

    return run


def enough_rows(v: DataFrame, forest: list[Tree], counts: np.ndarray, k: int, probes: int, target_recall: float, seed: int) -> int:
    """Rows (counted once for every tree) that a walk has to reach for ``target_recall`` of the exact neighbours of
    ``probes`` rows. The driver gets k rows a probe."""
    picked = _picked(v, int(counts[0].sum()), probes, seed + 1).select("vec_id", "x").collect()
    ids, x = np.array([r["vec_id"] for r in picked]), np.array([r["x"] for r in picked], np.float64)
    found = v.select("vec_id", "x", "leaves").mapInPandas(_exact(len(forest), ids, x, k), "probe int, score double, leaves array<int>")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "leaves"))
    near: dict[int, list[list[int]]] = {}
    for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).collect():
        near.setdefault(r["probe"], []).append(r["leaves"])
    needs = []
    for p, neighbours in near.items():
        walk = search(forest, x[p], counts, int(counts.sum()) + 1)
        reached = dict(zip(walk, np.cumsum([counts[leaf] for leaf in walk])))
        needs += [min(int(reached[t, leaf]) for t, leaf in enumerate(own)) for own in neighbours]
    return int(np.quantile(needs, target_recall, method="higher")) if needs else int(counts.sum())


def nearest(df: DataFrame, is_query, k: int = 10, trees: int = 8, target_recall: float = 0.97, probes: int = 128, sample_rows: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by Euclidean distance, ties to the smaller id.

    ``is_query`` makes a condition of the id column.
    """
    with workspace(df.sparkSession, "forest") as folder:
        return stored(_nearest(*usable(df, id_col, vector_col), is_query, k, trees, target_recall, probes, sample_rows, seed, folder), "nearest")


def _picked(v: DataFrame, n: int, rows: int, seed: int) -> DataFrame:
    """That many of the n rows, by hash: about twice as many are looked at, so partitions do not send a full sample each."""
    place = F.xxhash64("vec_id", "x", F.lit(seed))
    share = F.pmod(place, F.lit(1 << 32)) < F.lit(min(1 << 32, (2 * rows + 64 << 32) // max(n, 1)))
    return v.filter(share).orderBy(place, "vec_id").limit(rows)


def _nearest(v: DataFrame, n: int, dim: int, is_query, k: int, trees: int, target_recall: float, probes: int, sample_rows: int, seed: int, folder: str) -> DataFrame:
    if not n:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _picked(v, n, max(1, min(sample_rows, SAMPLE_VALUES // dim)), seed).select("x").toArrow().column("x").combine_chunks()
    depth = min(MOST_DEPTH, max(LEAST_DEPTH, math.ceil(math.log2(n / LEAF_ROWS))))
    forest = fit_forest(sample.flatten().to_numpy().astype(np.float64).reshape(-1, dim), trees, depth, seed)
    routed = v.mapInPandas(_route(forest), StructType([*v.schema.fields, StructField("leaves", ArrayType(IntegerType()))]))
    routed = stored(routed.withColumn("place", F.monotonically_increasing_id()), "leaves", folder)
    counts = np.zeros((trees, 1 << depth), np.int64)
    for r in routed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # trees * 2**depth rows at most
        counts[r["tree"], r["leaf"]] = r["count"]
    enough = enough_rows(routed, forest, counts, k, probes, target_recall, seed)
    # Nodes of the first tree with about BLOCK_ROWS rows, and the cells of every tree that their rows lie in.
    level = min(depth, max(0, math.ceil(math.log2(n / BLOCK_ROWS))))
    routed = routed.withColumn("node", F.shiftright(F.col("leaves")[0], depth - level))
    shift = max(0, depth - CELLS)
    cells = [F.expr(f"bit_or(shiftleft(1L, shiftright(leaves[{t}], {shift})))").alias(f"c{t}") for t in range(trees)]
    nodes = routed.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), *cells).toPandas()  # 2**level rows at most
    model = (forest, counts, nodes, shift)
    queries = routed.filter(is_query(F.col("vec_id")))
    found = stored(_search_rows(routed, queries, model, enough, k), "found", folder)
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    # Few candidates, or many rows of few ids: these queries meet all rows.
    rest = _search_rows(routed, short, model, int(counts.sum()), k)
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(rest)


def _search_rows(routed: DataFrame, queries: DataFrame, model: tuple, enough: int, k: int) -> DataFrame:
    forest, counts, nodes, shift = model
    cells = nodes[[f"c{t}" for t in range(len(forest))]].to_numpy().astype(np.int64).view(np.uint64)
    x = routed.schema["x"]
    reached = queries.select("vec_id", "x").mapInPandas(_reach(forest, counts, enough, nodes["node"].to_numpy(), cells, shift), StructType([StructField("vec_id", LongType()), x, StructField("reached", BinaryType()), StructField("nodes", ArrayType(IntegerType()))]))
    sizes = [(int(node), -(-int(rows) // BLOCK_ROWS)) for node, rows in zip(nodes["node"], nodes["rows"])]
    blocks = F.broadcast(routed.sparkSession.createDataFrame(sizes, "node int, blocks int"))
    rows = routed.join(blocks, "node").select("node", F.pmod(F.xxhash64("place"), "blocks").cast("int").alias("block"), "vec_id", "x", "leaves", F.lit(None).cast("binary").alias("reached"))
    asked = reached.select("vec_id", "x", "reached", F.explode("nodes").alias("node")).join(blocks, "node")
    asked = asked.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "x", F.lit(None).cast("array<int>").alias("leaves"), "reached")
    met = rows.unionByName(asked).repartition("node", "block").sortWithinPartitions("node", "block", F.col("reached").isNotNull(), "vec_id")
    found = met.mapInPandas(_measure(len(forest), counts.shape[1], k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
