"""Coalitions of actors by the correlation of their votes (inventory 2.H).

Sums of products over all pairs of actors are a matrix product of the votes with themselves. It is taken in blocks of
actors: a task adds up one square of the matrix over the documents of its share, so no pair of votes becomes a row, and a
document on which everybody votes is no heavier than its votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot._store import kept
from folkmoot.operators.scans import row_number

ACTORS_IN_BLOCK = 512
FEW_BLOCKS = 64  # beyond as many, blocks are four times as large
SCORES_IN_PACK = 65_536  # of one block and one chunk of documents, about
PAIRS_A_SCORE, WIDEST = 16, 1024  # up to these, pairs are counted by document
SHARES = 32  # of the documents of one square, at most
BROADCAST_SQUARES = 100_000


def vote_scores(votes: DataFrame, order: Column) -> DataFrame:
    """H1: (actor_id, document_id, score): the first vote of a cell in ``order``; 1, -1, or 0 for anything else."""
    first = votes.filter("document_id is not null").groupBy("actor_id", "document_id").agg(F.min_by("vote_type", order).alias("v"))
    return first.select("actor_id", "document_id", F.when(F.col("v") == "in_favour", 1).when(F.col("v") == "against", -1).otherwise(0).alias("score"))


def _product(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(actors of side 0, actors of side 1, sums of products of their scores) over whole documents.

    Documents with few votes add up their pairs by place in the square; where there are many, matrices are multiplied.
    """
    side, doc, actor, score = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("side", "document", "actor_id", "score"))
    _, doc = np.unique(doc, return_inverse=True)
    docs = int(doc.max()) + 1
    names, columns, at, scores = [], [], [], []
    for k in (0, 1):
        own = np.flatnonzero(side == k)
        own = own[np.argsort(doc[own], kind="stable")]
        known, column = np.unique(actor[own], return_inverse=True)
        names.append(known)
        columns.append(column)
        at.append(doc[own])
        scores.append(score[own].astype(np.int64))
    shape = (len(names[0]), len(names[1]))
    many = np.bincount(at[1], minlength=docs)
    met = many[at[0]]  # votes of side 1 that each of side 0 meets
    if int(met.sum()) < docs * shape[0] * shape[1] // 64:
        first = np.repeat(np.arange(len(met)), met)
        ends = np.cumsum(met)
        second = np.arange(len(first)) - np.repeat(ends - met, met) + np.repeat((np.cumsum(many) - many)[at[0]], met)
        sums = np.bincount(columns[0][first] * shape[1] + columns[1][second], weights=scores[0][first] * scores[1][second], minlength=shape[0] * shape[1])
        return names[0], names[1], sums.astype(np.int64).reshape(shape)
    matrices = []
    for k in (0, 1):
        matrix = np.zeros((docs, shape[k]), np.float32)
        matrix[at[k], columns[k]] = scores[k]
        matrices.append(matrix)
    return names[0], names[1], (matrices[0].T @ matrices[1]).astype(np.int64)


class _Square:
    """Sums of products of one square of the matrix, with the actors of its rows and columns."""

    def __init__(self, key: tuple[int, ...]):
        self.key = key
        self.names = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.sums = np.zeros((0, 0), np.int64)

    def add(self, rows: list[pa.RecordBatch]) -> None:
        *actors, p = _product(rows)
        names = [np.union1d(old, new) for old, new in zip(self.names, actors)]
        at = lambda some: np.ix_(*[np.searchsorted(n, s) for n, s in zip(names, some)])
        sums = np.zeros((len(names[0]), len(names[1])), np.int64)
        sums[at(self.names)] = self.sums
        sums[at(actors)] += p
        self.names, self.sums = names, sums

    def told(self) -> pa.RecordBatch:
        """What is not 0 of the square; of a square of a block with itself, each pair once."""
        i, j = np.nonzero(self.sums)
        a, b, p = self.names[0][i], self.names[1][j], self.sums[i, j]
        if self.key[0] == self.key[1]:
            a, b, p = (x[a < b] for x in (a, b, p))
        return pa.RecordBatch.from_arrays([*[pa.array(np.full(len(p), k), pa.int32()) for k in self.key[:2]], pa.array(a), pa.array(b), pa.array(p)], names=["bi", "bj", "ia", "ib", "p"])


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by square and document; what a batch holds of its last document waits for the next one."""
    square, rest = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bi", "bj", "share")], 1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, z in zip([0, *edges], [*edges, batch.num_rows]):
            if a == z:
                continue
            if square is None or tuple(keys[a]) != square.key:
                if square is not None:
                    square.add(rest)
                    yield square.told()
                square, rest = _Square(tuple(keys[a])), []
            part = batch.slice(a, z - a)
            docs = part.column("document").to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(docs, docs[-1]))  # documents are sorted inside a square
            if rest and docs[0] != rest[-1].column("document")[0].as_py():
                square.add(rest)
                rest = []
            if last:
                square.add([*rest, part.slice(0, last)])
                rest = []
            rest.append(part.slice(last))
    if square is not None:
        square.add(rest)
        yield square.told()


SQUARE_SUMS = "bi int, bj int, ia long, ib long, p long"


def square_sums(scores: DataFrame, blocks: DataFrame, squares: DataFrame, n_squares: int) -> DataFrame:
    """(bi, bj, ia, ib, p): sums over a share of the documents, where they are not 0, for pairs of actors in ``squares``
    (bi, bj). ``blocks`` (actor_id, block) places the actors. There are as many shares as keep all tasks busy."""
    shares = max(1, min(SHARES, -(-scores.sparkSession.sparkContext.defaultParallelism // max(1, n_squares))))
    sent = F.broadcast if n_squares <= BROADCAST_SQUARES else lambda df: df
    x = scores.filter("score <> 0").join(blocks.select("actor_id", "block"), "actor_id")
    x = x.select("block", F.xxhash64("document_id").alias("document"), F.col("actor_id").cast("long").alias("actor_id"), F.col("score").cast("int").alias("score"))
    sides = [x.join(sent(squares.select(F.col(own).alias("block"), *["bi", "bj"])), "block").withColumn("side", F.lit(k)) for k, own in enumerate(("bi", "bj"))]
    rows = sides[0].unionByName(sides[1]).select("bi", "bj", F.pmod("document", F.lit(shares)).cast("int").alias("share"), "document", "side", "actor_id", "score")
    key = ["bi", "bj", "share"]
    return rows.repartition(*key).sortWithinPartitions(*key, "document").mapInArrow(_squares, SQUARE_SUMS)


def in_blocks(actors: DataFrame, order: list[str], size: int | None = None) -> DataFrame:
    """``actors`` with the number of their block and their slot in it, by ``order``."""
    placed = row_number(actors.withColumn("whole", F.lit(0)), ["whole"], order, "place").drop("whole")
    at, size = F.col("place") - 1, F.lit(size or ACTORS_IN_BLOCK)
    return placed.withColumn("block", (at / size).cast("int")).withColumn("slot", (at % size).cast("int")).drop("place")


def every_square(blocks: DataFrame) -> DataFrame:
    """(bi, bj), bi <= bj, of the blocks of ``blocks``."""
    last = F.lit((blocks.agg(F.max("block").alias("last")).first()["last"] or 0))
    return blocks.select(F.col("block").alias("bi")).distinct().withColumn("bj", F.explode(F.sequence("bi", last)))


def score_products(scores: DataFrame) -> DataFrame:
    """(ia, ib, p), ia < ib: sums over documents of the products of two actors' scores, where they are not 0."""
    blocks = kept(in_blocks(scores.filter("score <> 0").select("actor_id").distinct(), ["actor_id"]), "blocks")
    squares = kept(every_square(blocks), "squares")
    sums = square_sums(scores, blocks, squares, squares.count())
    return sums.groupBy(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib")).agg(F.sum("p").alias("p")).filter("p <> 0")


class _Whole:
    """All pairs of one square: its actors, then its sums."""

    def __init__(self, key: tuple[int, int]):
        self.key = key
        self.actors: list[list] = [[], []]  # of each side: arrays of ids, names, sums, and sums of squares
        self.sums = None

    def add(self, side: int, part: pa.RecordBatch) -> None:
        ids, s = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "s"))
        if side < 2:
            self.actors[side].append((ids, part.column("name").to_numpy(zero_copy_only=False), s, part.column("q").to_numpy(zero_copy_only=False)))
            return
        if self.sums is None:
            self.order()
        np.add.at(self.sums, (np.searchsorted(self.sides[0][0], ids), np.searchsorted(self.sides[1][0], part.column("b").to_numpy(zero_copy_only=False))), s)

    def order(self) -> None:
        whole = [[np.concatenate(x) for x in zip(*side)] for side in self.actors]
        self.sides = [[x[np.argsort(side[0])] for x in side] for side in whole]
        self.sums = np.zeros([len(side[0]) for side in self.sides], np.int64)

    def best(self, total: int, min_corr: float, k: int) -> list[tuple]:
        """(a, b, correlation) of the k best pairs above the bound."""
        if self.sums is None:
            self.order()
        (id1, name1, s1, q1), (id2, name2, s2, q2) = self.sides
        spread = [np.sqrt((total * q - s * s).astype(np.float64)) for s, q in ((s1, q1), (s2, q2))]
        corr = (total * self.sums - s1[:, None] * s2[None, :]).astype(np.float64) / (spread[0][:, None] * spread[1][None, :])
        fine = corr > min_corr
        if self.key[0] == self.key[1]:
            fine &= id1[:, None] < id2[None, :]
        i, j = np.nonzero(fine)
        c = corr[i, j]
        if len(c) > k:  # rounded values tie, so all that may round to the k-th stay
            stay = c >= np.partition(c, len(c) - k)[len(c) - k] - 0.002
            i, j, c = i[stay], j[stay], c[stay]
        rounded = {x: Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP) for x in set(c.tolist())}  # as Spark rounds
        ranked = sorted((-rounded[x], *sorted((name1[p], name2[q])), x) for p, q, x in zip(i, j, c.tolist()))
        return [(a, b, x) for _, a, b, x in ranked[:k]]


def _correlated(total: int, min_corr: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by square, the actors of its two sides first."""
        square = None

        def told() -> pa.RecordBatch:
            columns = list(zip(*square.best(total, min_corr, k))) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["a", "b", "c"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bi", "bj", "side")], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for p, q in zip([0, *edges], [*edges, batch.num_rows]):
                if p == q:
                    continue
                bi, bj, side = keys[p].tolist()
                if square is None or square.key != (bi, bj):
                    if square is not None:
                        yield told()
                    square = _Whole((bi, bj))
                square.add(side, batch.slice(p, q - p))
        if square is not None:
            yield told()

    return run


def possible_squares(blocks: DataFrame, total: int, min_corr: float) -> DataFrame:
    """(bi, bj) of squares that may hold a pair above ``min_corr``.

    A product of two scores is not above 0 for more documents than either actor votes on, so a correlation is at most
    n * q1 / (spread1 * spread2), with either's q, less the product of both s / spread. Of each factor the blocks' extremes
    count. Blocks are in the order of q, so each is narrow in it.
    """
    spread = F.sqrt((F.lit(total) * F.col("q") - F.col("s") * F.col("s")).cast("double"))
    tilt = F.col("s") / spread
    of = blocks.groupBy("block").agg(F.max(F.col("q") / spread).alias("most"), F.min(tilt).alias("low"), F.max(tilt).alias("high"), F.min(spread).alias("spread"))
    of = kept(of, "norms")
    side = lambda k: of.select(F.col("block").alias(f"b{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("most", "low", "high", "spread")])
    pairs = every_square(blocks).join(side("i"), "bi").join(side("j"), "bj")
    together = total * F.least(F.col("most_i") / F.col("spread_j"), F.col("most_j") / F.col("spread_i"))
    bound = together - F.least(*[F.col(f"{x}_i") * F.col(f"{y}_j") for x in ("low", "high") for y in ("low", "high")])
    return pairs.filter(bound > min_corr - 1e-9).select("bi", "bj")


PACK = "block int, chunk int, docs binary, counts binary, slots binary, scores binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, chunk and document; each chunk of a block becomes a row."""
    key, parts = None, []

    def told() -> pa.RecordBatch:
        doc, slot, score = (np.concatenate(x) for x in zip(*parts))
        docs, counts = np.unique(doc, return_counts=True)
        values = [key[0], key[1], docs.tobytes(), counts.astype(np.int32).tobytes(), slot.astype(np.int32).tobytes(), score.astype(np.int8).tobytes()]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["block", "chunk", "docs", "counts", "slots", "scores"])

    for batch in batches:
        block, chunk, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "chunk", "document", "slot", "score"))
        edges = np.flatnonzero((block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        for a, z in zip([0, *edges], [*edges, batch.num_rows]):
            if a == z:
                continue
            if key != (block[a], chunk[a]):
                if parts:
                    yield told()
                key, parts = (block[a], chunk[a]), []
            parts.append([c[a:z] for c in columns])
    if parts:
        yield told()


def packed(scores: DataFrame, blocks: DataFrame, chunks: int) -> DataFrame:
    """(block, chunk, docs, counts, slots, scores): the scores of a block's actors, a row for each chunk of documents."""
    document = F.xxhash64("document_id")
    x = scores.filter("score <> 0").join(blocks.select("actor_id", "block", "slot"), "actor_id")
    x = x.select("block", F.pmod(document, F.lit(chunks)).cast("int").alias("chunk"), document.alias("document"), "slot", F.col("score").cast("int").alias("score"))
    return x.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "document", "slot").mapInArrow(_packed, PACK)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    docs, counts, slots, scores = (np.frombuffer(row[c], t) for c, t in (("docs", np.int64), ("counts", np.int32), ("slots", np.int32), ("scores", np.int8)))
    return np.repeat(docs, counts), slots, scores


class _Best:
    """The k best pairs of a task's squares, by rounded correlation and names."""

    def __init__(self, total: int, min_corr: float, k: int):
        self.total, self.min_corr, self.k = total, min_corr, k
        self.pairs: list[tuple] = []

    def add(self, sides: list[dict], sums: np.ndarray, own: bool) -> None:
        """A square's sums, by slots of its two sides; a few rows first, so that what is not among the best is soon known."""
        first, second = sides
        spread = [np.sqrt((self.total * x["q"] - x["s"] * x["s"]).astype(np.float64)) for x in sides]
        edges = [0, *range(16, len(first["s"]), 256), len(first["s"])]
        for a, z in zip(edges, edges[1:]):
            corr = (self.total * sums[a:z].astype(np.int64) - first["s"][a:z, None] * second["s"][None, :]).astype(np.float64) / (spread[0][a:z, None] * spread[1][None, :])
            if own:
                corr[first["ids"][a:z, None] >= second["ids"][None, :]] = -np.inf
            self.take(corr, first["name"][a:z], second["name"])

    def take(self, corr: np.ndarray, names: np.ndarray, others: np.ndarray) -> None:
        if len(self.pairs) < self.k:
            i, j = np.nonzero(corr > self.min_corr)
        else:
            # Better ones, and those that tie once rounded and whose first name does not come later.
            least, name = -float(self.pairs[-1][0]), self.pairs[-1][1]
            fine = corr > least + 0.0006
            for at in (np.flatnonzero(names <= name), (slice(None), np.flatnonzero(others <= name))):
                fine[at] = corr[at] > least - 0.0006
            i, j = np.nonzero(fine & (corr > self.min_corr))
        c = corr[i, j]
        if len(c) > self.k:  # rounded values tie, so all that may round to the k-th stay
            stay = c >= np.partition(c, len(c) - self.k)[len(c) - self.k] - 0.002
            i, j, c = i[stay], j[stay], c[stay]
        if not len(c):
            return
        rounded = {x: Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP) for x in set(c.tolist())}  # as Spark rounds
        found = [(-rounded[x], *sorted((names[p], others[q])), x) for p, q, x in zip(i, j, c.tolist())]
        self.pairs = sorted(self.pairs + found)[: self.k]

    def told(self) -> pa.RecordBatch:
        columns = list(zip(*[p[1:] for p in self.pairs])) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["a", "b", "c"])


def _sums_of(packs: list[dict], shape: tuple[int, int]) -> np.ndarray:
    """Sums of products of one chunk: by matrices, or where documents have few votes by pairs."""
    (d0, a0, s0), (d1, a1, s1) = (_unpacked(p) for p in packs)
    both, first = np.unique(d0, return_inverse=True)
    place = np.searchsorted(both, d1)
    met = (place < len(both)) & (both[np.minimum(place, len(both) - 1)] == d1)
    place, a1, s1 = place[met], a1[met], s1[met]
    many = np.bincount(place, minlength=len(both))  # votes of side 1, which are by document
    per = many[first]
    if int(per.sum()) < len(both) * shape[0] * shape[1] // 64:
        x = np.repeat(np.arange(len(per)), per)
        ends = np.cumsum(per)
        y = np.arange(len(x)) - np.repeat(ends - per, per) + np.repeat((np.cumsum(many) - many)[first], per)
        return np.bincount(a0[x].astype(np.int64) * shape[1] + a1[y], weights=s0[x].astype(np.int64) * s1[y], minlength=shape[0] * shape[1]).reshape(shape)
    matrices = [np.zeros((n, len(both)), np.float32) for n in shape]
    matrices[0][a0, first] = s0
    matrices[1][a1, place] = s1
    return matrices[0] @ matrices[1].T


def _best_of_squares(total: int, min_corr: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by square and chunk, the actors of its sides first; a block's square with itself has one side."""
        best, at, sides, sums, waits = _Best(total, min_corr, k), None, [], None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                square, chunk, side = (row["bi"].as_py(), row["bj"].as_py()), row["chunk"].as_py(), row["side"].as_py()
                own = square[0] == square[1]
                if square != at:
                    if at is not None:
                        best.add(sides, sums, at[0] == at[1])
                    at, sides, sums, waits = square, [], None, None
                if chunk < 0:
                    known = {c: row["actors"].values.field(f).to_numpy(zero_copy_only=False) for c, f in (("ids", "actor_id"), ("s", "s"), ("q", "q"), ("name", "name"))}
                    sides += [known, known] if own else [known]
                    if len(sides) == 2:
                        sums = np.zeros([len(x["s"]) for x in sides])
                    continue
                pack = {c: row[c].as_buffer() for c in ("docs", "counts", "slots", "scores")}
                if own:
                    sums += _sums_of([pack, pack], sums.shape)
                elif side == 0:
                    waits = (chunk, pack)
                elif waits is not None and waits[0] == chunk:
                    sums += _sums_of([waits[1], pack], sums.shape)
        if at is not None:
            best.add(sides, sums, at[0] == at[1])
        yield best.told()

    return run


def best_of_squares(scores: DataFrame, blocks: DataFrame, squares: DataFrame, n_squares: int, total: int, min_corr: float, k: int) -> DataFrame:
    """(a, b, c) of the best pairs of ``squares``, k a task at most. A square's sums and pairs stay in its task."""
    most = blocks.groupBy("block").agg(F.sum("q").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    packs = kept(packed(scores, blocks, max(1, -(-most // SCORES_IN_PACK))), "packs")
    sent = F.broadcast if n_squares <= BROADCAST_SQUARES else lambda df: df
    actors = F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col("actor_id").cast("long").alias("actor_id"), "s", "q", "name"))), lambda a: F.struct(a["actor_id"].alias("actor_id"), a["s"].alias("s"), a["q"].alias("q"), a["name"].alias("name")))
    named = kept(blocks.groupBy("block").agg(actors.alias("actors")).withColumn("chunk", F.lit(-1)), "named")
    rows = packs.unionByName(named, allowMissingColumns=True)
    sides = [rows.join(sent(squares.select(F.col(own).alias("block"), "bi", "bj")), "block").withColumn("side", F.lit(side)) for side, own in enumerate(("bi", "bj"))]
    met = sides[0].unionByName(sides[1].filter("bi <> bj")).drop("block")
    tasks = min(n_squares, max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * scores.sparkSession.sparkContext.defaultParallelism))
    dealt = met.repartition(tasks, "bi", "bj").sortWithinPartitions("bi", "bj", "chunk", "side")
    return dealt.mapInArrow(_best_of_squares(total, min_corr, k), "a string, b string, c double")


def pairs_by_document(scores: DataFrame, actors: DataFrame, total: int, min_corr: float, k: int) -> DataFrame | None:
    """(a, b, c) of the k best pairs, where documents have few votes each: their pairs are counted by document, which grows
    with the votes and not with the square of the actors. Nothing where that is more work than squares.

    Pairs whose products add up to 0, and those without a common document, which are no rows, have the correlation -t1 * t2
    of t = s / spread. Unless the k-th best is above all that these can be, squares have to tell.
    """
    votes = scores.filter("score <> 0").select("document_id", "actor_id", "score")
    m = F.col("m")
    work = votes.groupBy("document_id").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(m).alias("scores"), F.sum(m * (m - 1) / 2).alias("pairs"), F.max(m).alias("widest")).first()
    if not work["scores"] or work["pairs"] > PAIRS_A_SCORE * work["scores"] or work["widest"] > WIDEST:
        return None
    spread = F.sqrt((F.lit(total) * F.col("q") - F.col("s") * F.col("s")).cast("double"))
    told = actors.select("actor_id", "s", "name", spread.alias("spread"))
    t = F.col("s") / F.col("spread")
    low, high = told.agg(F.min(t), F.max(t)).first()
    if low is None:
        return None
    silent = -min(low * low, low * high, high * high)
    x, y = (votes.select("document_id", F.col("actor_id").alias(i), F.col("score").alias(f"score_{i}")) for i in ("ia", "ib"))
    p = x.hint("merge").join(y, "document_id").filter("ia < ib").groupBy("ia", "ib").agg(F.sum(F.col("score_ia") * F.col("score_ib")).cast("long").alias("p")).filter("p <> 0")
    side = lambda i: told.select(F.col("actor_id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("s", "name", "spread")])
    c = (F.lit(total) * F.col("p") - F.col("s_ia") * F.col("s_ib")).cast("double") / (F.col("spread_ia") * F.col("spread_ib"))
    pairs = p.join(side("ia"), "ia").join(side("ib"), "ib").select(F.least("name_ia", "name_ib").alias("a"), F.greatest("name_ia", "name_ib").alias("b"), c.alias("c")).filter(F.col("c") > min_corr)
    best = kept(pairs.orderBy(F.desc(F.round("c", 3)), "a", "b").limit(k), "best")
    if silent <= min_corr - 1e-9:
        return best
    held = best.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).first()
    return best if held["n"] == k and held["least"] > silent + 0.002 else None


def vote_correlation(scores: DataFrame, actors: DataFrame, min_corr: float = 0.7, k: int = 20) -> DataFrame:
    """H2: (a, b, correlation, n_resolutions) of pairs of actors over all resolutions, best first, ties by name.

    A missing vote counts as 0. Actors without variance have no correlation. Sums are exact integers. Where documents have
    few votes each, pairs are counted by document. Else actors are dealt into blocks by the number of their votes; a square
    of two blocks that cannot hold a pair above ``min_corr`` is not multiplied. The task that adds up a square has all of
    its pairs at hand, also those whose products add up to 0, and gives out the k best.
    """
    scores = kept(scores.select("actor_id", "document_id", "score"), "scores")
    n = scores.select("document_id").distinct().count()
    sums = scores.groupBy("actor_id").agg(F.sum("score").cast("long").alias("s"), F.sum(F.col("score") * F.col("score")).cast("long").alias("q"))
    sums = sums.join(actors.select(F.col("id").alias("actor_id"), "name"), "actor_id").filter(F.lit(n) * F.col("q") - F.col("s") * F.col("s") > 0)
    sums = kept(sums, "actors")
    best = pairs_by_document(scores, sums, n, min_corr, k)
    if best is None:
        size = ACTORS_IN_BLOCK * (1 if sums.count() <= FEW_BLOCKS * ACTORS_IN_BLOCK else 4)
        blocks = kept(in_blocks(sums, ["q", "s", "actor_id"], size), "blocks")
        squares = kept(possible_squares(blocks, n, min_corr), "squares")
        n_squares = squares.count()
        few = n_squares < scores.sparkSession.sparkContext.defaultParallelism
        best = (best_of_shares if few else best_of_squares)(scores, blocks, squares, n_squares, n, min_corr, k)
    return best.select("a", "b", F.round("c", 3).alias("correlation"), F.lit(n).alias("n_resolutions")).orderBy(F.desc("correlation"), "a", "b").limit(k)


def best_of_shares(scores: DataFrame, blocks: DataFrame, squares: DataFrame, n_squares: int, total: int, min_corr: float, k: int) -> DataFrame:
    """As ``best_of_squares``, for fewer squares than tasks: sums of a share of the documents are rows, and are added up."""
    sent = F.broadcast if n_squares <= BROADCAST_SQUARES else lambda df: df
    found = square_sums(scores, blocks, squares, n_squares).select("bi", "bj", F.lit(2).alias("side"), F.col("ia").alias("a"), F.col("ib").alias("b"), F.col("p").alias("s"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("string").alias("name"))
    for k_, own in enumerate(("bi", "bj")):
        side = blocks.join(sent(squares.select(F.col(own).alias("block"), "bi", "bj")), "block")
        found = found.unionByName(side.select("bi", "bj", F.lit(k_).alias("side"), F.col("actor_id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "s", "q", "name"))
    met = found.repartition("bi", "bj").sortWithinPartitions("bi", "bj", "side")
    return met.mapInArrow(_correlated(total, min_corr, k), "a string, b string, c double")


def require_resolutions(scores: DataFrame, least: int = 5) -> DataFrame:
    """H3: the scores, or an error that tells how few resolutions they cover."""
    n = scores.select("document_id").distinct().limit(least).count()
    if n < least:
        raise ValueError(f"{least} resolutions are needed, there are {n}")
    return scores
