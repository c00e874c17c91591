"""Exact vector search by cosine similarity (inventory 2.I): one query inside the JVM, many as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.functions.columns import preview


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def semantic_search(df: DataFrame, query: list[float], vector: str, keep: list[str], id_col: str, condition: Column | None = None, min_similarity: float = 0.5, k: int = 10, text: str | None = None) -> DataFrame:
    """Rows most similar to a query vector, ties by id; similarity rounded to 4 places."""
    rows = df if condition is None else df.filter(condition)
    q = F.array(*[F.lit(float(x)) for x in query])
    own = sum(float(x) ** 2 for x in query) ** 0.5
    scored = rows.filter(F.col(vector).isNotNull()).withColumn("similarity", dot(F.col(vector), q) / F.nullif(norm(F.col(vector)) * F.lit(own), F.lit(0.0)))
    shown = [preview(F.col(text), 500).alias(text)] if text else []
    return scored.filter(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), id_col).limit(k).select(*keep, *shown, F.round("similarity", 4).alias("similarity"))


def semantic_search_utterances(utterances: DataFrame, documents: DataFrame, query: list[float], vector: str = "text_embedding", speakers: list[str] | None = None, session: int | None = None, min_similarity: float = 0.5, k: int = 10) -> DataFrame:
    """The utterances most similar to a query vector, with the symbol of their meeting. An affiliation has to hold one
    of ``speakers`` in any case of letters, a meeting to be of the ``session``; none of them, or 0, asks for all."""
    meetings = documents.select(F.col("id").alias("meeting_id"), F.col("symbol").alias("meeting_symbol"), F.col("session").alias("meeting_session"))
    if session:
        meetings = meetings.filter(F.col("meeting_session") == session)
    if speakers:
        utterances = utterances.filter(F.exists(F.array(*[F.lit(f"%{s}%") for s in speakers]), lambda like: F.call_function("like", F.lower("speaker_affiliation"), F.lower(like))))
    found = semantic_search(utterances.join(meetings, "meeting_id"), query, vector, ["id", "speaker_affiliation", "speaker_name", "agenda_item_number", "meeting_symbol"], "id", min_similarity=min_similarity, k=k, text="text")
    return found.withColumnsRenamed({"agenda_item_number": "agenda_item", "text": "text_preview"})


SCORES_AT_ONCE = 2_000_000  # of one product


def _best_of_blocks(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block of queries and share of rows, queries first; a matrix product scores a batch of rows. Where rows
        have a cell, they come by cell, and meet the queries that list it."""
        at, qs, best = None, [], None
        matrix, asking = np.zeros((0, 0)), None
        lists: list[tuple[np.ndarray, np.ndarray]] = []  # (queries, cells)

        def vectors(b: pa.RecordBatch) -> np.ndarray:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            length = np.sqrt((flat**2).sum(1, keepdims=True))
            with np.errstate(invalid="ignore", divide="ignore"):
                return flat / length  # not a number where a vector has no length

        def told() -> Iterator[pa.RecordBatch]:
            if best is not None and len(qs):
                which, rank = np.nonzero(np.isfinite(best[0]))
                yield pa.RecordBatch.from_arrays([pa.array(qs[which], pa.int64()), pa.array(best[1][which, rank], pa.int64()), pa.array(best[0][which, rank])], names=["query_id", "id", "similarity"])

        for batch in batches:
            celled = "cell" in batch.schema.names
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "share", "cell")[: 2 + celled]], 1)
            asks = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *edges], [*edges, batch.num_rows]):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                if tuple(keys[a][:2]) != at:
                    yield from told()
                    at, qs, best, asking, lists = tuple(keys[a][:2]), np.zeros(0, np.int64), None, None, []
                if asks[a]:
                    if celled:
                        cells = part.column("cells")
                        lists.append((np.repeat(np.arange(len(qs), len(qs) + len(ids)), cells.value_lengths().to_numpy(zero_copy_only=False)), cells.flatten().to_numpy(zero_copy_only=False)))
                    matrix = np.concatenate([matrix, vectors(part)]) if len(qs) else vectors(part)
                    qs = np.concatenate([qs, ids])
                    continue
                if not len(qs):
                    continue
                best = (np.full((len(qs), k), -np.inf), np.zeros((len(qs), k), np.int64)) if best is None else best
                who = slice(None)
                if celled:
                    if asking is None:
                        asking = tuple(map(np.concatenate, zip(*lists)))
                        order = np.argsort(asking[1], kind="stable")
                        asking = asking[0][order], asking[1][order]
                    who = asking[0][slice(*np.searchsorted(asking[1], [keys[a][2], keys[a][2] + 1]))]
                    if not len(who):
                        continue
                    who = slice(None) if len(who) == len(qs) else who
                own, asked = matrix[who], qs[who]
                known = best[0][who], best[1][who]
                some = max(k, SCORES_AT_ONCE // len(asked))
                for p in range(0, len(ids), some):
                    known = _better(known, own, asked, vectors(part.slice(p, some)), ids[p : p + some], k, least)
                best[0][who], best[1][who] = known
        yield from told()

    return run


def _better(best: tuple, matrix: np.ndarray, qs: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best (similarities, ids) of each query, of those known and of some more rows; only rows that may be among them are
    sorted."""
    score = matrix @ rows.T
    hit = score >= np.maximum(best[0][:, -1:], least)
    hit &= qs[:, None] != ids[None, :]
    if len(ids) > k and np.count_nonzero(hit) > 4 * k * len(qs):
        score[~hit] = -np.inf
        hit &= score >= np.partition(score, -k, axis=1)[:, -k][:, None]
    which, at = np.nonzero(hit)
    if not len(which):
        return best
    changed = np.zeros(len(qs), bool)
    changed[which] = True
    old, place = np.nonzero(changed[:, None] & np.isfinite(best[0]))
    q, s, i = np.concatenate([old, which]), np.concatenate([best[0][old, place], score[which, at]]), np.concatenate([best[1][old, place], ids[at]])
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    q, s, i, rank = (x[rank < k] for x in (q, s, i, rank))
    out = best[0].copy(), best[1].copy()
    out[0][changed] = -np.inf
    out[0][q, rank], out[1][q, rank] = s, i
    return out


def semantic_search_batch(df: DataFrame, queries: DataFrame, id_col: str, vector: str, query_id: str = "query_id", query_vector: str = "query_vector", k: int = 10, min_similarity: float = -1.0, queries_in_block: int = 2048, rows_in_share: int = 65_536) -> DataFrame:
    """(query_id, rank, id, similarity) of each query's k best rows, ties by id.

    Queries are dealt to blocks and rows to shares, and every block meets every share; a task multiplies the matrix of one
    block with its rows, batch by batch, and gives out k rows a query at most. Rows become no pairs. Vectors that are null
    or of another length than most queries take no part, and those of length 0 are similar to nothing.
    """
    q = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).cast("array<double>").alias("v"))
    usual = q.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    fine = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull())
    q = q.filter(fine)
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(fine)
    blocks, shares = max(1, -(-q.count() // queries_in_block)), max(1, -(-rows.count() // rows_in_share))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(shares).alias("share"), F.lit(True).alias("is_query"), "id", "v")
    met = rows.select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"), F.lit(False).alias("is_query"), "id", "v").unionByName(asked)
    dealt = met.repartition("block", "share").sortWithinPartitions("block", "share", F.desc("is_query"))
    found = dealt.mapInArrow(_best_of_blocks(k, min_similarity), "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity"))
