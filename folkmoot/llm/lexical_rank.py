"""Ranked lexical search by NRA: no random access, only sequential reads of impact-sorted postings.

Texts are cut into terms (runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased) and counted.
A query's score of a document is the sum, over the query's terms with repeats, of an impact: the term's weight times
``(10**9 * tf) div (1000 * tf + 12 * m)``, where m grows with the document's length.

Postings are written once, sorted by falling impact and cut into bands: a row for each document, a column for each band.
The first band has the largest impacts over all terms, and each band holds about four times as many postings as those
before it. A round reads the next column, and those before it again, which costs a constant factor; no round shuffles
postings. What a document has gathered so far is the lower bound of its score for a query; the upper bound adds, for each
term it was not yet seen with, the largest impact that the unread bands still hold for this term. When the k-th lower
bound of every query exceeds what a document that was never seen can reach, no new documents count: those whose upper
bound is below the k-th lower bound leave, and only the rest is read on. Reading ends when all that are left have equal
bounds, so that membership, ties and scores are final. Bounds only ever approach each other, so a document that has left
could not come back.

Queries are searched in blocks of about ``BLOCK_QUERIES`` queries and ``BLOCK_TERMS`` terms, so what a task knows of the
queries is bounded. A task holds the intervals of some documents for one block at a time, and tells the k largest lower
bounds of each query.

Documents with the same length and the same counts of query terms have the same score on every query. They are one
profile, so copies cost one set of postings; of each profile that is left in the end, the k smallest ids are ranked. Queries
with the same terms are searched once. So neither a text with very many copies nor a repeated query multiplies rows.

Documents are counted against the distinct terms of all queries. Up to ``most_terms`` of them are told to every task; more
are joined by a shuffle. Terms of weight 0, impacts of 0 and documents without a term cannot score. Null texts have no
term. Rows of one id, or without one, are rows of their own, ties go to the smaller id, null last. A query without terms
or without hits gives no rows, an empty table none either. Only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.llm._common import stored, workspace

# Bytes of terms: digits, letters (A-Z lower-cased) and all of 0x80 and above; the others part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE_BYTES = 1 << 22  # of a text cut at once
FIRST_BAND = 64  # postings of the first band for each document wanted
MOST_BANDS = 10
BLOCK_QUERIES, BLOCK_TERMS = 2048, 65_536
INTERVALS = 1 << 20  # of documents and queries that a task holds at once
BROADCAST_ROWS = 200_000


def terms_of(raw: bytes, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice of it at a time."""
    at = 0
    while at < len(raw):
        to = at + most
        while to < len(raw) and raw[to : to + 1].translate(TERM_BYTES) != b" ":
            to += 1
        yield raw[at:to].translate(TERM_BYTES).split()
        at = to


def _counts(vocabulary: dict[bytes, int]):
    """One row a document that has terms: its length, and the numbers and counts of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in batches:
            ids, lengths, terms, counts = [], [], [], []
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n, own = 0, Counter()
                for part in terms_of(raw or b""):
                    n += len(part)
                    own.update(map(number, part))
                own.pop(None, None)
                if n:
                    ids.append(i)
                    lengths.append(n)
                    terms.append(sorted(own))
                    counts.append([own[t] for t in terms[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return run


def _all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each query or document and term: (id, n, term, tf)."""
    for b in batches:
        ids, lengths, terms, counts = [], [], [], []
        for i, raw in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            own = Counter()
            for part in terms_of(raw or b""):
                own.update(part)
            n = sum(own.values())
            ids += [i] * len(own)
            lengths += [n] * len(own)
            terms += own.keys()
            counts += own.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], names=["id", "n", "term", "tf"])


ALL_COUNTS = "id long, n long, term binary, tf long"


def _raw(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.col(text_col).cast("string").cast("binary").alias("text"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join: told to every task where its counted rows are few, else left to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def count_terms(docs: DataFrame, vocabulary: DataFrame, n_terms: int, most_terms: int, folder: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents that have terms; of ``docs`` (doc_id, text) and ``vocabulary`` (term, t)."""
    if n_terms <= most_terms:
        known = {bytes(r["term"]): r["t"] for r in vocabulary.collect()}
        return stored(docs.mapInArrow(_counts(known), "doc_id long, n long, terms array<int>, tfs array<long>"), "counts", folder)
    named = stored(docs.withColumn("id", F.monotonically_increasing_id()), "texts", folder)
    every = stored(named.select("id", "text").mapInArrow(_all_counts, ALL_COUNTS), "all-counts", folder)
    lengths = every.select("id", "n").distinct()
    known = every.join(vocabulary, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "tf"))).alias("own"))  # as many as a document has terms
    own = F.coalesce("own", F.array().cast("array<struct<t:int,tf:bigint>>"))
    joined = named.select("id", "doc_id").join(lengths, "id").join(known, "id", "left")
    return stored(joined.select("doc_id", "n", F.transform(own, lambda x: x["t"]).alias("terms"), F.transform(own, lambda x: x["tf"]).alias("tfs")), "counts", folder)


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double")))


class Block:
    """Queries that are searched together: their numbers, the terms that weigh, and for each of these its queries."""

    def __init__(self, asked: list, weights: dict[int, int], n_docs: int, length: int):
        self.queries = np.array(sorted({r["g"] for r in asked}), np.int64)
        self.terms = np.array(sorted(weights), np.int64)
        self.weights = np.array([weights[t] for t in self.terms.tolist()], np.int64)
        rows = [(t, g, n) for t, g, n in ((r["t"], r["g"], r["times"]) for r in asked) if t in weights]
        term, query, self.times = np.array(sorted(rows), np.int64).reshape(-1, 3).T
        self.query = np.searchsorted(self.queries, query)
        self.starts = np.searchsorted(term, [*self.terms, np.iinfo(np.int64).max])
        self.n_docs, self.length = n_docs, length

    def impacts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the document, place of the term, impact) of the postings of counted documents, by falling impact."""
        sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        doc, term, tf = np.repeat(np.arange(len(sizes)), sizes), *(batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        own = np.flatnonzero(self.terms[at] == term) if len(self.terms) else np.zeros(0, np.int64)
        doc, at, tf = doc[own], at[own], tf[own]
        m = 75 + 25 * batch.column("n").to_numpy()[doc] * self.n_docs // self.length
        c = self.weights[at] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        order = np.lexsort((-c, doc))
        order = order[c[order] > 0]
        return doc[order], at[order], c[order]

    def sums(self, doc: np.ndarray, at: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Sums of value times repeats over the queries of each posting's term: a row a document, a column a query."""
        many = np.diff(self.starts)[at]
        each = np.repeat(self.starts[:-1][at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cell = np.repeat(doc, many) * len(self.queries) + self.query[each]
        added = np.repeat(value, many) * self.times[each]
        n = docs * len(self.queries)
        if added.sum(dtype=np.float64) < 2.0**52:  # exact in doubles
            return np.bincount(cell, weights=added, minlength=n).astype(np.int64).reshape(docs, -1)
        out = np.zeros(n, np.int64)
        np.add.at(out, cell, added)
        return out.reshape(docs, -1)


def _lists(doc: np.ndarray, values: np.ndarray, docs: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]), pa.int32()), pa.array(values))


def _band(c: np.ndarray, cuts: list[int]) -> np.ndarray:
    """0 for impacts above the first cut, and so on; cuts fall."""
    return len(cuts) - np.searchsorted(np.array(cuts[::-1], np.int64), c, "left")


def _histogram(block: Block):
    """Postings by impact, in steps of 4 %: some hundred rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for b in batches:
            total.update(Counter(np.floor(np.log2(block.impacts(b)[2]) * 16).astype(int).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["step", "n"])

    return run


def cuts_of(steps: list[tuple[int, int]], first: int) -> list[int]:
    """Impacts that part the bands, falling, of (step, postings). They lay out the reading only."""
    total, wanted = sum(n for _, n in steps), []
    while len(wanted) < MOST_BANDS - 1 and total / 4 ** (len(wanted) + 1) > first:
        wanted.append(total / 4 ** (len(wanted) + 1))
    cuts, seen = [], 0
    for step, n in sorted(steps, reverse=True):
        if wanted and seen > 0 and seen + n > wanted[-1]:
            cuts.append(int(2 ** ((step + 1) / 16)))
            while wanted and seen + n > wanted[-1]:
                wanted.pop()
        seen += n
    return cuts


def _postings(block: Block, cuts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at, c = block.impacts(b)
            band, columns, names = _band(c, cuts), [b.column("key")], ["key"]
            for k in range(len(cuts) + 1):
                own = band == k
                columns += [_lists(doc[own], at[own].astype(np.int32), b.num_rows), _lists(doc[own], c[own], b.num_rows)]
                names += [f"t{k}", f"c{k}"]
            some = pa.array(np.bincount(doc, minlength=b.num_rows) > 0)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(some)

    return run


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, t, top): a term's largest impact in each band, of the postings of a task."""
    best: dict[tuple[int, int], int] = {}
    for b in batches:
        for k in range((b.num_columns - 1) // 2):
            at, c = b.column(f"t{k}").flatten().to_numpy(), b.column(f"c{k}").flatten().to_numpy()
            order = np.lexsort((c, at))
            last = order[np.flatnonzero(np.diff(at[order], append=-1))]
            for t, top in zip(at[last].tolist(), c[last].tolist()):
                best[k, t] = max(best.get((k, t), 0), top)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.int32()), pa.array([t for _, t in best], pa.int32()), pa.array(list(best.values()), pa.int64())], names=["band", "t", "top"])


def _intervals(block: Block, read: int, rest: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, lower bounds, upper bounds) of some documents after ``read`` bands; ``rest`` is what a term may still bring."""
    each = np.arange(len(block.terms))
    unseen = block.sums(np.zeros(len(each), np.int64), each, rest, 1)[0]
    step = max(1, INTERVALS // len(block.queries))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            b = batch.slice(a, step)
            columns = [(np.repeat(np.arange(b.num_rows), b.column(f"t{k}").value_lengths().to_numpy(zero_copy_only=False)), *(b.column(f"{x}{k}").flatten().to_numpy().astype(np.int64) for x in "tc")) for k in range(read)]
            doc, at, c = (np.concatenate(x) for x in zip(*columns))
            lower = block.sums(doc, at, c, b.num_rows)
            yield b.column("key").to_numpy(), lower, lower + unseen - block.sums(doc, at, rest[at], b.num_rows)


def _best(block: Block, read: int, rest: np.ndarray, k: int):
    """The k largest lower bounds of each query in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, len(block.queries)), np.int64)
        for _, lower, _ in _intervals(block, read, rest, batches):
            best = np.concatenate([best, lower])
            best = np.partition(best, len(best) - k, axis=0)[-k:] if len(best) > k else best
        _, query = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(best[best != 0], pa.int64())], names=["query", "lower"])

    return run


def _left(block: Block, read: int, rest: np.ndarray, kth: np.ndarray):
    """Documents whose upper bound is not below the k-th lower one of a query; ``moving``: their bounds still differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lower, upper in _intervals(block, read, rest, batches):
            doc, query = np.nonzero(upper >= np.maximum(kth, 1))
            yield pa.RecordBatch.from_arrays([pa.array(block.queries[query], pa.int64()), pa.array(keys[doc], pa.int64()), pa.array(lower[doc, query], pa.int64()), pa.array(upper[doc, query] > lower[doc, query])], names=["g", "key", "score", "moving"])

    return run


def nra(profiles: DataFrame, block: Block, k: int, folder: str) -> DataFrame:
    """(g, key, score) of all documents that can be among the k best of a query of the block, with final scores.

    ``profiles`` are counted documents (key, n, terms, tfs). The driver gets a row for each query, term or band.
    """
    steps = profiles.mapInArrow(_histogram(block), "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    cuts = cuts_of([(r["step"], r["n"]) for r in steps], FIRST_BAND * k * len(block.queries))
    n_bands = len(cuts) + 1
    schema = "key long, " + ", ".join(f"t{b} array<int>, c{b} array<long>" for b in range(n_bands))
    postings = stored(profiles.mapInArrow(_postings(block, cuts), schema), "postings", folder)
    tops = np.zeros((n_bands + 1, len(block.terms)), np.int64)
    for r in postings.mapInArrow(_tops, "band int, t int, top long").groupBy("band", "t").agg(F.max("top").alias("top")).collect():
        tops[r["band"], r["t"]] = r["top"]
    rests = np.maximum.accumulate(tops[::-1])[::-1]  # the largest impact in a band and those below it
    held = None
    for read in range(1, n_bands + 1):
        rest = rests[read]
        rows = postings.select("key", *[f"{x}{b}" for b in range(read) for x in "tc"])
        if held is not None:
            rows = rows.join(F.broadcast(held) if few_held else held, "key", "left_semi")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
        best = rows.mapInArrow(_best(block, read, rest, k), "query int, lower long").withColumn("place", place).filter(F.col("place") <= k)
        kth = np.zeros(len(block.queries), np.int64)
        for r in best.filter(F.col("place") == k).collect():
            kth[r["query"]] = r["lower"]
        each = np.arange(len(block.terms))
        unseen = block.sums(np.zeros(len(each), np.int64), each, rest, 1)[0]
        if ((unseen > 0) & (unseen >= kth)).any():
            continue  # a document that was not seen yet may still count
        left = stored(rows.mapInArrow(_left(block, read, rest, kth), "g long, key long, score long, moving boolean"), "left", folder)
        if left.filter("moving").isEmpty():
            break
        held = stored(left.select("key").distinct(), "held", folder)
        few_held = held.count() <= BROADCAST_ROWS
    return left.select("g", "key", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, most_terms: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` documents of the highest score above 0, ties to the smaller id."""
    with workspace(docs.sparkSession, "lexical") as folder:
        asked = _raw(queries, query_id, query_text, "doc_id").withColumn("id", F.monotonically_increasing_id())
        asked = stored(asked, "queries", folder)
        items = stored(asked.select("id", "text").mapInArrow(_all_counts, ALL_COUNTS), "items", folder)
        same = items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("own"))  # as many as a query has terms
        same = stored(same.join(same.groupBy("own").agg(F.min("id").alias("g")), "own").select("id", "g"), "same", folder)
        terms = stored(items.select("term").distinct().withColumn("place", F.monotonically_increasing_id()), "terms", folder)
        vocabulary = stored(terms.join(F.broadcast(_starts(terms)), F.shiftright("place", 33) == F.col("part")).select("term", (F.col("place") - F.shiftleft("part", 33) + F.col("start")).cast("int").alias("t")), "vocabulary", folder)
        asked_terms = stored(items.join(same.filter("id = g"), "id").join(vocabulary, "term").select("g", "t", F.col("tf").alias("times")), "asked", folder)
        found = _found(_raw(docs, id_col, text_col, "doc_id"), vocabulary, asked_terms, k, most_terms, folder)
        named = asked.select("id", F.col("doc_id").alias("item_id")).join(same, "id").join(found, "g")
        return stored(named.select("item_id", "rank", "doc_id", "score"), "ranked")


def _starts(terms: DataFrame) -> DataFrame:
    """Where the numbers of each partition begin, so that numbers have no gaps; one row a partition."""
    parts = terms.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _found(docs: DataFrame, vocabulary: DataFrame, asked: DataFrame, k: int, most_terms: int, folder: str) -> DataFrame:
    """(g, rank, doc_id, score)"""
    counts = count_terms(docs, vocabulary, vocabulary.count(), most_terms, folder)
    totals = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    spark, n_docs, length = docs.sparkSession, totals["n"], totals["l"]
    if not n_docs:
        return spark.createDataFrame([], "g long, rank int, doc_id long, score long")
    scoring = counts.filter(F.size("terms") > 0)
    weights = scoring.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weights = stored(weights.select("t", weight(n_docs, F.col("df")).alias("w")).filter("w > 0"), "weights", folder)
    profiles = stored(scoring.select("n", "terms", "tfs").distinct().withColumn("key", F.monotonically_increasing_id()), "profiles", folder)
    size = asked.agg(F.countDistinct("g").alias("queries"), F.count(F.lit(1)).alias("terms")).first()
    n_blocks = max(1, -(-size["queries"] // BLOCK_QUERIES), -(-size["terms"] // BLOCK_TERMS))
    scores = spark.createDataFrame([], "g long, key long, score long")
    for n in range(n_blocks):
        own = stored(asked.filter(F.pmod(F.xxhash64("g"), F.lit(n_blocks)) == n), "block", folder)
        weighed = weights.join(F.broadcast(own.select("t").distinct()), "t", "left_semi")  # as many as a block has terms
        block = Block(own.collect(), {r["t"]: r["w"] for r in weighed.collect()}, n_docs, length)
        if len(block.terms):
            scores = scores.unionByName(nra(profiles, block, k, folder))
    # The k best profiles, and all that tie with the last of them: a tie is decided by the ids of their documents.
    place = F.rank().over(Window.partitionBy("g").orderBy(F.desc("score")))
    best = stored(scores.withColumn("place", place).filter(F.col("place") <= k).select("g", "key", "score"), "best", folder)
    alike = stored(best.select("key").distinct().join(profiles, "key"), "alike", folder)
    own = Window.partitionBy("key").orderBy(F.asc_nulls_last("doc_id"))
    ids = scoring.join(_sent(alike, alike.count()), ["n", "terms", "tfs"]).select("key", "doc_id").withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.join(ids.select("key", "doc_id"), "key").withColumn("rank", rank).filter(F.col("rank") <= k).select("g", "rank", "doc_id", "score")
