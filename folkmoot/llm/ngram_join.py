"""Similarity self-join of documents on word n-grams by chosen paths.

A document is its set of ``n`` word shingles (lower case, words between ASCII white space; a text of fewer words is one
shingle). Documents with equal sets form one class, and the join runs over classes. In each of several independent
runs, a set goes to a bucket for every one of its tokens that a hash of the run picks with probability
1 / (threshold * size): about as many buckets survive for a pair at the threshold as are spent on it. A bucket of more
than ``limit`` sets is split again in the same way by further tokens, down to ``depth``; the others, and those still
large at the last depth, are compared by brute force in blocks of ``limit`` sets, so no task ever holds more than two
blocks.

What stays large are sets that are nearly the same. There each set is first compared with one pivot of its bucket. Sets
that are nearer to a pivot than half of the threshold's distance are linked with each other, as Jaccard distances obey
the triangle inequality: they form a kernel, whose links are counted by its size, and no blocks of one kernel meet. So
copies of copies cost a comparison each, and only sets outside of a kernel are met by all blocks of their bucket.

The number of runs follows from the target recall of a pair exactly at the threshold.

A pair that meets in several buckets counts in the first of them (by key) only: every set carries the keys of its
buckets. Buckets with the same members are compared once. Pairs are counted and their components joined inside the
blocks; no task emits the pairs of a group. Shingles are 64-bit hashes; the comparison itself uses their upper 32 bits.

Null and empty texts have no shingle: they link with nothing and are classes of their own. Repeated ids stay separate
rows. A null id is carried along. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.llm._common import bucketed, stored, workspace

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PIECE_BYTES = 1 << 20  # of text hashed at once
COLUMNS = 4096  # of a membership matrix at once
KERNEL_BLOCKS = 4  # of a bucket, beyond which near copies in it are looked for
KERNEL_ROUNDS = 2  # pivots that a set is compared with at most
PIVOT_SALTS = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A hash is a polynomial over the bytes from the first to the last word (one space between words), taken as a
    difference of prefix sums modulo 2**64, then mixed.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8)
    doc_of_byte = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    space = (b == 32) | ((b >= 9) & (b <= 13))
    after = np.empty_like(space)
    after[0], after[1:] = True, space[:-1]
    kept = ~space | ~after  # every word and one space behind it; each text ends in a space
    b, doc_of_byte, space = np.where(space, np.uint8(32), b)[kept], doc_of_byte[kept], space[kept]
    if not len(b):
        return [np.zeros(0, np.uint64) for _ in texts]
    powers = np.cumprod(np.full(len(b), BASE, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(b.astype(np.uint64) * powers)])
    inverse = np.cumprod(np.full(len(b), BASE_INVERSE, np.uint64))
    ends = np.flatnonzero(space)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = doc_of_byte[ends]
    words = np.bincount(doc, minlength=len(raw))
    last = np.cumsum(words) - 1
    first = last - words + 1
    i = np.arange(len(ends))
    whole = i + n - 1 <= last[doc]
    short = (i == first[doc]) & ~whole
    at = np.flatnonzero(whole | short)
    to = np.minimum(at + n - 1, last[doc[at]])
    h = mixed((sums[ends[to]] - sums[starts[at]]) * inverse[starts[at]])
    bounds = np.searchsorted(doc[at], np.arange(len(raw) + 1))
    return [np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]


def _threshold(size: int, threshold: float) -> np.uint64:
    return np.uint64(min((1 << 64) - 1, int(2.0**64 / (threshold * size))))


def picked(tokens: np.ndarray, seeds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each seed (a run, or a bucket to split) the tokens that its hash picks, as (seed index, bucket key)."""
    odd = mixed(seeds) | np.uint64(1)
    hit = tokens[None, :] * odd[:, None] <= _threshold(len(tokens), threshold)
    seed, token = np.nonzero(hit)
    return seed, mixed(seeds[seed] ^ mixed(tokens[token] + np.uint64(0x632BE59BD9B4E019)))


def runs_for(recall: float, depth: int) -> int:
    """Runs that find a pair at the threshold, deep down, with the given probability.

    At each depth a common bucket of the pair has one common child on average (Poisson).
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def _sets(n: int, threshold: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size < PIECE_BYTES):
                    size += len(texts[to] or "")
                    to += 1
                digests, sizes, keys, tokens = [], [], [], []
                for s in shingle_sets(texts[at:to], n):
                    small = np.unique((s >> np.uint64(32)).astype("<u4"))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sizes.append(len(small))
                    keys.append(np.unique(picked(s, seeds, threshold)[1].view(np.int64)) if len(s) else np.zeros(0, np.int64))
                    tokens.append(small.tobytes())
                carried = [c.slice(at, to - at) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at:to], pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(tokens, pa.binary()), *carried],
                    names=["doc_id", "digest", "n", "keys", "tokens", *batch.schema.names[2:]],
                )
                at = to

    return run


def _children(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, keys = [], [], []
            for uid, n, parents, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                s = mixed(np.frombuffer(tokens, "<u4").astype(np.uint64))
                got = np.unique(picked(s, np.array(parents, np.int64).view(np.uint64), threshold)[1].view(np.int64))
                rows += [uid] * len(got)
                sizes += [n] * len(got)
                keys.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "uid", "n"])

    return run


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of lists of distinct numbers."""
    m = len(lists)
    out = np.zeros((m, m), np.float32)
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1
    kept = common[column]
    column, owner = (np.cumsum(common) - 1)[column[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for c in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        part = np.zeros((m, min(COLUMNS, int(common.sum()) - c)), np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        out += part @ part.T
    return out


def components(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric matrix of links reaches."""
    label = np.arange(len(linked))
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def compare(key: int, uids: list[int], copies: np.ndarray, tokens: list[bytes], keys: list[list[int]], side: np.ndarray | None, threshold: float, kernels: np.ndarray | None = None) -> tuple[list[int], list[int], list[int]]:
    """Brute force over one block of a bucket, or between two, told apart by ``side``: uid, links first met here, and a
    uid of its component. Links inside of a kernel (a number from 0) are counted elsewhere."""
    sets = [np.frombuffer(t, "<u4") for t in tokens]
    size = np.array([len(s) for s in sets], np.float64)
    common = overlaps(sets).astype(np.float64)
    linked = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if not linked.any():
        return [], [], []
    root = components(linked)
    counted = linked if side is None else linked & (side[:, None] != side[None, :])
    earlier = [np.array([k for k in ks if k < key], np.int64) for ks in keys]
    counted = counted & (overlaps(earlier) == 0)
    if kernels is not None:
        counted = counted & ~((kernels[:, None] == kernels[None, :]) & (kernels[:, None] >= 0))
    links = counted @ copies
    told = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
    return [uids[i] for i in told], links[told].tolist(), [uids[root[i]] for i in told]


def _blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list, list] = ([], [], [])
        at, rows = None, []

        def close() -> None:
            if len(rows) > 1:
                uids, copies, tokens, keys, side, kernels = zip(*rows)
                for have, more in zip(found, compare(at[0], list(uids), np.array(copies, np.int64), list(tokens), list(keys), np.array(side) if at[1] != at[2] else None, threshold, np.array(kernels, np.int64))):
                    have += more

        for batch in batches:
            for key, i, j, side, uid, copies, tokens, keys, kernel in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != at:
                    close()
                    at, rows = (key, i, j), []
                rows.append((uid, copies, tokens, keys, side, kernel))
            if len(found[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["uid", "links", "root"])
                found = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["uid", "links", "root"])

    return run


def _near(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(uid, kernel) of the sets whose similarity to their pivot is at least ``least``."""
        for batch in batches:
            near = []
            for own, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(own, "<u4"), np.frombuffer(other, "<u4")
                near.append(len(np.intersect1d(a, b, assume_unique=True)) * (1 + least) >= least * (len(a) + len(b)) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["uid", "kernel"]).filter(pa.array(near, pa.bool_()))

    return run


def find_kernels(sets: DataFrame, reps: DataFrame, big: DataFrame, threshold: float, least: int, folder: str) -> DataFrame | None:
    """(uid, kernel) of sets in buckets (key, uid) of more than ``least`` sets that lie near one pivot; None where no bucket
    is so large.

    The pivot of a bucket is that of its sets which is in most large buckets, and of these the one with most copies: it
    differs least from the rest. A set asks one pivot a round, so a round is linear in the sets; its pivot's tokens are
    dealt over ``PIVOT_SALTS`` tasks.
    """
    kernels, left, tokens = None, big, None
    for _ in range(KERNEL_ROUNDS):
        known = left.groupBy("uid").agg(F.count(F.lit(1)).alias("buckets")).join(reps.select("uid", "copies"), "uid")
        ranked = left.join(known, "uid").withColumn("rank", F.struct("buckets", "copies", (-F.col("uid")).alias("uid")))
        pivots = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("rank").alias("rank")).filter(F.col("size") > least).select("key", "rank")
        asked = stored(left.join(pivots, "key").groupBy("uid").agg((-F.max("rank")["uid"]).alias("pivot")), "asked", folder)
        if asked.isEmpty():
            break
        if tokens is None:  # of these sets alone
            tokens = stored(sets.select("uid", "tokens").join(asked.select("uid"), "uid"), "tokens", folder)
        own = tokens.join(asked, "uid").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(PIVOT_SALTS)))
        other = tokens.select(F.col("uid").alias("pivot"), F.col("tokens").alias("pivot_tokens")).join(asked.select("pivot").distinct(), "pivot")
        other = other.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIVOT_SALTS - 1).cast("long"))))
        near = own.join(other, ["pivot", "salt"]).select("uid", "pivot", "tokens", "pivot_tokens").mapInArrow(_near((1 + threshold) / 2), "uid bigint, kernel bigint")
        near = stored(near, "kernels", folder)
        kernels = near if kernels is None else kernels.unionByName(near)
        left = left.join(near.select("uid"), "uid", "left_anti")
    return kernels


def connected(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(uid, label) of every vertex of edges (uid, root): the smallest uid of its component.

    Labels go to neighbours and then jump to their own labels, until none changes; each round is written out.
    """
    both = edges.select("uid", F.col("root").alias("other")).unionByName(edges.select(F.col("root").alias("uid"), F.col("uid").alias("other"))).distinct()
    both = stored(both, "links", folder)
    labels = stored(both.groupBy("uid").agg(F.least(F.min("uid"), F.min("other")).alias("label")), "labels", folder)
    while True:
        near = both.join(labels.select(F.col("uid").alias("other"), "label"), "other").groupBy("uid").agg(F.min("label").alias("near"))
        lower = labels.join(near, "uid").select("uid", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("uid").alias("label"), F.col("label").alias("jumped"))
        new = stored(lower.join(jump, "label").select("uid", F.least("label", "jumped").alias("label"), "was"), "labels", folder)
        if new.filter(F.col("label") != F.col("was")).isEmpty():
            return new.select("uid", "label")
        labels = new.select("uid", "label")


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, limit: int = 256, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id that links reach), n_links (documents at or above the
    threshold, copies included), copy_of (smallest doc_id with the same set) and n_shingles. With a ``key_col`` also
    row_key, a string carried along, and class_key, which tells classes apart where ids repeat or are null."""
    carried = [] if key_col is None else [F.col(key_col).cast("string").alias("row_key")]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    sets = texts.mapInArrow(_sets(n, threshold, runs_for(recall, depth)), "doc_id bigint, digest binary, n int, keys array<bigint>, tokens binary" + (", row_key string" if carried else ""))
    # Dealt by uid once, and kept so: tokens are then joined to buckets again and again without another shuffle.
    with bucketed(sets.withColumn("uid", F.monotonically_increasing_id()), "uid", "shingle_sets") as dealt, workspace(docs.sparkSession, "ngram-join") as folder:
        return stored(_joined(dealt, threshold, limit, depth, folder), "similar")


def _joined(sets: DataFrame, threshold: float, limit: int, depth: int, folder: str) -> DataFrame:
    classes = sets.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("digest", F.col("first.doc_id").alias("copy_of"), F.col("first.uid").alias("rep"), "copies"), "classes", folder)
    reps = classes.select(F.col("rep").alias("uid"), "copies")

    nodes = sets.select("uid", "n", "keys").join(reps.select("uid"), "uid").select(F.explode("keys").alias("key"), "uid", "n")
    by_size = Window.partitionBy("key").orderBy("n", "uid")
    near = (F.lag("n").over(by_size) >= threshold * F.col("n") - 1e-6) | (threshold * F.lead("n").over(by_size) - 1e-6 <= F.col("n"))
    leaves = None
    for level in range(1, depth + 1):
        counts = stored(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets", folder)
        # In a small bucket, a set with no other of a fitting size has no link. A bucket that is still large is left to
        # its blocks: no task sorts it whole.
        leaf = nodes.join(counts.filter(F.col("size") <= limit).select("key"), "key").withColumn("near", near).filter("near").drop("near")
        if level == depth:
            leaf = leaf.unionByName(nodes.join(counts.filter(F.col("size") > limit).select("key"), "key"))
        leaf = stored(leaf, "leaves", folder)
        sizes = leaf.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("uid")).alias("who"))
        once = sizes.groupBy("who", "size").agg(F.min("key").alias("key"))
        leaf = stored(leaf.join(once.select("key", "size"), "key"), "leaves", folder)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        big = counts.filter(F.col("size") > limit).select("key")
        if level == depth or big.isEmpty():
            break
        parents = nodes.join(big, "key").groupBy("uid", "n").agg(F.collect_list("key").alias("parents"))
        nodes = parents.join(sets.select("uid", "tokens"), "uid").select("uid", "n", "parents", "tokens").mapInArrow(_children(threshold), "key bigint, uid bigint, n int")
        nodes = stored(nodes, "paths", folder)

    small, big = leaves.filter(F.col("size") <= limit), leaves.filter(F.col("size") > limit).select("key", "uid")
    kernels = find_kernels(sets, reps, leaves.filter(F.col("size") > KERNEL_BLOCKS * limit).select("key", "uid"), threshold, KERNEL_BLOCKS * limit, folder)
    # A bucket's sets are dealt into parts: one for a small bucket; of a large one some for each kernel with many of its
    # sets, and some for all others. A part of a kernel meets the parts of the rest only, other parts meet all.
    placed = small.select("uid", "key", *[F.lit(x).alias(c) for c, x in (("mine", 0), ("own_from", -1), ("own_to", -1), ("total", 1))])
    inside = None
    if kernels is None:
        reps = reps.withColumn("kernel", F.lit(-1).cast("long"))
        parts = F.ceil(F.col("size") / limit).cast("int")
        several = leaves.filter(F.col("size") > limit)
        placed = placed.unionByName(several.select("uid", "key", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("mine"), F.lit(-1).alias("own_from"), F.lit(-1).alias("own_to"), parts.alias("total")))
    else:
        reps = reps.join(kernels, "uid", "left").fillna(-1, ["kernel"])
        members = big.join(kernels, "uid", "left").fillna(-1, ["kernel"])
        families = members.groupBy("key", "kernel").agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.when((F.col("kernel") >= 0) & (F.col("n") >= limit), F.col("kernel")).otherwise(-1))
        parts = F.ceil(F.sum("n") / limit).cast("int")
        families = families.groupBy("key", "family").agg(parts.alias("parts"))
        before = Window.partitionBy("key").orderBy("family").rowsBetween(Window.unboundedPreceding, -1)
        families = families.withColumns({"own_from": F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int"), "total": F.sum("parts").over(Window.partitionBy("key")).cast("int")})
        families = stored(families.withColumn("own_to", F.col("own_from") + F.col("parts")), "families", folder)
        large = members.join(families.filter("family >= 0").select("key", F.col("family").alias("kernel"), F.lit(True).alias("of_kernel")), ["key", "kernel"], "left")
        large = large.select("uid", "key", F.when(F.col("of_kernel"), F.col("kernel")).otherwise(-1).alias("family")).join(families, ["key", "family"])
        mine = (F.col("own_from") + F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int")
        span = lambda c: F.when(F.col("family") >= 0, F.col(c)).otherwise(-1).alias(c)
        placed = placed.unionByName(large.select("uid", "key", mine.alias("mine"), span("own_from"), span("own_to"), "total"))
        of_kernel = reps.filter("kernel >= 0")
        totals = of_kernel.groupBy("kernel").agg(F.sum("copies").alias("all"), F.min("uid").alias("root"))
        inside = of_kernel.join(totals, "kernel").select("uid", (F.col("all") - F.col("copies")).alias("links"), "root")

    own = placed.groupBy("uid").agg(F.collect_list(F.struct("key", "mine", "own_from", "own_to", "total")).alias("buckets"))
    held = sets.select("uid", "tokens").join(own, "uid").join(reps, "uid")
    held = held.withColumn("keys", F.transform("buckets", lambda b: b["key"])).select("uid", "copies", "tokens", "keys", "kernel", F.explode("buckets").alias("b")).select("uid", "copies", "tokens", "keys", "kernel", "b.*")
    outside = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda k: (k < F.col("own_from")) | (k >= F.col("own_to")))
    held = held.withColumn("other", F.explode(outside))
    held = held.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "uid", "copies", "tokens", "keys", "kernel")
    found = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(threshold), "uid bigint, links bigint, root bigint")
    found = stored(found if inside is None else found.unionByName(inside), "found", folder)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    labels = connected(found.select("uid", "root").filter("uid <> root"), folder)
    named = classes.join(labels.withColumnRenamed("uid", "rep"), "rep").join(links.withColumnRenamed("uid", "rep"), "rep", "left")
    heads = named.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    linked = named.join(heads, "label").select("digest", "class_id", "links", "label")
    carried = [c for c in sets.columns if c == "row_key"]
    # Stored, so that the last join reads two plain shuffles, and a text with many copies is split by the adaptive plan.
    described = stored(classes.join(linked, "digest", "left"), "described", folder)
    out = sets.select("doc_id", "digest", "n", "uid", *carried).join(described, "digest", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "copy_of", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.col("n").alias("n_shingles"),
        *([*carried, F.coalesce("label", "rep", "uid").alias("class_key")] if carried else []),
    )
