"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A text's words are lower-cased (A-Z alone) and taken in shingles of ``n``, repeats included; a text with fewer words is
one shingle, one without words has none. Each shingle is hashed with XXH64, and a bit of the fingerprint is set where more
than half of the hashes set it. A text without words has the fingerprint 0, which links like any other.

Fingerprints link when they differ in at most ``radius`` bits. Bit i of the fingerprint is given a number from 1 to
2**(radius+1)-1, in turn; table v keeps the bits whose number has an odd scalar product with v. For any ``radius`` bits
there is a v that is orthogonal to the numbers of all of them, so two fingerprints within the radius agree on everything
that this table keeps: no link is missed, at any size. In a table, fingerprints with equal kept bits meet in one bucket.

Only distinct fingerprints are dealt, so copies cost one row. A bucket of up to ``MOST`` of them is flooded in one task:
each fingerprint is linked to one that it was reached from, so a bucket gives fewer edges than it has fingerprints, and
never its pairs. A larger bucket is dealt again, by the same construction over the bits that its path does not keep yet,
until those are so few that a bucket cannot be large: 10 free bits make 1,024 fingerprints at most. For a radius of 2
that takes three tables at most, whose masks are constants of the query. Components of the
edges are found by contraction.

Null texts count as empty. Rows of one id, or without one, are rows of their own; a component is named by the smallest id
that it holds, and by null if it holds none. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkmoot.llm._common import joined_by_group, stored, workspace
from folkmoot.operators.components import components

SEED = 42
MOST = 1024  # fingerprints of a bucket that one task floods
SLICE_BYTES = 1 << 22  # of a text hashed at once
BROADCAST_BUCKETS = 100_000  # large buckets told to every task; more are joined by a shuffle


def shingle_hashes(raw: bytes, n: int, most: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, a slice of it at a time; nothing for a text without words."""
    head: list[bytes] = []  # the last words of the slice before
    at, seen = 0, False
    while at < len(raw):
        to = at + most
        while to < len(raw) and raw[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        words = head + raw[at:to].lower().split()  # bytes know A-Z and ASCII white space alone
        at = to
        if len(words) >= n:
            seen = True
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            yield np.array([xxhash.xxh64_intdigest(line[a:z], SEED) for a, z in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())], np.uint64)
        head = words[len(words) - n + 1 :] if len(words) >= n else words
    if not seen and head:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(head), SEED)], np.uint64)


def fingerprint(raw: bytes, n: int = 3) -> int:
    """As a signed 64-bit integer."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(raw, n):
        for a in range(0, len(h), 1 << 14):
            part = h[a : a + (1 << 14)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [fingerprint(t or b"", n) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(marks, pa.int64())], names=["doc_id", "fingerprint"])

    return run


def parity(x: int) -> int:
    return x.bit_count() & 1


def free_bits(path: tuple[int, ...], radius: int) -> list[int]:
    """Bits that none of the tables of a path keeps. Each table is built over those that the ones before it left."""
    bits, tables = list(range(64)), (1 << (radius + 1)) - 1
    for v in path:
        bits = [bit for i, bit in enumerate(bits) if not parity((i % tables + 1) & v)]
    return bits


def kept_mask(path: tuple[int, ...], radius: int) -> int:
    """As a signed 64-bit integer."""
    mask = (1 << 64) - 1
    for bit in free_bits(path, radius):
        mask &= ~(1 << bit)
    return mask - (1 << 64) if mask >> 63 else mask


def flood(marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, one that it is linked to): a tree over each component of a bucket."""
    left, a, b = np.arange(len(marks)), [], []
    unsigned = marks.view(np.uint64)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(unsigned[left] ^ unsigned[at]) <= radius
            found, left = left[near], left[~near]
            queue += found.tolist()
            a.append(marks[found])
            b.append(np.full(len(found), marks[at]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by path and key; what a batch holds of its last bucket waits for the next one."""
        names = ["path", "key", "fingerprint"]
        rest = [np.zeros(0, np.int64)] * 3

        def told(columns: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
            found = [flood(columns[2][p:q], radius) for p, q in zip(edges[:-1], edges[1:]) if q - p > 1]
            pair = [np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])

        for batch in batches:
            columns = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, names)]
            change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
            whole = int(change[-1]) if len(change) else 0
            if whole:
                yield told([c[:whole] for c in columns], np.concatenate([[0], change]))
            rest = [c[whole:] for c in columns]
        if len(rest[0]):
            yield told(rest, np.array([0, len(rest[0])]))

    return run


def links(marks: DataFrame, radius: int, most: int, folder: str) -> DataFrame:
    """(a, b) of linked fingerprints, enough to connect all that are linked; of distinct ``fingerprint``."""
    tables = (1 << (radius + 1)) - 1
    rows, found = marks.select(F.lit(0).cast("long").alias("path"), "fingerprint"), None
    paths: dict[int, tuple[int, ...]] = {0: ()}
    while True:
        children = {p * (tables + 1) + v: (*path, v) for p, path in paths.items() for v in range(1, tables + 1)}
        # A path is a number in base tables + 1; masks of its children are constants of the query.
        masks = F.create_map(*[F.lit(x) for p in paths for x in (p, [kept_mask(children[p * (tables + 1) + v], radius) for v in range(1, tables + 1)])])
        dealt = rows.select("path", "fingerprint", F.posexplode(masks[F.col("path")]).alias("v", "mask"))
        dealt = stored(dealt.select((F.col("path") * (tables + 1) + F.col("v") + 1).alias("path"), F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "fingerprint"), "buckets", folder)
        sizes = stored(dealt.groupBy("path", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes", folder)
        bounded = [p for p, path in children.items() if 1 << len(free_bits(path, radius)) <= max(most, MOST)]
        large = sizes.filter((F.col("size") > most) & ~F.col("path").isin(bounded)).select("path", "key")
        n_large = large.limit(BROADCAST_BUCKETS + 1).count()
        told = F.broadcast(large) if n_large <= BROADCAST_BUCKETS else large.hint("merge")
        met = dealt.join(told, ["path", "key"], "left_anti") if n_large else dealt
        met = met.repartition("path", "key").sortWithinPartitions("path", "key")
        edges = stored(met.mapInArrow(_buckets(radius), "a long, b long"), "edges", folder)
        found = edges if found is None else found.unionByName(edges)
        if not n_large:
            return found
        rows, paths = dealt.join(told, ["path", "key"]).select("path", "fingerprint"), children


def simhash_near(docs: DataFrame, n: int = 3, radius: int = 2, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    with workspace(docs.sparkSession, "simhash") as folder:
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        marked = stored(texts.mapInArrow(_fingerprints(n), "doc_id long, fingerprint long"), "fingerprints", folder)
        groups = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "groups", folder)
        named = components(links(groups.select("fingerprint"), radius, most, folder), "a", "b")
        named = groups.join(named.withColumnRenamed("node", "fingerprint").hint("merge"), "fingerprint", "left")
        heads = named.filter("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
        named = named.join(heads, "component", "left").select("fingerprint", "copies", F.coalesce("smallest", "first").alias("component_id"))
        out = joined_by_group(marked, stored(named, "named", folder), ["fingerprint"], "copies")
        return stored(out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"), "near")
