"""The stored index of vectors: exact look-ups equal a scan, approximate ones have the recall that was measured."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folkmoot.operators import cells, vectors


def table(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + list(extra), "vec_id long, embedding array<float>, cell int").repartition(4)


@pytest.fixture(scope="module")
def clustered(spark):
    """200 narrow clusters of 64 dimensions, with copies, ties and vectors that take no part."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((200, 64))
    x = (middle[rng.integers(0, 200, 8000)] + 0.25 * rng.standard_normal((8000, 64))).astype(np.float32)
    x[10] = x[11] = x[12]
    extra = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [1.0], 1), (None, [1.0] * 64, 1)]
    return x, table(spark, x, extra)


@pytest.fixture(scope="module")
def index(clustered):
    return cells.build(clustered[1], "vec_id", "embedding", cells=100)


def truth(x, queries, k, least=-1.0):
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = unit[queries] @ unit.T
    s[np.arange(len(queries)), queries] = -2
    return {q: [i for i in np.lexsort((np.arange(len(x)), -row))[:k] if row[i] >= least] for q, row in zip(queries, s)}


def test_few_cells_hold_the_neighbours(clustered, index):
    x, df = clustered
    queries = list(range(0, 8000, 40))
    asked = df.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = defaultdict(set)
    for r in index.search(asked).collect():
        got[r.query_id].add(r.id)
    want = truth(x, queries, 10)
    recall = np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()])
    assert recall >= 0.95 and index.probes < len(index.centroids) / 10, (recall, index.probes)


def test_exact_search_leaves_cells_out(spark, clustered, index):
    x, df = clustered
    df = df.filter("vec_id < 8000")
    for least in (0.9, 0.3):
        query = x[5].tolist()
        read = index.reaching(query, least)
        want = vectors.semantic_search(df.filter(F.size("embedding") == 64), query, "embedding", ["vec_id"], "vec_id", min_similarity=least, k=30)
        found = vectors.semantic_search(index.near(query, min_similarity=least), query, "v", ["id"], "id", min_similarity=least, k=30)
        assert [(r.vec_id, r.similarity) for r in want.collect()] == [(r.id, r.similarity) for r in found.collect()]
        assert len(read) < 100 if least == 0.9 else len(read) <= 100
    assert len(index.reaching(x[5].tolist(), 0.9)) <= 20
    asked = df.filter("vec_id % 400 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = vectors.semantic_search_batch(df, asked, "vec_id", "embedding", min_similarity=0.5)
    assert sorted(map(tuple, index.search(asked, min_similarity=0.5, exact=True).collect())) == sorted(map(tuple, want.collect()))


def test_only_the_folders_of_cells_are_read(clustered, index):
    near = index.near(clustered[0][5].tolist(), probes=3)
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString()
    assert near.select("cell").distinct().count() == 3 and index.counts.sum() == 8000 == index.rows.count()


def test_small_tables(spark):
    assert cells.build(table(spark, np.zeros((0, 4))), "vec_id", "embedding") is None
    one = cells.build(table(spark, np.ones((1, 4))), "vec_id", "embedding")
    asked = spark.createDataFrame([(7, [1.0, 1.0, 1.0, 1.0]), (8, None), (9, [1.0])], "query_id long, query_vector array<double>")
    assert [tuple(r) for r in one.search(asked).collect()] == [(7, 1, 0, 1.0)]


def test_queries_of_a_cell_come_in_blocks_and_rows_in_slices(spark, monkeypatch):
    """No product of a task grows with the queries of a cell, nor with its batches; the rows found are those of one block."""
    import numpy as np
    from pyspark.sql import functions as F

    from folkmoot.operators import cells, vectors

    rng = np.random.default_rng(8)
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)))], "id long, v array<double>")
    asked = e.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    index = cells.build(e, "id", "v", cells=4)
    told = lambda: sorted(map(tuple, index.search(asked, min_similarity=0.2, exact=True).collect()))
    want, sizes = told(), []
    monkeypatch.setattr(cells, "QUERIES_IN_BLOCK", 7)
    assert told() == want and len(want) == 1000
    better = vectors._better
    monkeypatch.setattr(vectors, "SCORES_AT_ONCE", 500)
    monkeypatch.setattr(vectors, "_better", lambda best, m, qs, rows, *a: sizes.append(len(qs) * len(rows)) or better(best, m, qs, rows, *a))
    import pyarrow as pa

    v = rng.normal(size=(200, 6))
    batch = lambda ids, q: pa.RecordBatch.from_pydict({"block": [0] * len(ids), "share": [0] * len(ids), "is_query": [q] * len(ids), "id": ids, "v": v[ids].tolist()})
    found = [r for b in vectors._best_of_blocks(10, -1.0)(iter([batch(list(range(20)), True), batch(list(range(200)), False)])) for r in b.to_pylist()]
    assert max(sizes) <= 500 and len(found) == 200


def test_a_query_goes_to_a_share_once_with_its_cells(spark, monkeypatch):
    """A whole batch of queries was copied at once for each of their cells, which took memory by queries times cells."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = e.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    want = sorted(map(tuple, vectors.semantic_search_batch(e, asked, "id", "v", min_similarity=0.2).collect()))
    monkeypatch.setattr(cells, "ROWS_IN_SHARE", 20)
    monkeypatch.setattr(cells, "ASKED_AT_ONCE", 100)
    kept, written = cells.kept, {}
    monkeypatch.setattr(cells, "kept", lambda df, name, *a: written.setdefault(name, kept(df, name, *a)))
    for n in (4, 60):  # cells of several shares, shares of several cells
        written.clear()
        index = cells.build(e, "id", "v", cells=n)
        assert sorted(map(tuple, index.search(asked, min_similarity=0.2, exact=True).collect())) == want
        assert written["asked"].count() == 100
        first, many = cells._shares(index.counts)
        ids = list(range(0, 300, 3))
        batch = pa.RecordBatch.from_pydict({"id": ids, "v": x[ids].tolist()})
        told = list(cells._asked(index, 0.2, index.probes, True, first, many)(iter([batch])))
        rows = [r for b in told for r in b.to_pylist()]
        assert max(b.num_rows for b in told) <= 100 and len({(r["id"], r["share"]) for r in rows}) == len(rows)
        for i in ids:
            assert sorted((c, r["share"]) for r in rows if r["id"] == i for c in r["cells"]) == sorted((c, first[c] + m) for c in index.reaching(x[i].tolist(), 0.2) for m in range(many[c]))
        per_share = np.bincount(np.concatenate([first[c] + np.arange(many[c]) for c in range(len(many))]), np.concatenate([np.full(many[c], index.counts[c] / many[c]) for c in range(len(many))]))
        assert per_share.max() <= 20 and per_share.sum() == 300


def test_rows_meet_only_the_queries_that_list_their_cell(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(10)
    x, sizes, better = rng.normal(size=(40, 4)), [], vectors._better
    monkeypatch.setattr(vectors, "_better", lambda best, m, qs, rows, *a: sizes.append((len(qs), len(rows))) or better(best, m, qs, rows, *a))
    lists = [[1], [1, 2], []]
    ask = {"block": [0] * 3, "share": [0] * 3, "is_query": [True] * 3, "cell": [-1] * 3, "id": [100, 101, 102], "v": x[:3].tolist(), "cells": lists}
    row = {"block": [0] * 40, "share": [0] * 40, "is_query": [False] * 40, "cell": [1] * 10 + [2] * 10 + [3] * 20, "id": list(range(40)), "v": x.tolist(), "cells": [None] * 40}
    kinds = pa.schema([("block", pa.int32()), ("share", pa.int32()), ("is_query", pa.bool_()), ("cell", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])
    found = [(r["query_id"], r["id"]) for b in vectors._best_of_blocks(5, -1.0)(iter([pa.RecordBatch.from_pydict(d, kinds) for d in (ask, row)])) for r in b.to_pylist()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[:3] @ unit.T
    assert sizes == [(2, 10), (1, 10)]
    assert found == [(100, i) for i in np.argsort(-s[0, :10])[:5]] + [(101, i) for i in np.argsort(-s[1, :20])[:5]]
