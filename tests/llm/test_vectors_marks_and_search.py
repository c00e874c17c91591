"""Whitening, SimHash and ranked search: nulls, copies, ties, long texts, empty tables, and brute force beside each."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from folkmoot.llm import lexical_rank, simhash_near, whitening

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


# ---- whitening


def vectors(spark, rows):
    """With extra columns that clash with names of the operator."""
    return spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<float>, n int, x string").repartition(3)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((150, 12)) @ rng.standard_normal((12, 12)) * 0.2).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(200 + i, base[0]) for i in range(80)] + [(5, base[7]), (None, base[8]), (None, base[8])]
    out = [(300, None), (301, [*base[0][:11], None]), (302, [*base[0][:11], float("nan")]), (303, [float("inf"), *base[0][1:]]), (304, []), (305, [1.0])]
    for weights in ("count", "one"):
        got = whitening.whiten(vectors(spark, rows + out), weights=weights).collect()
        x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
        fit = x if weights == "count" else np.unique(x, axis=0)
        n, s = len(fit), fit.sum(0)
        centred = fit - s / n
        e, u = np.linalg.eigh(centred.T @ centred / n)
        best = np.argsort(-e)[:8]
        assert len(got) == 8 * len(rows) and {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
        by = defaultdict(list)
        for r in got:
            by[r.vec_id, r.component].append(r)
        whole = (x - s / n) @ u[:, best] / np.sqrt(e[best])
        for k in range(8):
            sign = 0
            for (i, _), own, z in zip(rows, x, whole):
                near = [r for r in by[i, k + 1] if r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s))]
                assert near and abs(near[0].explained - e[best[k]] / e.sum()) < 1e-9
                if abs(z[k]) > 1e-3:
                    sign = sign or np.sign(z[k]) * np.sign(near[0].whitened)
                assert min(abs(r.whitened * (sign or 1) - z[k]) for r in near) < 1e-6
    assert whitening.whiten(vectors(spark, out[:4])).count() == 0 and whitening.whiten(vectors(spark, [])).count() == 0


def test_whitening_without_variance_and_beyond_longs(spark):
    got = whitening.whiten(vectors(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert len(got) == 4 and all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in got)
    got = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])])).collect()
    assert {(r.vec_id, r.deviation is None) for r in got} == {(1, True), (2, True), (3, False)} and max(r.identity_error for r in got) < 1e-9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**53), 2**53), min_size=2, max_size=2), min_size=1, max_size=8), st.data())
def test_sums_and_deviations_are_exact(rows, data):
    w = data.draw(st.lists(st.integers(1, 2**40), min_size=len(rows), max_size=len(rows)))
    x = np.array(rows, np.int64)
    s = [sum(a * r[k] for a, r in zip(w, rows)) for k in (0, 1)]
    assert whitening.exact_sums(x, np.array(w, np.int64)) == s
    n = sum(w)
    want = [sum((n * v - m) ** 2 for v, m in zip(r, s)) for r in rows]
    assert whitening._squares(x, n, s) == [v if v < 2**63 else None for v in want]
    for r, c in zip(rows, whitening._centred(x, n, s)):
        assert all(abs(Fraction(float(z)) - (v - Fraction(m, n))) <= max(abs(v), abs(Fraction(m, n))) * Fraction(1, 2**50) for z, v, m in zip(c, r, s))


# ---- SimHash


def plain_mark(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks):
    label = list(range(len(marks)))

    def find(i):
        return i if label[i] == i else find(label[i])

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def test_every_pair_within_the_radius_meets_in_a_table():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        tables = (1 << (radius + 1)) - 1
        for _ in range(300):
            bits = set(rng.sample(range(64), radius))
            path = ()
            for _ in range(3):  # and again in the tables below it
                v = next(v for v in range(1, tables + 1) if bits <= set(simhash_near.free_bits((*path, v), radius)))
                path = (*path, v)
        sizes = [len(simhash_near.free_bits((v,), radius)) for v in range(1, tables + 1)]
        assert max(sizes) < 40
    assert max(len(simhash_near.free_bits((u, v, w), 2)) for u in range(1, 8) for v in range(1, 8) for w in range(1, 8)) <= 10


def test_fingerprints_of_whole_texts():
    rng = random.Random(2)
    texts = [None, "", "   \n", "One", "One two", "One TWO three", "é É ß", " ".join(rng.choices(WORDS, k=3000))]
    for t in texts:
        want = plain_mark(t)
        assert simhash_near.fingerprint((t or "").encode()) % (1 << 64) == want
    whole = texts[-1].encode()
    assert [h.tolist() for h in simhash_near.shingle_hashes(whole, 3, 1 << 22)] and np.concatenate(list(simhash_near.shingle_hashes(whole, 3, 50))).tolist() == np.concatenate(list(simhash_near.shingle_hashes(whole, 3))).tolist()


@pytest.mark.parametrize("most", [1024, 2])
def test_simhash_near(spark, most):
    rng = random.Random(4)
    base = rng.choices(WORDS, k=400)
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 400, 5)] + [" ".join(rng.choices(WORDS, k=60)) for _ in range(40)]
    texts += [texts[0]] * 60 + [None, "", "  ", "Hi", "hi", " ".join(rng.choices(WORDS, k=20_000))]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[9]), (7, texts[90])]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, path string, component int").repartition(5)
    got = simhash_near.simhash_near(docs, most=most).collect()
    marks = [plain_mark(t) for _, t in rows]
    roots = plain_components(marks)
    first = {r: min([i for (i, _), q in zip(rows, roots) if q == r and i is not None], default=None) for r in set(roots)}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{m:016x}", first[r]) for (i, _), m, r in zip(rows, marks, roots))
    assert simhash_near.simhash_near(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1024, 8])
def test_links_of_marks_that_lie_close(spark, most):
    """All marks of 9 bits around one, and chains away from it: one bucket holds most of them."""
    rng = random.Random(5)
    start = rng.getrandbits(64)
    marks = {start ^ sum(1 << (7 * b) for b in range(9) if k >> b & 1) for k in range(0, 512, 3)} | {rng.getrandbits(64) for _ in range(100)}
    for m in list(marks)[:30]:
        marks.add(m ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    from folkmoot.llm._common import workspace
    from folkmoot.operators.components import components

    with workspace(spark, "t") as folder:
        rows = components(simhash_near.links(spark.createDataFrame([(m,) for m in signed], "fingerprint long"), 2, most, folder), "a", "b").collect()
    got = {r.node: r.component for r in rows}
    roots = plain_components(marks)
    want = defaultdict(set)
    for m, r in zip(signed, roots):
        want[r].add(m)
    have = defaultdict(set)
    for m in signed:
        have[got.get(m, m)].add(m)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


# ---- ranked search


def plain_terms(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isalnum() and c < "\x80" or c >= "\x80" else " " for c in t or "").split(" ")


def plain_search(docs, items, k):
    counts = [(i, Counter(w for w in plain_terms(t) if w)) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, t in items:
        q = [w for w in plain_terms(t) if w]
        scores = []
        for (i, c), size in zip(counts, lengths):
            m = 75 + 25 * size * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in q if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(6)
    weights = [1 / (r + 1) for r in range(len(WORDS))]
    docs = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randrange(5, 80)))) for i in range(150)]
    docs += [(500 - i, docs[3][1]) for i in range(60)] + [(None, docs[3][1]), (None, docs[4][1]), (9, docs[5][1]), (600, None), (601, ""), (602, "... !"), (603, "ÉTÉ Été été"), (604, " ".join(rng.choices(WORDS, weights, k=9000)))]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for i in range(20)] + [(30, docs[3][1]), (31, docs[3][1].upper()), (32, None), (33, "unknown"), (34, "été! ÉTÉ"), (30, "alpha"), (None, "omega, omega; OMEGA")]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score int").repartition(4)
    return docs, items, rows, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("k, most_terms, first", [(20, 1_000_000, 1), (3, 1_000_000, 1), (3, 0, 1), (20, 1_000_000, 64)])
def test_ranked_search(library, monkeypatch, k, most_terms, first):
    monkeypatch.setattr(lexical_rank, "FIRST_BAND", first / 10)
    docs, items, rows, queries = library
    got = lexical_rank.ranked_search(rows, queries, k=k, most_terms=most_terms).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(docs, items, k)


def test_ranked_search_by_shuffles(library, monkeypatch):
    """Sides that are too large to be told to every task."""
    monkeypatch.setattr(lexical_rank, "BROADCAST_ROWS", -1)
    docs, items, rows, queries = library
    got = lexical_rank.ranked_search(rows, queries, k=5).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(docs, items, 5)
    for d, q in ((rows.limit(0), queries), (rows, queries.limit(0)), (rows.filter("doc_id = 602"), queries)):
        assert lexical_rank.ranked_search(d, q).count() == 0


def test_documents_leave_and_bands_stay_unread(spark, monkeypatch):
    """Documents with a rare term lead, so those with the common one alone are told apart without their last bands."""
    from folkmoot.llm._common import stored, workspace

    rows = [(i, "rare rare " * (i + 1) + "common " * 3) for i in range(5)] + [(10 + i, "common " * (1 + i % 7) + f"other{i}") for i in range(300)]
    monkeypatch.setattr(lexical_rank, "FIRST_BAND", 0.1)
    sizes, read = [], []
    left, best = lexical_rank._left, lexical_rank._best
    monkeypatch.setattr(lexical_rank, "stored", lambda df, name, within=None: (lambda out: sizes.append((name, out.count())) or out)(stored(df, name, within)))
    monkeypatch.setattr(lexical_rank, "_left", lambda block, n, *a: read.append(("left", n)) or left(block, n, *a))
    monkeypatch.setattr(lexical_rank, "_best", lambda block, n, *a: read.append(("best", n)) or best(block, n, *a))
    items = [(1, "rare common"), (2, "rare")]
    got = lexical_rank.ranked_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == plain_search(rows, items, 3)
    first = next(n for name, n in sizes if name == "left")
    assert first < 20 and next(n for what, n in read if what == "left") < max(n for _, n in read)  # the hundreds left before the last band was read


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_blocks_of_queries_and_small_tables_of_intervals(library, monkeypatch, most):
    monkeypatch.setattr(lexical_rank, "BLOCK_QUERIES", 6)
    monkeypatch.setattr(lexical_rank, "INTERVALS", most)
    docs, items, rows, queries = library
    got = lexical_rank.ranked_search(rows, queries, k=4).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(docs, items, 4)


def test_bands_hold_falling_impacts():
    cuts = lexical_rank.cuts_of([(16 * k, 4**k) for k in range(8)], 0)  # few large impacts, many small ones
    assert cuts == sorted(cuts, reverse=True) and len(cuts) <= lexical_rank.MOST_BANDS - 1
    steps = [(k, 1000) for k in range(400, 500)]
    cuts = lexical_rank.cuts_of(steps, 2000)
    held = [sum(n for s, n in steps if 2 ** ((s + 0.5) / 16) > c) for c in cuts]
    assert held == sorted(held) and 1000 <= held[0] <= 8000 and lexical_rank.cuts_of([], 1) == []
    assert lexical_rank._band(np.array([100, 50, 49, 7]), [50, 20]).tolist() == [0, 1, 1, 2]


def test_terms_in_slices():
    text = ("Ünï-code Straße 12x " * 200).encode()
    whole = [w for part in lexical_rank.terms_of(text) for w in part]
    assert whole == [w for part in lexical_rank.terms_of(text, 37) for w in part] and whole[:4] == ["Ünï".encode(), b"code", "Straße".encode().replace(b"S", b"s"), b"12x"]
