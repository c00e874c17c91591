"""Merged summaries against exact counts over ranges of sessions."""

import random
from collections import Counter

from folkmoot.operators import sketches


def test_merged_summaries(spark):
    rng = random.Random(3)
    docs = [(d, d % 6 if d else None) for d in range(60)]
    votes = [(rng.randrange(62), int(rng.paretovariate(0.6)) % 9000) for _ in range(30_000)] + [(1, None)] * 7
    d = spark.createDataFrame(docs, "id long, session int")
    v = spark.createDataFrame(votes, "document_id long, actor_id long")
    session = dict(docs)
    said = [(session.get(doc), actor) for doc, actor in votes if session.get(doc) is not None]
    stored = sketches.voter_sketches(v, d).persist()
    counts = sketches.voter_counts(v, d, keep=40).persist()
    assert stored.count() == 6 and counts.groupBy("session").count().agg({"count": "max"}).first()[0] == 40
    for low, high in ((0, 5), (2, 3), (4, 4)):
        inside = [a for s, a in said if low <= s <= high]
        exact, within = Counter(a for a in inside if a is not None), f"session between {low} and {high}"
        row = sketches.voters_of(stored.filter(within)).first()
        assert row.votes == len(inside) and abs(row.voters - len(exact)) <= 0.05 * len(exact)  # three standard errors
        got = sketches.most_active(counts.filter(within), 30).collect()
        assert len(got) == 30 and all(r.at_least <= exact[r.actor_id] <= r.at_most for r in got)
        best = [a for a, _ in sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:5]]
        assert [r.actor_id for r in got[:5]] == best and all(r.at_least == r.at_most for r in got[:5])
        unseen = max((n for a, n in exact.items() if a not in {r.actor_id for r in counts.filter(within).collect()}), default=0)
        floors = sum(r.floor for r in counts.filter(within).select("session", "floor").distinct().collect())
        assert unseen <= floors
    none = sketches.voters_of(stored.filter("false")).first()
    assert (none.votes, none.voters) == (0, 0) and sketches.most_active(counts.filter("false")).count() == 0
