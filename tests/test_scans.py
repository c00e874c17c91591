"""Segmented scans, components by contraction and the automaton of names, against plain versions."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from folkmoot.functions import automaton
from folkmoot.functions import text as x
from folkmoot.operators import components, graph, scans, sequences


def rows(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def speeches(spark):
    """One meeting holds nearly all speeches, others few; one has no name."""
    rng = random.Random(1)
    data = [("hot", p, "ab"[p // 700 % 2], rng.choice([None, None, None, p])) for p in range(3000)] + [(f"m{k % 40}", k, "a", rng.choice([None, k])) for k in range(300)] + [(None, k, None, k if k % 9 == 0 else None) for k in range(500)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "meeting string, p int, section string, v int").repartition(6)


@pytest.mark.parametrize("segment_rows", [100, 1000, 10_000])
def test_running_equals_windows(speeches, segment_rows):
    so_far = Window.partitionBy("meeting").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    got = scans.running(speeches, ["meeting"], ["p"], {"last": F.col("v"), "mark": F.when(F.col("p") % 500 == 3, F.col("section"))}, {"n": F.lit(1), "s": F.when(F.col("p") > 50, F.col("v"))}, segment_rows)
    want = speeches.withColumns({
        "last": F.last("v", ignorenulls=True).over(so_far), "mark": F.last(F.when(F.col("p") % 500 == 3, F.col("section")), ignorenulls=True).over(so_far),
        "n": F.count(F.lit(1)).over(so_far), "s": F.sum(F.when(F.col("p") > 50, F.col("v"))).over(so_far),
    })
    assert rows(got) == rows(want)


def test_a_key_with_all_rows_is_no_task_of_its_own(spark):
    hot = spark.range(50_000).select(F.lit("m").alias("meeting"), F.hash("id").alias("p"), "id")
    dealt = scans.segments(hot, ["meeting"], ["p", "id"], 50)
    sizes = [r["count"] for r in dealt.groupBy("segment").count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 50_000
    order = dealt.groupBy("segment").agg(F.min("p").alias("a"), F.max("p").alias("z")).orderBy("segment").collect()
    assert all(u.z <= v.a for u, v in zip(order, order[1:]))
    got = scans.row_number(hot, ["meeting"], ["p", "id"], "n", 1000)
    assert [r.n for r in got.orderBy("p", "id").collect()] == list(range(1, 50_001)) and got.schema["n"].dataType.simpleString() == "int"


def test_sequence_operators_by_segments(spark, speeches):
    said = speeches.withColumns({"text": F.when(F.col("p") % 7 != 0, F.concat(F.lit("s "), F.col("p").cast("string"))), "turn": F.col("p")})
    assert rows(sequences.with_positions(said, "meeting", "section", "turn", segment_rows=150)) == rows(sequences.with_positions(said, "meeting", "section", "turn"))
    assert rows(sequences.number_timesteps(said, "meeting", "p", segment_rows=150)) == rows(sequences.number_timesteps(said, "meeting", "p"))
    drafts = said.withColumn("documents", F.when(F.col("p") % 90 == 0, F.array(F.lit("A/1"), F.concat(F.lit("A/L."), F.col("p").cast("string")))))
    assert rows(sequences.carry_active_draft(drafts, ["meeting"], ["p"], segment_rows=150)) == rows(sequences.carry_active_draft(drafts, ["meeting"], ["p"]))
    says = {0: "I give the floor for an explanation of vote before the vote", 40: "We have heard the last speaker in explanation of vote", 60: "we have several draft resolutions", 90: "We will now take a decision"}
    debate = said.withColumns({
        "speaker_raw": F.when((F.col("p") % 100).isin(*says), "The President").otherwise("Mr. X"),
        "text": F.coalesce(*[F.when(F.col("p") % 100 == k, t) for k, t in says.items()], F.lit("an explanation of vote after the vote")), "draft_mentions": F.array(F.lit("I")),
    })
    tagged = sequences.tag_contexts(debate, ["meeting"], ["p"], segment_rows=150)
    assert rows(tagged) == rows(sequences.tag_contexts(debate, ["meeting"], ["p"])) and tagged.filter("is_explanation_of_vote").count() > 100


def test_parsers_by_segments(spark):
    agenda = "\n".join(f"Third Committee\nB. Promotion\n{k}. Item {k}\n of it (resolutions 78/{k} and 78/7)\n(a) Part" for k in range(1, 60))
    docs = spark.createDataFrame([(1, agenda), (2, agenda.replace("Third", "First")), (3, "nothing"), (4, None)], "id int, t string")
    assert rows(x.agenda_items(docs, "id", "t", segment_rows=20)) == rows(x.agenda_items(docs, "id", "t"))
    meeting = "\n".join(f"Agenda item {k} (continued)\nTitle {k}\nMr. Silva (Brazil): on A/78/L.{k}\nmore\nThe President: thanks" for k in range(1, 60))
    docs = spark.createDataFrame([("A", meeting), ("B", "Preface only"), ("C", meeting[:500])], "symbol string, t string")
    for cut, whole in zip(x.parse_meetings(docs, "symbol", "t", segment_rows=20), x.parse_meetings(docs, "symbol", "t")):
        assert rows(cut) == rows(whole)


# ---- components


def plain(edges):
    label = {}

    def find(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            p, q = sorted((find(a), find(b)))
            label[q] = p
    return {i: find(i) for i in label}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2400)] + [(5000, 5000), (5000, 5000), (6000, None), (None, None), (3, 4), (4, 3)]
    got = components.components(spark.createDataFrame(edges, "source_id long, target_id long"))
    assert {r.node: r.component for r in got.collect()} == plain(edges) and got.count() == len(plain(edges))
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges if b is not None], "source_id string, target_id string")
    assert components.components(named).select("component").distinct().count() == len(set(plain(edges).values()))
    assert components.components(named.limit(0)).count() == 0


def test_turns_grow_with_the_logarithm_of_a_path(spark, monkeypatch):
    turns, state = [], components._state
    monkeypatch.setattr(components, "_state", lambda e: turns.append(1) or state(e))
    for n in (100, 100_000):
        path = spark.range(1, n).select(F.col("id").alias("source_id"), (F.col("id") - 1).alias("target_id"))
        assert components.components(path).agg(F.max("component"), F.count(F.lit(1))).first()[:] == (0, n)
        turns.append(0)
    few, many = [len(part) for part in "".join(map(str, turns)).split("0")[:2]]
    assert many <= few + 2 * 10  # a path 1,000 times as long


def test_turns_read_only_edges_that_are_left(spark, monkeypatch):
    """A tree with hubs on three levels: its ends go over to their hubs in the first turn, and later turns do not read them."""
    seen, state = [], components._state
    monkeypatch.setattr(components, "_state", lambda e: seen.append(e.count()) or state(e))
    up = lambda a, b, n, per: spark.range(n).select(F.format_string(f"{a}%d", "id").alias("source_id"), F.format_string(f"{b}%d", F.floor(F.col("id") / per)).alias("target_id"))
    tree = up("O", "C", 3000, 10).unionByName(up("C", "N", 300, 20)).unionByName(up("N", "R", 15, 5))
    for named in (True, False):
        got = components.components(tree, named=named).collect()
        assert len(got) == 3318 and len({r.component for r in got}) == 3
        assert {len({r.component for r in got if r.node in own}) for own in ({"R0", "N0", "N4", "C99", "O0", "O999"}, {"R2", "N10", "C200", "O2999"})} == {1}
    assert got[0].component != got[0].node and seen[1] * 5 < seen[0] and sum(seen[1:]) < 2 * 3315


def test_reachable_both_ways(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d"), ("e", "f")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("a",), ("d",), ("z",), ("a",)], "seed string")
    assert {tuple(r) for r in graph.reachable(edges, seeds).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("z", "z")}
    sizes = graph.component_sizes(edges, spark.createDataFrame([(i,) for i in "abcdefz"], "id string"))
    assert {(r.id, r.component, r["size"]) for r in sizes.collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 1), ("e", "e", 2), ("f", "e", 2), ("z", "z", 1)}


# ---- names


def tried(text, names):
    found = []
    for n in names:
        if n in text:
            found.append(n)
            text = text.replace(n, " ")
    return found, text


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", max_size=40), st.lists(st.text("ab ", min_size=1, max_size=6), max_size=10))
def test_taken_out_equals_names_tried_in_turn(text, names):
    names = tuple(sorted(set(names), key=lambda n: (-len(n), n)))
    assert automaton.taken_out(text, names, automaton.automaton(names) if names else None) == tried(text, names)


@pytest.mark.parametrize("in_shard", [3, 100_000])
def test_dictionary_in_shards(spark, in_shard):
    rng = random.Random(3)
    words = ["new", "york", "south", "africa", "é", "guinea", "papua"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(25)}, key=lambda n: (-len(n), n))
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(80)] + [(90, None), (None, "new york"), (91, ""), (92, "new york " * 5000)]
    got = x.tag_dictionary(spark.createDataFrame(texts, "id int, t string").repartition(3), "id", "t", spark.createDataFrame([(n,) for n in names * 2 + ["", None]], "name string"), "name", in_shard)
    assert Counter((r.id, r.name) for r in got.collect()) == Counter((i, n) for i, t in texts if i is not None and t for n in tried(t, names)[0])


def test_many_names_and_long_texts_take_linear_time():
    import time

    names = tuple(sorted({f"name {k} of {k % 977}" for k in range(50_000)}, key=lambda n: (-len(n), n)))
    machine = automaton.automaton(names)

    def took(n):
        text = " and ".join(f"name {k} off {k % 977}, other words" for k in range(n))
        began = time.perf_counter()
        automaton.taken_out(text, names, machine)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 0.5
