import datetime

import pytest
from pyspark.sql import functions as F

from folkmoot.operators import aggregates, coalition, episodes, evidence, graph, lookups, sequences, tables, trajectories, vectors

DOCS = [(1, "A/RES/78/300", "resolution", "2024-04-04"), (2, "A/C.3/78/L.41", "draft", "2024-03-15"), (3, "A/78/481", "committee_report", "2024-03-28"), (4, "A/78/251", "agenda", "2024-01-15"), (5, "A/78/PV.99", "meeting", "2024-04-03"), (6, "A/78/PV.100", "meeting", "2024-04-04"), (7, "A/RES/78/999", "resolution", None)]
EDGES = [(2, 1, "draft_of"), (3, 1, "committee_report_for"), (4, 2, "agenda_item"), (5, 1, "meeting_for"), (6, 1, "meeting_for")]
NAMES = ["United States", "France", "China", "Russian Federation", "United Kingdom", "Germany", "Japan", "Brazil", "India", "South Africa"]


@pytest.fixture(scope="module")
def t(spark):
    docs = spark.createDataFrame([(i, s, k, datetime.date.fromisoformat(d) if d else None, f"title {i}", 78, None, None) for i, s, k, d in DOCS], "id long, symbol string, doc_type string, date date, title string, session int, body_text string, doc_metadata string")
    edges = spark.createDataFrame(EDGES, "source_id long, target_id long, relationship_type string")
    actors = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id long, name string")
    votes = spark.createDataFrame([(1, i, None, ("in_favour", "against", "abstaining")[i % 3], "plenary") for i in range(10)], "document_id long, actor_id long, vote_event_id long, vote_type string, vote_context string")
    said = spark.createDataFrame([(1, 5, 1, NAMES[0]), (2, 5, 2, NAMES[2]), (3, 5, 3, NAMES[1]), (4, 6, 1, NAMES[4]), (5, 6, 2, NAMES[7]), (6, 6, 3, NAMES[8])], "id long, meeting_id long, position_in_meeting int, speaker_affiliation string")
    said = said.withColumns({"text": F.lit("words"), "speaker_name": F.lit("x"), "section_id": F.lit("s"), "agenda_item_number": F.lit("1")})
    links = spark.createDataFrame([(1, 2, "mentioned"), (1, 1, "mentioned"), (2, 1, "mentioned"), (3, 3, "mentioned"), (4, 1, "voting_on"), (5, 1, "voting_on")], "utterance_id long, document_id long, reference_type string")
    return {"docs": docs, "edges": edges, "actors": actors, "votes": votes, "said": said, "links": links}


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed long")


def test_related(spark, t):
    rows = graph.related_documents(t["docs"], t["edges"], seeds(spark, 1, 2, 7, 99)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.seed, set()).add((r.symbol, r.bucket))
    assert {("A/C.3/78/L.41", "drafts"), ("A/78/481", "committee_reports"), ("A/78/PV.99", "meetings"), ("A/78/PV.100", "meetings")} <= by[1]
    assert ("A/RES/78/300", "drafts") in by[1]  # the seed comes back at the second level
    assert {"A/78/251", "A/RES/78/300", "A/78/PV.99", "A/78/PV.100"} <= {s for s, _ in by[2]}
    assert 7 not in by and 99 not in by


def test_related_handles_cycles_and_duplicates(spark, t):
    e = t["edges"].unionByName(t["edges"]).unionByName(spark.createDataFrame([(1, 2, "draft_of"), (1, 1, "draft_of")], t["edges"].schema))
    assert graph.related_documents(t["docs"], e, seeds(spark, 1)).count() == graph.related_documents(t["docs"], e.distinct(), seeds(spark, 1)).count()


def test_reachable(spark, t):
    got = {r.node for r in graph.reachable(t["edges"], seeds(spark, 4)).collect()}
    assert got == {1, 2, 3, 4, 5, 6}
    assert {r.node for r in graph.reachable(t["edges"], seeds(spark, 4), "forward").collect()} == {4, 2, 1}
    assert {r.node for r in graph.reachable(t["edges"], seeds(spark, 7)).collect()} == {7}


def test_chain(spark, t):
    chain = graph.document_chain(t["docs"], t["edges"], seeds(spark, 1))
    assert {(r.symbol, r.depth) for r in chain.collect() if r.depth <= 1} == {("A/RES/78/300", 0), ("A/C.3/78/L.41", 1), ("A/78/481", 1)}
    assert not chain.filter("doc_type = 'meeting'").count()
    loaded = t["edges"].replace({"meeting_for": "meeting_record_for"})
    meetings = graph.chain_meetings(t["docs"], loaded, t["said"], t["links"], chain)
    assert {r.meeting_id for r in meetings.collect()} == {5, 6}
    rows = graph.chain_utterances(t["docs"], t["said"], t["links"], chain, meetings).collect()
    assert {r.utterance_id for r in rows} == {1, 2, 3, 4, 5, 6} and not any(r.truncated for r in rows)
    few = graph.chain_utterances(t["docs"], t["said"], t["links"], chain, meetings, speakers=["brazil"], limit=1).collect()
    assert [r.utterance_id for r in few] == [5] and few[0].truncated


def test_chain_meetings_at_either_end(spark, t):
    e = spark.createDataFrame([(1, 5, "meeting_record_for"), (6, 3, "meeting_record_for"), (3, 3, "x"), (1, 3, "x"), (1, 8, "x")], t["edges"].schema)
    docs = t["docs"].unionByName(t["docs"].filter("id = 7").withColumns({"id": F.lit(8).cast("long"), "doc_type": F.lit(None).cast("string")}))
    chain = graph.document_chain(docs, e, seeds(spark, 1), 2)
    assert {(r.id, r.depth) for r in chain.collect()} == {(1, 0), (3, 1), (1, 2), (3, 2)}  # 3 loops on itself, 8 has no type
    assert {r.meeting_id for r in graph.chain_meetings(docs, e, t["said"].limit(0), t["links"], chain).collect()} == {5, 6}
    row = graph.chain_utterances(t["docs"], t["said"], t["links"], chain, graph.chain_meetings(docs, e, t["said"], t["links"], chain)).filter("rank = 1").first()
    assert (row.speaker_name, row.agenda_item, row.text, row.reference_type) == ("x", "1", "words", "mentioned")


def test_targets_of_vote_events(spark):
    docs = spark.createDataFrame([(1, "A/78/L.19"), (2, "A/RES/78/1"), (3, "A/78/L.19/REV.1")], "id long, symbol string")
    rows = [("a/78/l.19", None), ("L.19", "A/RES/78/1"), ("A/C.3/78/L.19", None), ("3", "A/RES/78/1"), ("L.19/Rev.1", None), (None, "A/RES/78/1"), ("A/C.3/78/L.19", "A/RES/78/1"), ("L.7", None)]
    e = spark.createDataFrame([(i, i, 78, d, r, "x", None, None) for i, (d, r) in enumerate(rows)], "meeting_id long, utterance_id long, session int, draft string, resolution_symbol string, event_type string, description string, result string")
    got = {r.utterance_id: r.target_document_id for r in tables.build_vote_events(e, docs).collect()}
    assert [got[i] for i in range(8)] == [1, 1, None, 2, None, 2, 2, None]


def test_predictions(spark):
    p = spark.createDataFrame([([1.4, 0.2], [1.0, 0.5]), ([2.0, 7.0], [2.0, 7.0])], "p array<double>, q array<double>")
    r = episodes.prediction_metrics(p, "p", "q").first()
    assert r.n == 2 and abs(r.mean_accuracy - 0.75) < 1e-9  # a prediction is rounded, its target is not
    many = spark.createDataFrame([([float(i)], [float(i)]) for i in range(12)], "p array<double>, q array<double>")
    assert episodes.prediction_metrics(many, "p", "q").first().mean_accuracy is None


def test_lookups(spark, t):
    assert lookups.votes_for(t["votes"], t["actors"], t["docs"], symbol="A/RES/78/300", vote_type="in_favour").count() == 4
    with pytest.raises(ValueError):
        lookups.votes_for(t["votes"], t["actors"], t["docs"])
    assert lookups.related_utterances(t["said"], t["docs"], t["links"], ["A/RES/78/300"], "voting_on").count() == 2
    assert lookups.utterances_of(t["said"], t["docs"], ["A/78/PV.99"], ["china"]).count() == 1
    assert lookups.divergent_votes(t["votes"], t["actors"], t["docs"], "United States", "in_favour", "France", "against").collect()[0].symbol == "A/RES/78/300"
    assert [r.symbol for r in lookups.full_text_context(t["docs"], t["edges"], t["docs"].filter("id = 1")).collect()] == ["A/78/PV.100", "A/78/PV.99", "A/78/481", "A/C.3/78/L.41"]
    tallies = aggregates.vote_tallies(t["docs"].select(F.col("id").alias("document_id")), t["votes"], "document_id").filter("document_id = 1").first()
    assert (tallies.in_favour, tallies.against, tallies.abstaining) == (4, 3, 3)


def test_coalition(spark):
    votes = [(d, a, "in_favour" if (d + a) % 2 else "against") for d in range(6) for a in (1, 3)] + [(d, 2, "against" if d < 3 else "in_favour") for d in range(6)] + [(0, 4, "abstaining")]
    df = spark.createDataFrame([(*v, i) for i, v in enumerate(votes)], "document_id long, actor_id long, vote_type string, n int")
    actors = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, name string")
    scores = coalition.require_resolutions(coalition.vote_scores(df, F.col("n")))
    top = coalition.vote_correlation(scores, actors, 0.7).collect()
    assert [(r.a, r.b, r.correlation, r.n_resolutions) for r in top] == [("a", "c", 1.0, 6)]
    every = coalition.vote_correlation(scores, actors, -1.1).collect()
    assert {(r.a, r.b) for r in every} == {("a", "b"), ("a", "c"), ("b", "c")}  # d has no variance
    with pytest.raises(ValueError):
        coalition.require_resolutions(scores, 7)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y"), (3, None, "z"), (4, [0.0, 0.0], "w"), (5, [1.0, 1.0], "v")], "id long, v array<double>, t string")
    rows = vectors.semantic_search(df, [1.0, 0.0], "v", ["id"], "id", text="t").collect()
    assert [(r.id, r.similarity) for r in rows] == [(1, 1.0), (5, 0.7071)]
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert [(r.rank, r.id) for r in vectors.semantic_search_batch(df, q, "id", "v", k=2).orderBy("rank").collect()] == [(1, 1), (2, 5)]


def test_contexts(spark):
    rows = [
        (1, "The President", "I give the floor for an explanation of vote before the vote"), (2, "Mr. A", "we explain"), (3, "The President", "We have heard the last speaker in explanation of vote"),
        (4, "Mr. B", "in explanation of position after the vote"), (5, "The President", "There are 5 draft resolutions. I give the floor for explanation of vote before"), (6, "Mr. C", "draft resolution II"),
        (7, "The President", "We will now take a decision"), (8, "Mr. D", "draft resolution III"),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "s int, p int, speaker_raw string, text string")
    from folkmoot.functions.text import draft_ordinals

    got = {r.p: r for r in sequences.tag_contexts(df.withColumn("draft_mentions", draft_ordinals(F.col("text"))), ["s"], ["p"]).collect()}
    assert got[1].eov_section_announcement == "before_vote" and got[2].speech_timing == "before_vote" and got[3].eov_section_closed
    assert got[4].speech_timing == "after_vote" and got[4].self_declared_explanation and got[6].speech_timing is None
    assert got[6].mentioned_resolutions == ["II"] and got[8].mentioned_resolutions is None and got[5].eov_section_announcement is None


def test_episodes(spark):
    tr = spark.createDataFrame([("x", 1, ["US", "FR"], (["US"], ["CN"], []), (["US", "FR"], [], ["CN"]), "adopted"), ("y", 1, ["US"], None, (["US"], [], []), "rejected")], "trajectory_id string, topic_id int, sponsors array<string>, committee struct<yes:array<string>,no:array<string>,abstain:array<string>>, plenary struct<yes:array<string>,no:array<string>,abstain:array<string>>, final_outcome string")
    e = episodes.episodes(tr, spark.createDataFrame([("US",), ("CN",), ("BR",)], "country string"))
    rows = {(r.country, r.t): r for r in e.collect()}
    assert len(rows) == 9  # y has no committee vote
    assert [rows["US", k].action for k in range(3)] == [0, 1, 1] and rows["US", 2].reward == 1.0 and rows["US", 2].done
    assert [rows["CN", k].action for k in range(3)] == [4, 2, 3] and rows["CN", 2].reward == 0.0
    assert rows["BR", 1].action == 3
    steps = [rows["US", k] for k in range(3)]
    assert [(r.state.stage, r.next_state.stage) for r in steps] == [(0, 0), (0, 2), (2, 3)] and [(r.state.t, r.next_state.t) for r in steps] == [(0, 1), (1, 3), (3, 4)]
    assert [(r.state.agent_is_sponsor, r.state.sponsor_count) for r in steps] == [(0, 2), (1, 2), (1, 2)]
    assert [(r.next_state.committee_yes, r.next_state.plenary_yes) for r in steps] == [(0, 0), (1, 0), (1, 2)]
    v = e.filter("country = 'US' and t = 2").select(episodes.state_vector(F.col("next_state")).alias("v"))
    assert v.first()["v"] == [0.0, 0.0, 0.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0, 0.0, 2.0, 0.0, 1.0, 4.0]
    assert v.select(episodes.state_from_vector(F.col("v")).alias("s")).first()["s"]["stage"] == 3
    stats = episodes.episode_stats(e.filter("country = 'US'"), ["trajectory_id", "country"], is_sponsor=F.col("state.agent_is_sponsor") == 1).first()
    assert (stats.episodes, stats.transitions, stats.mean_length, stats.positive, stats.negative, stats.sponsor_rate) == (1, 3, 3.0, 1, 0, 1.0)
    assert abs(stats.reward_mean - 1 / 3) < 1e-9 and abs(stats.reward_std - 0.4714045) < 1e-6
    both = episodes.episode_stats(e.filter("country in ('US', 'BR')"), ["trajectory_id", "country"], is_sponsor=F.col("state.agent_is_sponsor") == 1).first()
    assert (both.episodes, both.transitions, both.sponsor_rate) == (2, 6, 0.5)
    assert episodes.episode_stats(e.limit(0), ["trajectory_id", "country"]).first().transitions == 0
    a = e.filter("country = 'US'").select(F.lit(1).alias("episode"), "t", "action", "reward")
    same = episodes.compare_trajectories(a, a).first()
    assert (same.action_accuracy, same.outcome_match, same.length_diff) == (1.0, True, 0)
    other = episodes.compare_trajectories(a, a.withColumns({"action": F.lit(9), "reward": F.lit(-1.0)})).first()
    assert (other.action_accuracy, other.outcome_match) == (0.0, False)


def test_reward_fit(spark):
    rows = [(float(i % 2), float(i), float(i % 5), float(i % 3), 0.0, 1.0 if i % 4 else 0.0, 0.0, 2.0 * (i % 2) - 0.5 * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in episodes.FEATURES) + ", reward double").select(F.struct(*episodes.FEATURES).alias("features"), "reward")
    w = episodes.fit_reward(df)
    assert abs(w["is_sponsor"] - 2.0) < 0.01 and abs(w["committee_support"] + 0.5) < 0.01


def test_merge_and_purge(spark, t):
    new = spark.createDataFrame([("A/78/481", "meeting", "new", None, None, "body", None), ("A/78/1", "draft", "fresh", None, 78, None, None)], "symbol string, doc_type string, title string, date date, session int, body_text string, doc_metadata string")
    rows = {r.symbol: r for r in tables.merge_documents(t["docs"], new).collect()}
    assert rows["A/78/481"].title == "title 3" and rows["A/78/481"].body_text == "body" and rows["A/78/481"].id == 3 and len(rows) == 8
    assert {r.symbol: r for r in tables.merge_documents(t["docs"], new, "overwrite").collect()}["A/78/481"].title == "new"
    events = spark.createDataFrame([(1, 5, 1, 1), (2, 6, 4, 2)], "id long, meeting_id long, utterance_id long, target_document_id long")
    gone = spark.createDataFrame([("A/RES/78/300",), ("A/78/PV.99",)], "symbol string")
    out = tables.purge_documents({"documents": t["docs"], "votes": t["votes"], "document_relationships": t["edges"], "utterances": t["said"], "utterance_documents": t["links"], "vote_events": events}, gone)
    assert out["votes"].count() == 0 and out["document_relationships"].count() == 1 and out["utterances"].count() == 3 and out["utterance_documents"].count() == 0
    assert [(r.id, r.target_document_id) for r in out["vote_events"].collect()] == [(2, 2)]


def test_purge_of_many_documents_sorts_no_rows(spark, monkeypatch):
    """More ids than are broadcast are held by tasks that let rows pass, and rows without an id are not one task's."""
    docs = spark.range(40).select("id", F.format_string("A/%d", "id").alias("symbol"))
    said = spark.range(60).select("id", (F.col("id") % 50).alias("meeting_id"))
    events = spark.range(80).select("id", (F.col("id") % 30 + 10).alias("meeting_id"), F.when(F.col("id") % 4 == 0, F.col("id") % 60).alias("utterance_id"), (F.col("id") % 45).alias("target_document_id"))
    votes = spark.range(2000).select((F.col("id") % 40).alias("document_id"), F.when(F.col("id") % 5 == 0, F.col("id") % 90).alias("vote_event_id"), F.col("id").alias("n"))
    edges = spark.range(100).select((F.col("id") % 40).alias("source_id"), (F.col("id") % 7 + 30).alias("target_id"))
    links = spark.range(100).select((F.col("id") % 60).alias("utterance_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("document_id"))
    held = {"documents": docs, "votes": votes, "document_relationships": edges, "utterances": said, "utterance_documents": links, "vote_events": events}
    gone = set(range(0, 40, 3))
    lost = {r.id for r in said.collect() if r.meeting_id in gone}
    stays = [r for r in events.collect() if r.meeting_id not in gone and r.utterance_id not in lost]
    ids = {r.id for r in stays}
    want = {
        "documents": {tuple(r) for r in docs.collect() if r.id not in gone},
        "votes": {tuple(r) for r in votes.collect() if r.document_id not in gone and not (r.vote_event_id in range(80) and r.vote_event_id not in ids)},
        "document_relationships": {tuple(r) for r in edges.collect() if not {r.source_id, r.target_id} & gone},
        "utterances": {tuple(r) for r in said.collect() if r.id not in lost},
        "utterance_documents": {tuple(r) for r in links.collect() if r.document_id not in gone and r.utterance_id not in lost},
        "vote_events": {(*r[:3], None if r.target_document_id in gone else r.target_document_id) for r in stays},
    }
    monkeypatch.setattr(tables, "IDS_A_TASK", 5)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (0, 1000):
            monkeypatch.setattr(tables, "BROADCAST_IDS", most)
            out = tables.purge_documents(held, docs.filter("id % 3 = 0").select("symbol"))
            for name, rows in want.items():
                assert {tuple(r) for r in out[name].collect()} == rows, (most, name)
                plan = out[name]._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" not in plan and (most or "ShuffledHashJoin" in plan), (most, name)
            assert out["votes"].count() == len(want["votes"])
        monkeypatch.setattr(tables, "BROADCAST_IDS", 0)
        dealt = tables.purge_documents({"documents": docs, "votes": votes, "vote_events": events}, docs.filter("id % 3 = 0").select("symbol"))["votes"]
        alone = dealt.filter("vote_event_id is null").groupBy(F.spark_partition_id()).count()
        assert alone.count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_trajectories(spark):
    ref = "array<struct<text:string,url:string>>"
    schema = f"symbol string, kind string, title string, date string, related_documents struct<drafts:{ref},committee_reports:{ref},meeting_records:{ref}>, agenda array<struct<agenda_symbol:string,item_number:int,sub_item:string>>, voting struct<vote_type:string,yes:int,no:int,abstain:int>, introduction string"
    rows = [("A/RES/78/1", "resolutions", "T", "2024-01-01", ([("A/C.3/78/L.1", "u/record/7?x")], [("A/78/481", None)], [("A/78/PV.1", None)]), [("A/78/251", 12, "a")], ("recorded_vote", 91, 54, 6), None), ("A/78/481", "committee-reports", "R", None, ([], [], []), [], None, "see A/C.3/78/SR.5 and A/C.3/78/SR.5")]
    records = spark.createDataFrame(rows, schema)
    index = spark.createDataFrame([("A/78/481", "p"), ("A/C.3/78/SR.5", "q")], "symbol_norm string, path string")
    traces = trajectories.trace_backwards(records, index)
    assert {(r.ref_symbol, r.found) for r in traces.filter("symbol = 'A/RES/78/1'").collect()} == {("A/C.3/78/L.1", False), ("A/78/481", True), ("A/78/PV.1", False), ("A/78/251", False)}
    assert [(r.report, r.record, r.found) for r in trajectories.committee_deliberations(traces, records, index).collect()] == [("A/78/481", "A/C.3/78/SR.5", True)]
    qa = trajectories.trajectory_qa(records, index)
    lost = {r.symbol: r for r in trajectories.missing_with_url(qa, trajectories.references(records)).collect()}
    assert lost["A/C.3/78/L.1"].record_id == "7" and lost["A/78/251"].url == "https://docs.un.org/en/A/78/251"
    assert {r.symbol: (r.status, r.expected, r.found, r.missing) for r in trajectories.trajectory_qa(records, index, records.select("symbol").unionByName(spark.createDataFrame([("none",)], "symbol string"))).collect()} == {"A/RES/78/1": ("incomplete", 4, 1, 3), "A/78/481": ("complete", 0, 0, 0), "none": ("error", 0, 0, 0)}
    assert {r.type: r.missing for r in trajectories.missing_by_type(qa).collect()} == {"draft": 1, "meeting": 1, "agenda_item": 1}
    whole = index.unionByName(spark.createDataFrame([(x, "p") for x in ("A/C.3/78/L.1", "A/78/PV.1", "A/78/251")], index.schema))
    traces = trajectories.trace_backwards(records, whole)
    items = spark.createDataFrame([("A/78/481", 0, "A/C.3/78/L.9", "x", ["X"], [], [], [], None), ("A/78/481", 1, "A/C.3/78/L.1", "", ["US", "FR"], ["US"] * 80, ["CN"] * 29, ["BR"] * 65, "adopted")], "report string, item_no int, draft_symbol string, item_text string, sponsors array<string>, in_favour array<string>, against array<string>, abstaining array<string>, adoption_status string")
    votes = (["US"] * 78, ["CN"] * 30, ["BR"] * 68)
    said = [("A/78/PV.1", 1, 1, "on a/c.3/78/l.1", None, None, [("L.1", "motion_for_division", "rejected"), ("L.7", "x", None)]), ("A/78/PV.1", 2, 2, "World Peace", "A/RES/78/1", votes, None), ("A/78/PV.1", 3, 3, "nothing", None, None, None), ("A/C.3/78/SR.5", 4, 1, "peace", None, None, None)]
    lists = "struct<in_favour:array<string>,against:array<string>,abstaining:array<string>>"
    speeches = spark.createDataFrame(said, f"meeting string, utterance_id int, position int, text string, resolution_symbol string, vote_details {lists}, events array<struct<draft_id:string,event_type:string,adoption_status:string>>")
    steps = trajectories.build_trajectories(traces, records, trajectories.committee_deliberations(traces, records, whole), items, speeches, ["peace"])
    got = steps.filter("trajectory_id = 'A/RES/78/1'").orderBy("t").collect()
    assert [r.stage for r in got] == trajectories.STAGES and [r.t for r in got] == list(range(7)) and got[0].final_outcome == "adopted"
    assert (got[1].sponsors, got[1].actor, got[2].n_statements, got[5].n_statements) == (["FR", "US"], "FR", 1, 2)
    assert (got[3].yes, got[3].no, got[3].abstain, got[3].outcome) == (80, 29, 65, "adopted") and (got[4].action_type, got[4].outcome) == ("motion_for_division", "rejected")
    shift = trajectories.vote_shift(steps).first()
    assert (shift.yes_shift, shift.no_shift, shift.abstain_shift) == (-2, 1, 3)
    # Nothing that is not found gives a step.
    few = trajectories.trace_backwards(records, index)
    assert [r.stage for r in trajectories.build_trajectories(few, records, trajectories.committee_deliberations(few, records, index), items, speeches).orderBy("t").collect()] == ["committee_vote"]


def test_evidence(spark, t):
    df, more = evidence.capped(t["docs"], 3)
    assert df.count() == 3 and more
    assert not evidence.capped(t["docs"], 7)[1]
    assert evidence.pick_text(t["docs"], ["id"], 5).count() == 5
    assert evidence.evidence_text(t["docs"].filter("id = 7").select("id", "symbol", "date"), ["id"]).first()["line"] == "id: 7\nsymbol: A/RES/78/999"
    files = t["docs"].select("symbol", F.array(F.struct(F.lit("Français").alias("language"), F.lit("f").alias("url")), F.struct(F.lit("English").alias("language"), F.lit("e").alias("url"))).alias("files"))
    assert {r.url for r in evidence.source_links(t["docs"].select("symbol"), files).collect()} == {"e"}


def test_empty_inputs(spark, t):
    none = {k: df.limit(0) for k, df in t.items()}
    assert graph.related_documents(none["docs"], none["edges"], seeds(spark, 1)).count() == 0
    assert graph.reachable(none["edges"], seeds(spark, 1)).count() == 1
    assert aggregates.vote_tallies(none["docs"].select(F.col("id").alias("document_id")), none["votes"], "document_id").count() == 0
    stats = aggregates.sponsor_stats(spark.createDataFrame([], "sponsor_count int, final_outcome string")).first()
    assert (stats.mean_sponsors, stats.std_sponsors, stats.adoption_rate) == (30, 10, 0.5)
    stats = aggregates.sponsor_stats(spark.createDataFrame([(0, None), (8, "ADOPTED"), (None, "rejected"), (4, "adopted")], "sponsor_count int, final_outcome string")).first()
    assert (stats.mean_sponsors, stats.std_sponsors, stats.adoption_rate) == (4, 3, 0.75)


def test_evidence_of_a_table_that_grows(spark):
    from folkmoot.plans import registry

    lines = [r["line"] for r in registry.QUERIES["k5_evidence_text_documents"](spark, "/root/testdata/sf0.001").collect()]
    assert len(lines) == 100 < spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert any("... [truncated] ..." in line for line in lines)


def test_search_of_utterances(spark):
    said = [(1, 10, "FRANCE", "A", "1", "x" * 600, [1.0, 0.0]), (2, 10, "Chad", "B", None, "y", [1.0, 1.0]), (3, 11, "France", "C", None, "z", [1.0, 0.1]), (4, 99, "France", "D", None, "no meeting", [1.0, 0.0]), (5, 10, None, "E", None, "w", [1.0, 0.0]), (6, 10, "France", "F", None, "v", None)]
    u = spark.createDataFrame(said, "id long, meeting_id long, speaker_affiliation string, speaker_name string, agenda_item_number string, text string, text_embedding array<double>")
    m = spark.createDataFrame([(10, "A/78/PV.1", 78), (11, "A/77/PV.1", 77)], "id long, symbol string, session int")
    ids = lambda **how: [r.id for r in vectors.semantic_search_utterances(u, m, [1.0, 0.0], **how).collect()]
    assert ids() == [1, 5, 3, 2] and ids(speakers=["franc", "CHAD"]) == [1, 3, 2]
    assert ids(session=78) == [1, 5, 2] and ids(session=77, speakers=["france"]) == [3]
    first = vectors.semantic_search_utterances(u, m, [1.0, 0.0], speakers=["fr"], k=1).first()
    assert first.asDict() == {"id": 1, "speaker_affiliation": "FRANCE", "speaker_name": "A", "agenda_item": "1", "meeting_symbol": "A/78/PV.1", "text_preview": "x" * 500, "similarity": 1.0}


def test_products_of_many_actors(spark, monkeypatch):
    """Blocks and shares give the sums that plain counting gives, and pairs without common votes stay."""
    import random

    rng = random.Random(3)
    cells = {(d, a): rng.choice([1, 1, -1, 0]) for d in range(60) for a in range(40) if rng.random() < (1.0 if d == 7 else 0.2)}
    df = spark.createDataFrame([(a, d, s) for (d, a), s in cells.items()], "actor_id long, document_id long, score int").repartition(3)
    want = {}
    for (d, a), s in cells.items():
        for b in range(a + 1, 40):
            want[a, b] = want.get((a, b), 0) + s * cells.get((d, b), 0)
    for in_block in (512, 10):  # one block, four blocks
        monkeypatch.setattr(coalition, "ACTORS_IN_BLOCK", in_block)
        assert {(r.ia, r.ib): r.p for r in coalition.score_products(df).collect()} == {k: v for k, v in want.items() if v}
    few = {(d, a): 1 - 2 * ((d + a) % 2) for d in range(300) for a in (d % 40, (7 * d + 1) % 40)}
    want = {}
    for (d, a), s in few.items():
        for b in range(a + 1, 40):
            want[a, b] = want.get((a, b), 0) + s * few.get((d, b), 0)
    sparse = spark.createDataFrame([(a, d, s) for (d, a), s in few.items()], "actor_id long, document_id long, score int")
    assert {(r.ia, r.ib): r.p for r in coalition.score_products(sparse).collect()} == {k: v for k, v in want.items() if v}
    far = spark.createDataFrame([(1, 1, 1), (2, 2, -1), (3, 3, -1), (1, 4, 1), (2, 5, -1)], "actor_id long, document_id long, score int")
    actors = spark.createDataFrame([(i, f"a{i}") for i in range(1, 4)], "id long, name string")
    assert {(r.a, r.b): r.correlation for r in coalition.vote_correlation(far, actors, 0.0).collect()} == {("a1", "a2"): 0.667, ("a1", "a3"): 0.408}


def test_dictionary_longest_first(spark):
    from folkmoot.functions.text import tag_dictionary

    texts = [(1, "Guinea-Bissau and Guinea"), (2, "the Guinean"), (3, "nothing"), (4, None), (5, ""), (6, "aXYZb"), (7, "Oman, Romania")]
    names = ["Guinea", "Guinea-Bissau", "XYZ", "a b", "Oman", "", None, "a", "Romania"]
    got = {}
    for r in tag_dictionary(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), "name").collect():
        got.setdefault(r.id, []).append(r.name)
    want = {}
    for i, t in texts:
        for n in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
            if n in (t or ""):
                t = t.replace(n, " ")
                want.setdefault(i, []).append(n)
    assert got == want


@pytest.mark.parametrize("least, in_block", [(0.7, 16), (0.3, 16), (-1.0, 16), (0.7, 512)])
def test_correlation_in_squares(spark, monkeypatch, least, in_block):
    """Against plain matrices, with pairs that pass, pairs without common votes, and actors of no variance."""
    import numpy as np

    monkeypatch.setattr(coalition, "ACTORS_IN_BLOCK", in_block)
    rng = np.random.default_rng(5)
    n, docs = 90, 120
    x = rng.choice([-1, 0, 1], (n, docs)) * (rng.random((n, docs)) < np.linspace(0.02, 1, n)[:, None])
    for a in range(0, 60, 4):
        x[a + 1] = np.where(rng.random(docs) < 0.1, x[a + 1], x[a])  # a pair that votes together
    x[88] = 1
    cells = [(int(a), int(d), int(x[a, d])) for a in range(n) for d in range(docs) if x[a, d] or (a + d) % 7 == 0]
    scores = spark.createDataFrame(cells, "actor_id long, document_id long, score int").repartition(3)
    actors = spark.createDataFrame([(a, f"actor {n - a:03d}") for a in range(n)], "id long, name string")
    x = np.zeros((n, docs))
    for a, d, v in cells:
        x[a, d] = v
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.corrcoef(x)
    want = sorted((-round(float(c[a, b]), 3), *sorted((f"actor {n - a:03d}", f"actor {n - b:03d}"))) for a in range(n) for b in range(a) if c[a, b] > least)[:25]
    got = coalition.vote_correlation(scores, actors, least, 25)
    assert [(-r.correlation, r.a, r.b) for r in got.collect()] == want and want
    if least == 0.7 and in_block == 16:
        sums = scores.groupBy("actor_id").agg(F.sum("score").cast("long").alias("s"), F.sum(F.col("score") * F.col("score")).cast("long").alias("q")).filter(docs * F.col("q") > F.col("s") * F.col("s"))
        assert coalition.possible_squares(coalition.in_blocks(sums, ["q", "s", "actor_id"]), docs, least).count() < 21  # of 6 blocks


def test_correlation_of_fifty_thousand_actors(spark):
    """Far more than one block; squares of actors with few votes and actors with many are not multiplied."""
    rows = spark.range(50_000).select(F.col("id").alias("actor_id"), F.explode(F.sequence(F.lit(0), 1 + (F.col("id") / 5000).cast("int"))).alias("k"))
    scores = rows.select("actor_id", F.pmod(F.xxhash64(F.col("actor_id") - F.when(F.col("actor_id") % 1000 == 1, 1).otherwise(0), "k"), F.lit(3000)).alias("document_id")).distinct().withColumn("score", F.lit(1))
    actors = spark.range(50_000).select("id", F.concat(F.lit("a"), F.format_string("%05d", "id")).alias("name"))
    top = coalition.vote_correlation(scores, actors, 0.95, 1000)
    assert "NestedLoop" not in top._jdf.queryExecution().executedPlan().toString()
    pairs = {(r.a, r.b) for r in top.collect()}
    assert {(f"a{a:05d}", f"a{a + 1:05d}") for a in range(20_000, 50_000, 1000)} <= pairs


def test_episodes_of_many_countries(spark, monkeypatch):
    """A table of countries that is too long to be told to every task gives the same episodes."""
    rows = [(f"t{k}", k, [f"c{k}", "c1"], {"yes": ["c1"], "no": [f"c{k + 1}"], "abstain": []}, {"yes": ["c2"], "no": None, "abstain": ["c1"]}, "adopted" if k % 2 else "rejected") for k in range(6)] + [("t9", 1, None, None, None, None)]
    vote = "struct<yes:array<string>,no:array<string>,abstain:array<string>>"
    told = spark.createDataFrame(rows, f"trajectory_id string, topic_id int, sponsors array<string>, committee {vote}, plenary {vote}, final_outcome string")
    countries = spark.createDataFrame([(f"c{k}",) for k in range(40)] * 2 + [(None,)], "country string")
    want = sorted(map(str, episodes.episodes(told, countries).collect()))
    monkeypatch.setattr(episodes, "BROADCAST_COUNTRIES", 10)
    monkeypatch.setattr(episodes, "COUNTRIES_IN_LIST", 7)
    got = episodes.episodes(told, countries)
    assert sorted(map(str, got.collect())) == want and len(want) == 6 * 40 * 3
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_walks_of_many_seeds(spark):
    """More seeds than one block has bits, against a plain walk; the 64th bit is the sign."""
    import random

    rng = random.Random(5)
    names = [f"d{i}" for i in range(150)]
    pairs = [(rng.choice(names), rng.choice(names), rng.choice("xy")) for _ in range(220)]
    kinds = {n: "meeting" if i % 9 == 0 else "draft" for i, n in enumerate(names)}
    docs = spark.createDataFrame([(n, n, k) for n, k in kinds.items()], "id string, symbol string, doc_type string")
    edges = spark.createDataFrame(pairs, "source_id string, target_id string, relationship_type string").coalesce(1)
    from_all = spark.createDataFrame([(n,) for n in names[:140]], "seed string").coalesce(1)
    around, ahead = {n: set() for n in names}, {n: set() for n in names}
    for a, b, t in pairs:
        around[a].add((b, t))
        around[b].add((a, t))
        ahead[a].add(b)
    related, chain, forward = set(), set(), set()
    for s in names[:140]:
        now, level, seen = {s}, {s}, {s}
        chain.add((s, s, 0))
        for depth in (1, 2):
            found = {(b, t) for n in now for b, t in around[n] if b != n}
            related |= {(s, *f) for f in found}
            now = {b for b, _ in found}
            level = {b for n in level for b, _ in around[n] if kinds[b] != "meeting"}
            chain |= {(s, b, depth) for b in level}
        todo = [s]
        while todo:
            fresh = ahead[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        forward |= {(s, n) for n in seen}
    assert {(r.seed, r.symbol, r.relationship_type) for r in graph.related_documents(docs, edges, from_all, 2).collect()} == related
    got = graph.document_chain(docs, edges, from_all, 2).collect()
    assert {(r.seed, r.id, r.depth) for r in got} == chain and len(got) == len(chain)
    got = graph.reachable(edges, from_all, "forward").collect()
    assert {(r.seed, r.node) for r in got} == forward and len(got) == len(forward)


def test_correlation_by_documents_and_by_squares_agree(spark, monkeypatch):
    """Narrow documents are counted by document; where silent pairs may be among the best, or documents are wide, by squares."""
    import random

    rng = random.Random(11)
    cells = {(rng.randrange(60), d): rng.choice([1, -1]) for d in range(900) for _ in range(3)}
    scores = spark.createDataFrame([(a, d, s) for (a, d), s in cells.items()], "actor_id long, document_id long, score int")
    actors = spark.createDataFrame([(a, f"actor {a % 50:02d}") for a in range(60)], "id long, name string")  # some names twice
    told = lambda least, k: [tuple(r) for r in coalition.vote_correlation(scores, actors, least, k).collect()]
    used = []
    by_document = coalition.pairs_by_document
    monkeypatch.setattr(coalition, "pairs_by_document", lambda *a: used.append(by_document(*a)) or used[-1])
    narrow = [told(-1.0, 20), told(0.02, 500), told(-1.0, 1770)]
    assert [u is None for u in used] == [False, False, True]
    monkeypatch.setattr(coalition, "PAIRS_A_SCORE", 0)
    monkeypatch.setattr(coalition, "ACTORS_IN_BLOCK", 16)
    monkeypatch.setattr(coalition, "SCORES_IN_PACK", 64)
    assert [told(-1.0, 20), told(0.02, 500), told(-1.0, 1770)] == narrow and len(narrow[2]) == 1770
    assert used[3:] == [None] * 3


def test_lists_of_references_are_read_in_one_pass(spark):
    from folkmoot.operators import tables, trajectories

    link = "array<struct<text:string,url:string>>"
    schema = f"symbol string, kind string, related_documents struct<drafts:{link},committee_reports:{link},meeting_records:{link}>, agenda array<struct<id:string,agenda_symbol:string,item_number:int,sub_item:string>>"
    rows = [("A/1", "drafts", ([("a/2", None), ("A/2", None)], None, [("A/3", "u")]), [("A/4", None, None, None), (None, "A/5", None, None)]), ("A/2", "drafts", None, None)]
    records = spark.createDataFrame(rows, schema)
    docs = spark.createDataFrame([(f"A/{k}", f"A/{k}") for k in range(1, 6)], "id string, symbol string")
    edges = tables.build_relationships(records, docs)
    want = {("A/2", "A/1", "draft_of"), ("A/3", "A/1", "meeting_record_for"), ("A/4", "A/1", "agenda_item_for"), ("A/5", "A/1", "agenda_item_for")}
    assert {(r.source_id, r.target_id, r.relationship_type) for r in edges.collect()} == want and edges.count() == 4
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    index = spark.createDataFrame([("A/2", "p")], "symbol_norm string, path string")
    refs = trajectories.references(records)
    same = [trajectories.trajectory_qa(records, index), trajectories.trajectory_qa(records, index, refs=refs)]
    assert sorted(map(str, same[0].collect())) == sorted(map(str, same[1].collect()))
    drafts = trajectories.trace_draft(records, index)
    assert {tuple(r) for r in drafts.collect()} == {("A/1", "agenda_item", "A/5", False), ("A/2", "resolution", "A/1", False)}
    assert "Generate explode" not in drafts._jdf.queryExecution().optimizedPlan().toString()  # the references are written once
