"""Registered queries: every operator of the inventory over the bound tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkmoot._store import delete_at_end
from folkmoot._store import kept as stored
from folkmoot._store import shared_folder as stored_below
from folkmoot.functions import columns as c
from folkmoot.functions import text as x
from folkmoot.operators import aggregates, cells, coalition, episodes, evidence, graph, keyed, lookups, postings, sequences, sketches, tables, trajectories, vectors
from folkmoot.plans import bindings as b
from folkmoot.plans.bindings import ACTORS, BOTH, DOCS, EDGES, LINKS, NODES, STEPS, UTTERANCES, VOTES
from folkmoot.sources import readers, writers
from folkmoot.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- aggregates (2.G)


@query("g1_vote_tallies", f"""SELECT d.id, d.symbol, coalesce(v.f, 0) AS in_favour, coalesce(v.a, 0) AS against, coalesce(v.n, 0) AS abstaining FROM {DOCS} d LEFT JOIN
 (SELECT document_id, count(*) FILTER (vote_type = 'in_favour') f, count(*) FILTER (vote_type = 'against') a, count(*) FILTER (vote_type = 'abstaining') n FROM {VOTES} GROUP BY 1) v ON d.id = v.document_id""")
def g1(s, d):
    return aggregates.vote_tallies(b.documents(s, d).select(F.col("id").alias("document_id"), "symbol"), b.votes(s, d), "document_id").withColumnRenamed("document_id", "id")


@query("g2_voters_by_type", f"SELECT document_id, vote_type, string_agg(DISTINCT name, ',' ORDER BY name) AS voters FROM {VOTES} v JOIN {ACTORS} a ON v.actor_id = a.id GROUP BY 1, 2")
def g2(s, d):
    return aggregates.voters_by_type(b.votes(s, d), b.actors(s, d), "document_id").withColumn("voters", F.array_join("voters", ","))


@query("g3_vote_distribution", f"SELECT symbol, vote_type, count(*) AS n FROM {VOTES} v JOIN {DOCS} d ON v.document_id = d.id GROUP BY 1, 2")
def g3(s, d):
    return aggregates.vote_distribution(b.votes(s, d), b.documents(s, d))


@query("g4_docs_per_session", f"SELECT session, count(*) AS n FROM {DOCS} GROUP BY 1")
def g4(s, d):
    return aggregates.docs_per_session(b.documents(s, d))


@query("g5_top_voters", f"SELECT name, count(*) AS n FROM {VOTES} v JOIN {ACTORS} a ON v.actor_id = a.id GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def g5(s, d):
    return aggregates.top_voters(b.votes(s, d), b.actors(s, d), 5)


@query("g5_most_active_by_session", f"""WITH c AS (SELECT session, actor_id, count(*) AS n FROM {VOTES} v JOIN {DOCS} d ON v.document_id = d.id WHERE session IS NOT NULL AND actor_id IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, actor_id) AS rank FROM c), f AS (SELECT session, coalesce(max(n) FILTER (rank = 51), 0) AS floor FROM r GROUP BY 1),
 m AS (SELECT actor_id, sum(n) AS at_least, sum(floor) AS own FROM r JOIN f USING (session) WHERE rank <= 50 GROUP BY 1)
 SELECT actor_id, CAST(at_least AS BIGINT) AS at_least, CAST(at_least + (SELECT sum(floor) FROM f) - own AS BIGINT) AS at_most FROM m ORDER BY at_least DESC, actor_id LIMIT 20""")
def g5b(s, d):
    counts = stored(sketches.voter_counts(b.votes(s, d), b.documents(s, d), keep=50), "counts")
    return sketches.most_active(counts, 20)


@query("g6_coverage_by_type", "SELECT lang AS doc_type, count(*) AS total, count(*) FILTER (coalesce(text, '') <> '') AS with_text FROM documents GROUP BY 1")
def g6(s, d):
    return aggregates.coverage_by_type(b.table(s, d, "documents").withColumnRenamed("lang", "doc_type"), "text")


@query("g7_text_coverage", "SELECT count(*) AS total, count(*) FILTER (coalesce(text, '') <> '') AS with_text, CAST(round(avg(length(text))) AS BIGINT) AS mean_length FROM documents")
def g7(s, d):
    return aggregates.text_coverage(b.table(s, d, "documents"), "text")


@query("g8_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "supplier", "events", "conversations", "documents", "pages")))
def g8(s, d):
    return aggregates.table_counts({t: b.table(s, d, t) for t in ("orders", "lineitem", "supplier", "events", "conversations", "documents", "pages")})


@query("g9_missing_summary", f"""WITH m AS (SELECT o_orderpriority AS type, CAST(o_custkey AS VARCHAR) AS symbol FROM orders), e AS (SELECT type, symbol, count(*) AS n FROM m GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, symbol) AS rank, sum(n) OVER (PARTITION BY type) AS total, count(*) OVER (PARTITION BY type) AS distinct_symbols FROM e)
 SELECT type, CAST(total AS BIGINT) AS total, distinct_symbols, CAST(rank AS INTEGER) AS rank, symbol, n FROM r WHERE rank <= 10""")
def g9(s, d):
    return aggregates.missing_summary(b.table(s, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("symbol")))


@query("g10_meeting_stats", f"""SELECT m.*, coalesce(r.n, 0) AS document_references FROM (SELECT meeting_id, count(DISTINCT section_id) AS section_count, count(*) AS utterance_count, count(DISTINCT speaker_name) AS unique_speakers FROM {UTTERANCES} GROUP BY 1) m
 LEFT JOIN (SELECT meeting_id, count(DISTINCT document_id) AS n FROM {LINKS} l JOIN {UTTERANCES} u ON l.utterance_id = u.id GROUP BY 1) r USING (meeting_id)""")
def g10(s, d):
    return aggregates.meeting_stats(b.utterances(s, d), b.links(s, d))


@query("g11_mention_counts", f"SELECT symbol, count(*) AS mentions FROM {LINKS} l JOIN {DOCS} d ON l.document_id = d.id GROUP BY 1")
def g11(s, d):
    return aggregates.mention_counts(b.links(s, d), b.documents(s, d))


@query("g12_distinct_voters", f"SELECT DISTINCT name FROM {VOTES} v JOIN {ACTORS} a ON v.actor_id = a.id WHERE vote_type = 'against'")
def g12(s, d):
    return aggregates.distinct_voters(b.votes(s, d), b.actors(s, d), "against")


@query("g13_event_vote_counts", "SELECT e.event_id AS id, e.event_type AS description, coalesce(v.n, 0) AS votes FROM events e LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) v ON e.event_id = v.l_orderkey")
def g13(s, d):
    events = b.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("description"))
    return aggregates.event_vote_counts(events, b.votes(s, d).withColumn("vote_event_id", F.col("document_id")))


@query("g14_parse_completeness", """SELECT lang AS type, count(DISTINCT d.doc_id) AS inputs, count(DISTINCT d.doc_id) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (l.doc_id IS NULL) = 0 AS complete
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def g14(s, d):
    docs = b.table(s, d, "documents").select(F.col("lang").alias("type"), F.col("doc_id").alias("stem"))
    return aggregates.parse_completeness(docs, docs.join(b.table(s, d, "labels").select(F.col("doc_id").alias("stem")), "stem", "left_semi"))


@query("g15_sponsor_stats", """WITH t AS (SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN coalesce(n, 0) END AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON o_orderkey = l_orderkey)
 SELECT CAST(trunc(avg(n)) AS INTEGER) AS mean_sponsors, CAST(trunc(stddev_pop(n)) AS INTEGER) AS std_sponsors, round(avg(CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE 1.0 END), 6) AS adoption_rate FROM t""")
def g15(s, d):
    """Meetings have no draft, some drafts have no sponsor, and some outcomes are missing or in capitals."""
    n = b.votes(s, d).filter("vote_type = 'in_favour'").groupBy(F.col("document_id").alias("id")).agg(F.countDistinct("actor_id").alias("n"))
    t = b.documents(s, d).join(n, "id", "left").withColumn("sponsor_count", F.when(F.col("doc_type") != "meeting", F.coalesce("n", F.lit(0))))
    t = t.withColumn("final_outcome", F.when(F.col("doc_type") == "resolution", "ADOPTED").when(F.col("doc_type") == "meeting", "rejected"))
    return aggregates.sponsor_stats(t).withColumn("adoption_rate", F.round("adoption_rate", 6))


@query("g16_conversation_stats", """WITH e AS (SELECT user_id, count(*) AS turns, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1), t AS (SELECT count(*) AS conversations, round(avg(turns), 6) AS mean_turns, min(first) AS oldest, max(last) AS newest FROM e)
 SELECT t.*, k.type, k.n FROM t, (SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1) k""")
def g16(s, d):
    return aggregates.conversation_stats(b.table(s, d, "events"), "user_id", "event_type", "ts").withColumn("mean_turns", F.round("mean_turns", 6))


@query("g16_expired", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, last FROM l, n WHERE epoch(date_trunc('second', last)) < epoch(date_trunc('second', now)) - 12 * 3600")
def g16b(s, d):
    e = b.table(s, d, "events")
    newest = e.agg(F.max("ts").alias("ts")).first()["ts"]
    return aggregates.expire(e, "user_id", "ts", 12, F.lit(newest))


SESSIONS = """SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS turns FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number
 FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, number"""


@query("g16_sessions", SESSIONS)
def g16c(s, d):
    return aggregates.conversation_sessions(b.table(s, d, "events"), "user_id", "ts", 12)


@query("g16_streamed_sessions", f"SELECT user_id, first, last, turns FROM ({SESSIONS}), (SELECT max(ts) AS newest FROM events) WHERE last + INTERVAL 13 HOURS <= date_trunc('milliseconds', newest)")
def g16d(s, d):
    e = b.table(s, d, "events")
    out = f"{stored_below(s)}/sessions-{uuid.uuid4().hex[:12]}"
    turns = s.readStream.schema(e.schema).parquet(f"{d}/{{events}}.parquet")  # a pattern, as the table may be one file
    sessions.stream_sessions(turns, ["event_id"], "user_id", "ts", 12, "1 hour", f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = s.read.schema(e.select("user_id", F.col("ts").cast("timestamp").alias("first"), F.col("ts").cast("timestamp").alias("last"), F.lit(0).cast("long").alias("turns")).schema).parquet(f"{out}/rows")
    return rows.withColumn("first", F.col("first").cast(e.schema["ts"].dataType)).withColumn("last", F.col("last").cast(e.schema["ts"].dataType))


@query("g17_top_voters_on", f"SELECT name, count(*) AS n FROM {VOTES} v JOIN {ACTORS} a ON v.actor_id = a.id JOIN {DOCS} d ON v.document_id = d.id WHERE vote_type = 'against' AND title ILIKE '%urgent%' GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def g17(s, d):
    return aggregates.top_voters_on(b.votes(s, d), b.actors(s, d), b.documents(s, d), "urgent", "against", 10)


# ---- look-ups (2.F)


@query("f6_votes_for", f"SELECT a.name AS actor, vote_type, vote_context FROM {VOTES} v JOIN {ACTORS} a ON v.actor_id = a.id JOIN {DOCS} d ON v.document_id = d.id WHERE d.id = (SELECT min(o_orderkey) FROM orders)")
def f6(s, d):
    docs = b.documents(s, d)
    first = docs.orderBy("id").first()
    return lookups.votes_for(b.votes(s, d), b.actors(s, d), docs, symbol=first["symbol"] if first else "")


@query("f7_vote_events", f"""SELECT e.event_id AS id, m.symbol AS meeting, t.symbol AS target, e.event_type, CAST(e.props AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS result, coalesce(v.f, 0) AS in_favour, coalesce(v.a, 0) AS against, coalesce(v.n, 0) AS abstaining
 FROM events e JOIN {NODES} m0 ON 'C' || CAST(e.user_id AS VARCHAR) = m0.id JOIN (SELECT id, id AS symbol FROM {NODES}) m ON m.id = m0.id LEFT JOIN (SELECT id, id AS symbol FROM {NODES}) t ON 'O' || CAST(e.event_id AS VARCHAR) = t.id
 LEFT JOIN (SELECT document_id, count(*) FILTER (vote_type = 'in_favour') f, count(*) FILTER (vote_type = 'against') a, count(*) FILTER (vote_type = 'abstaining') n FROM {VOTES} GROUP BY 1) v ON v.document_id = e.event_id""")
def f7(s, d):
    e = b.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("meeting_id"), F.concat(F.lit("O"), F.col("event_id").cast("string")).alias("target_document_id"), "event_type", F.col("props").alias("description"), F.lit(None).cast("string").alias("result"))
    nodes = b.nodes(s, d).withColumn("session", F.lit(None).cast("int"))
    return lookups.vote_events(e, nodes, b.votes(s, d).withColumn("vote_event_id", F.col("document_id")))


@query("f8_utterances_of", f"SELECT meeting_id AS meeting, position_in_meeting, speaker_name, speaker_affiliation, left(text, 500) AS text FROM {UTTERANCES} u JOIN {NODES} n ON u.meeting_id = n.id WHERE speaker_affiliation ILIKE '%assist%'")
def f8(s, d):
    return lookups.utterances_of(b.utterances(s, d), b.nodes(s, d), countries=["assist"])


@query("f9_related_utterances", f"""SELECT d.symbol, u.meeting_id AS meeting, CAST(NULL AS DATE) AS date, position_in_meeting, l.utterance_id, speaker_name, speaker_affiliation, reference_type, left(text, 500) AS text
 FROM {LINKS} l JOIN {DOCS} d ON l.document_id = d.id JOIN {UTTERANCES} u ON l.utterance_id = u.id JOIN {NODES} n ON u.meeting_id = n.id WHERE reference_type = 'voting_on' ORDER BY symbol, position_in_meeting, utterance_id LIMIT 200""")
def f9(s, d):
    docs = b.documents(s, d).select(F.concat(F.lit("O"), F.col("id").cast("string")).alias("id"), "symbol", F.lit(None).cast("date").alias("date"))
    meetings = b.nodes(s, d).filter(~F.col("id").startswith("O")).select("id", "symbol", "date")
    return lookups.related_utterances(b.utterances(s, d), docs.unionByName(meetings), b.graph_links(s, d), reference_type="voting_on")


@query("f10_document_details", f"SELECT id, symbol, doc_type, session, title, date, custkey FROM {DOCS} WHERE id IN (SELECT min(o_orderkey) FROM orders UNION ALL SELECT max(o_orderkey) FROM orders)")
def f10(s, d):
    docs = b.documents(s, d)
    ends = docs.agg(F.min_by("symbol", "id").alias("a"), F.max_by("symbol", "id").alias("z")).first()
    return lookups.document_details(docs, [ends["a"] or "", ends["z"] or ""])


BUCKET = "CASE WHEN relationship_type = 'meeting_record_for' OR doc_type IN ('meeting', 'committee_meeting') THEN 'meetings' WHEN relationship_type = 'draft_of' OR doc_type = 'draft' THEN 'drafts' WHEN relationship_type = 'committee_report_for' OR doc_type = 'committee_report' THEN 'committee_reports' WHEN relationship_type = 'agenda_item_for' OR doc_type IN ('agenda_item', 'agenda') THEN 'agenda_items' END"


@query("f11_full_text_context", f"SELECT target_id, n.id AS symbol, doc_type, date, relationship_type, {BUCKET} AS bucket FROM {EDGES} e JOIN {NODES} n ON e.source_id = n.id")
def f11(s, d):
    n = b.nodes(s, d).withColumn("session", F.lit(None).cast("int"))
    return lookups.full_text_context(n, b.edges(s, d), n)


@query("f12_link_report", f"""SELECT id AS target, 'resolution' AS relationship_type, id AS symbol, doc_type, title FROM {NODES} WHERE doc_type = 'agenda_item' UNION ALL
 SELECT t.id, e.relationship_type, n.id, n.doc_type, n.title FROM {NODES} t JOIN {EDGES} e ON e.target_id = t.id JOIN {NODES} n ON e.source_id = n.id WHERE t.doc_type = 'agenda_item'""")
def f12(s, d):
    return lookups.link_report(b.nodes(s, d).withColumn("doc_metadata", F.lit(None).cast("string")), b.edges(s, d), F.col("doc_type") == "agenda_item")


@query("f13_search_titles", f"SELECT symbol, doc_type, title, date FROM {DOCS} WHERE title ILIKE '%urgent%' AND doc_type = 'resolution' ORDER BY date DESC, symbol LIMIT 10")
def f13(s, d):
    return lookups.search_titles(b.documents(s, d), "urgent", "resolution", 10)


@query("f14_actor_vote", f"SELECT name AS actor, symbol, vote_type, vote_context FROM {VOTES} v JOIN {ACTORS} a ON v.actor_id = a.id JOIN {DOCS} d ON v.document_id = d.id WHERE name ILIKE '%000001%'")
def f14(s, d):
    return lookups.actor_vote(b.votes(s, d), b.actors(s, d), b.documents(s, d), "000001")


@query("f15_drafts_to_resolutions", f"SELECT source_id AS draft, target_id AS resolution FROM {EDGES} WHERE relationship_type = 'draft_of'")
def f15(s, d):
    return lookups.drafts_to_resolutions(b.nodes(s, d), b.edges(s, d))


# The same look-ups by trigram postings, which give the same rows.


@query("f8_utterances_by_postings", SQL["f8_utterances_of"])
def f8b(s, d):
    u = b.utterances(s, d)
    return lookups.utterances_of(u, b.nodes(s, d), countries=["assist"], index=postings.index(u, "id", "speaker_affiliation"))


@query("f9_related_by_postings", SQL["f9_related_utterances"].replace("WHERE reference_type = 'voting_on'", "WHERE speaker_affiliation ILIKE '%ser%' OR speaker_name ILIKE '%ser%'"))
def f9b(s, d):
    docs = b.documents(s, d).select(F.concat(F.lit("O"), F.col("id").cast("string")).alias("id"), "symbol", F.lit(None).cast("date").alias("date"))
    u, meetings = b.utterances(s, d), b.nodes(s, d).filter(~F.col("id").startswith("O")).select("id", "symbol", "date")
    return lookups.related_utterances(u, docs.unionByName(meetings), b.graph_links(s, d), country="ser", index=(postings.index(u, "id", "speaker_affiliation"), postings.index(u, "id", "speaker_name")))


@query("f13_titles_by_postings", SQL["f13_search_titles"])
def f13b(s, d):
    docs = b.documents(s, d)
    return lookups.search_titles(docs, "urgent", "resolution", 10, index=postings.index(docs, "id", "title"))


@query("f14_actor_by_postings", SQL["f14_actor_vote"])
def f14b(s, d):
    a = b.actors(s, d)
    return lookups.actor_vote(b.votes(s, d), a, b.documents(s, d), "000001", index=postings.index(a, "id", "name"))


@query("j8_relevant_by_postings", """WITH h AS (SELECT 'T' || CAST(item_id AS VARCHAR) AS trajectory_id, lower(left(text, 16)) AS draft FROM benchmark)
 SELECT trajectory_id, coalesce(source, '-') AS meeting, count(DISTINCT doc_id) AS statements FROM documents, h WHERE contains(lower(text), draft) OR contains(lower(text), ' thion ') GROUP BY 1, 2""")
def j8(s, d):
    """Documents that hold the beginning of a benchmark item, or a keyword, by source; each item a trajectory, each source a
    meeting."""
    docs = b.table(s, d, "documents").select(F.col("doc_id").alias("utterance_id"), F.coalesce("source", F.lit("-")).alias("meeting"), "text")
    items = b.table(s, d, "benchmark").select(F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("trajectory_id"), F.array(F.left("text", F.lit(16))).alias("drafts"))
    held = docs.select("meeting").distinct().withColumn("one", F.lit(1)).join(items.withColumn("one", F.lit(1)), "one").drop("one")
    asked = items.select(F.explode("drafts").alias("pattern")).unionByName(s.createDataFrame([(" thion ",)], "pattern string"))
    return trajectories.relevant_utterances(docs, held, [" thion "], index=postings.index(docs, "utterance_id", "text", asked, literal=True))


@query("f16_divergent_votes", f"""SELECT DISTINCT d.symbol FROM {VOTES} a JOIN {VOTES} b ON a.document_id = b.document_id JOIN {DOCS} d ON d.id = a.document_id
 WHERE a.vote_type = 'in_favour' AND b.vote_type = 'against' AND a.actor_id = (SELECT id FROM {ACTORS} ORDER BY name LIMIT 1) AND b.actor_id <> a.actor_id AND b.actor_id = (SELECT id FROM {ACTORS} ORDER BY name LIMIT 1 OFFSET 1)""")
def f16(s, d):
    two = [r["name"] for r in b.actors(s, d).orderBy("name").limit(2).collect()] + ["", ""]
    return lookups.divergent_votes(b.votes(s, d), b.actors(s, d), b.documents(s, d), two[0], "in_favour", two[1], "against")


@query("f17_utterances_by_agenda", f"SELECT meeting_id AS meeting, position_in_meeting, speaker_name, left(text, 500) AS text FROM {UTTERANCES} u JOIN {NODES} n ON u.meeting_id = n.id WHERE agenda_item_number = '1'")
def f17(s, d):
    return lookups.utterances_by_agenda(b.utterances(s, d), b.nodes(s, d), "1")


@query("f16_divergent_customers", f"""SELECT DISTINCT c_name AS symbol FROM {VOTES} a JOIN orders p ON a.document_id = p.o_orderkey JOIN customer ON c_custkey = p.o_custkey JOIN orders q ON q.o_custkey = p.o_custkey JOIN {VOTES} b ON b.document_id = q.o_orderkey
 WHERE a.vote_type = 'in_favour' AND b.vote_type = 'against' AND a.actor_id = (SELECT id FROM {ACTORS} ORDER BY name LIMIT 1) AND b.actor_id = (SELECT id FROM {ACTORS} ORDER BY name LIMIT 1 OFFSET 1)""")
def f16b(s, d):
    """Customers as documents, so that two suppliers meet: in favour by the first, against by the second."""
    two = [r["name"] for r in b.actors(s, d).orderBy("name").limit(2).collect()] + ["", ""]
    orders = b.table(s, d, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey")
    votes = b.votes(s, d).join(orders, "document_id").drop("document_id").withColumnRenamed("o_custkey", "document_id")
    docs = b.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("symbol"))
    return lookups.divergent_votes(votes, b.actors(s, d), docs, two[0], "in_favour", two[1], "against")


@query("f19_documents_by_subject", f"SELECT symbol, doc_type, upper(trim(title)) AS subject FROM {DOCS}")
def f19(s, d):
    docs = b.documents(s, d)
    subjects, bridge = tables.build_subjects(docs.withColumn("subjects", F.array("title")))
    return lookups.documents_by_subject(docs, bridge, subjects)


@query("f20_sponsors_of", f"SELECT symbol, name AS actor, sponsorship_type FROM (SELECT document_id, actor_id, CASE WHEN min(l_linenumber) = 1 THEN 'initial' ELSE 'additional' END AS sponsorship_type FROM {VOTES} GROUP BY 1, 2) p JOIN {DOCS} d ON p.document_id = d.id JOIN {ACTORS} a ON p.actor_id = a.id")
def f20(s, d):
    p = b.votes(s, d).groupBy("document_id", "actor_id").agg(F.when(F.min("l_linenumber") == 1, "initial").otherwise("additional").alias("sponsorship_type"))
    return lookups.sponsors_of(b.documents(s, d), p, b.actors(s, d))


@query("f21_meetings_of", f"SELECT e.target_id AS symbol, e.source_id AS meeting FROM {EDGES} e JOIN {NODES} n ON n.id = e.source_id WHERE relationship_type = 'meeting_record_for' AND doc_type = 'meeting'")
def f21(s, d):
    return lookups.meetings_of(b.nodes(s, d), b.edges(s, d))


# ---- graph

NATIONS = "(SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS seed FROM nation)"


def nation_seeds(s, d):
    return b.table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("seed"))


@query("f1_related_documents", f"""WITH RECURSIVE b AS (SELECT * FROM {BOTH} WHERE node <> next), w AS (SELECT seed, next AS node, relationship_type, 1 AS depth FROM {NATIONS} s JOIN b ON b.node = s.seed
 UNION SELECT w.seed, b.next, b.relationship_type, w.depth + 1 FROM w JOIN b ON b.node = w.node WHERE w.depth < 3)
 SELECT DISTINCT seed, n.id AS symbol, doc_type, relationship_type, {BUCKET} AS bucket FROM w JOIN {NODES} n ON w.node = n.id""")
def f1(s, d):
    return graph.related_documents(b.nodes(s, d), b.edges(s, d), nation_seeds(s, d))


@query("f2_reachable", f"""WITH RECURSIVE w AS (SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS seed, 'R' || CAST(r_regionkey AS VARCHAR) AS node FROM region UNION SELECT w.seed, b.next FROM w JOIN {BOTH} b ON b.node = w.node) SELECT seed, node FROM w""")
def f2(s, d):
    return graph.reachable(b.edges(s, d), b.table(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("seed")))


# Line items as links between suppliers and the customers of their orders, in components of one nation and one half-year each.
TRADE = """(SELECT 'S' || CAST(l_suppkey AS VARCHAR) || g AS source_id, 'C' || CAST(o_custkey AS VARCHAR) || g AS target_id FROM (SELECT l_suppkey, o_custkey, '/' || CAST(s_nationkey AS VARCHAR) || '/' || CAST(year(o_orderdate) * 2 + month(o_orderdate) // 7 AS VARCHAR) AS g
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = c_nationkey))"""


@query("f2_components", f"""WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM {TRADE}), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node),
 n AS (SELECT node, min(root) AS component FROM r GROUP BY 1) SELECT node AS id, component, count(*) OVER (PARTITION BY component) AS size FROM n""")
def f2c(s, d):
    """Groups of suppliers and customers that traded, however indirectly, within a nation and half a year."""
    o, c_ = b.table(s, d, "orders"), b.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    su = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    half = F.year("o_orderdate") * 2 + (F.month("o_orderdate") / 7).cast("int")
    rows = b.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(su, "l_suppkey").join(c_, "o_custkey").filter("s_nationkey = c_nationkey")
    group = F.concat(F.lit("/"), F.col("s_nationkey").cast("string"), F.lit("/"), half.cast("string"))
    edges = rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), group).alias("source_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string"), group).alias("target_id"))
    return graph.component_sizes(edges, edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct())


@query("f2_reachable_forward", f"""WITH RECURSIVE w AS (SELECT source_id AS seed, source_id AS node FROM {EDGES} WHERE relationship_type = 'agenda_item_for' UNION SELECT w.seed, e.target_id FROM w JOIN {EDGES} e ON e.source_id = w.node) SELECT seed, node FROM w""")
def f2b(s, d):
    e = b.edges(s, d)
    return graph.reachable(e, e.filter("relationship_type = 'agenda_item_for'").select(F.col("source_id").alias("seed")), "forward")


# The graph with loops on some nodes, suppliers of no type, and meeting records at either end of their edges.
CHAIN_NODES = f"(SELECT id, CASE WHEN NOT regexp_matches(id, '^S.*7$') THEN doc_type END AS doc_type FROM {NODES})"
CHAIN_EDGES = f"(SELECT * FROM {EDGES} UNION ALL SELECT id, id, 'agenda_item_for' FROM {NODES} WHERE id LIKE 'R%' OR id LIKE 'C%5')"


def chain_walk(nodes: str, edges: str, seeds: str) -> str:
    """A walk over documents that are no meetings, as rows (seed, node, depth)."""
    return f"""WITH RECURSIVE o AS (SELECT id FROM {nodes} WHERE doc_type NOT IN ('meeting', 'committee_meeting')),
 b AS (SELECT DISTINCT node, next FROM (SELECT source_id AS node, target_id AS next FROM {edges} UNION ALL SELECT target_id, source_id FROM {edges}) x JOIN o ON o.id = x.next),
 w AS (SELECT seed, seed AS node, 0 AS depth FROM {seeds} UNION SELECT w.seed, b.next, w.depth + 1 FROM w JOIN b ON b.node = w.node WHERE w.depth < 4)"""


@query("f3_document_chain", f"{chain_walk(CHAIN_NODES, CHAIN_EDGES, NATIONS)} SELECT seed, w.node AS id, w.node AS symbol, doc_type, depth FROM w JOIN {CHAIN_NODES} n ON n.id = w.node")
def f3(s, d):
    n = b.nodes(s, d)
    loops = n.filter(F.col("id").startswith("R") | F.col("id").rlike("^C.*5$")).select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("agenda_item_for").alias("relationship_type"))
    untyped = n.withColumn("doc_type", F.when(~F.col("id").rlike("^S.*7$"), F.col("doc_type")))
    return graph.document_chain(untyped, b.edges(s, d).unionByName(loops), nation_seeds(s, d))


# Customers count as meetings here, so that speeches have them; of their orders' edges, some name the meeting as source,
# some as target, and some are no meeting records. Every fifth speech of a conversation is linked to nothing.
SPOKEN_NODES = f"(SELECT id, CASE WHEN id LIKE 'C%' THEN 'meeting' ELSE doc_type END AS doc_type FROM {NODES})"
SPOKEN_EDGES = f"""(SELECT CASE WHEN k = 1 THEN target_id ELSE source_id END AS source_id, CASE WHEN k = 1 THEN source_id ELSE target_id END AS target_id, CASE WHEN k < 2 THEN 'meeting_record_for' ELSE relationship_type END AS relationship_type
 FROM (SELECT *, CASE WHEN source_id LIKE 'O%' THEN CAST(substr(source_id, 2) AS BIGINT) % 3 ELSE 2 END AS k FROM {EDGES}) UNION ALL SELECT 'O' || CAST(id AS VARCHAR), 'O' || CAST(id + 1 AS VARCHAR), 'draft_of' FROM {DOCS} WHERE id % 4 = 0)"""
SPOKEN_LINKS = f"(SELECT utterance_id, 'O' || CAST(document_id AS VARCHAR) AS document_id, reference_type FROM {LINKS} WHERE utterance_id % 5 <> 4)"
SPOKEN_WALK = f"""{chain_walk(SPOKEN_NODES, SPOKEN_EDGES, "(SELECT DISTINCT document_id AS seed FROM " + SPOKEN_LINKS + ")")},
 ids AS (SELECT DISTINCT seed, w.node FROM w JOIN {SPOKEN_NODES} n ON n.id = w.node),
 m AS (SELECT seed, n.id AS meeting_id FROM ids JOIN {SPOKEN_EDGES} e ON (e.source_id = ids.node OR e.target_id = ids.node) AND e.relationship_type = 'meeting_record_for'
   JOIN {SPOKEN_NODES} n ON n.id = CASE WHEN e.source_id = ids.node THEN e.target_id ELSE e.source_id END WHERE n.doc_type IN ('meeting', 'committee_meeting')
  UNION SELECT seed, n.id FROM ids JOIN {SPOKEN_LINKS} l ON l.document_id = ids.node JOIN {UTTERANCES} u ON u.id = l.utterance_id JOIN {NODES} n ON n.id = u.meeting_id)"""


def spoken_chain(s, d):
    n = b.nodes(s, d)
    docs = n.withColumn("doc_type", F.when(F.col("id").startswith("C"), "meeting").otherwise(F.col("doc_type")))
    e = b.edges(s, d)
    k = F.when(F.col("source_id").startswith("O"), F.substring("source_id", 2, 20).cast("long") % 3).otherwise(2)
    turned = e.select(F.when(k == 1, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(k == 1, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"), F.when(k < 2, "meeting_record_for").otherwise(F.col("relationship_type")).alias("relationship_type"))
    o = lambda c: F.concat(F.lit("O"), c.cast("string"))
    drafts = b.documents(s, d).filter("id % 4 = 0").select(o(F.col("id")).alias("source_id"), o(F.col("id") + 1).alias("target_id"), F.lit("draft_of").alias("relationship_type"))
    links = b.graph_links(s, d).filter("utterance_id % 5 <> 4")
    edges = turned.unionByName(drafts)
    return docs, edges, links, graph.document_chain(docs, edges, links.select(F.col("document_id").alias("seed")).distinct())


@query("f4_chain_meetings", f"{SPOKEN_WALK} SELECT seed, meeting_id FROM m")
def f4(s, d):
    docs, e, links, chain = spoken_chain(s, d)
    return graph.chain_meetings(docs, e, b.utterances(s, d), links, chain)


@query("f5_chain_utterances", f"""{SPOKEN_WALK},
 r AS (SELECT m.seed, m.meeting_id, u.id AS utterance_id, u.position_in_meeting, u.speaker_name, u.speaker_affiliation, u.agenda_item_number, u.text, l.document_id AS referenced, l.reference_type
   FROM m JOIN {UTTERANCES} u ON u.meeting_id = m.meeting_id LEFT JOIN {SPOKEN_LINKS} l ON l.utterance_id = u.id WHERE l.document_id IS NULL OR EXISTS (SELECT 1 FROM ids WHERE ids.seed = m.seed AND ids.node = l.document_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY position_in_meeting, utterance_id, referenced NULLS FIRST) AS rank FROM r), t AS (SELECT * FROM k WHERE rank <= 100)
 SELECT seed, CAST(rank AS INTEGER) AS rank, meeting_id AS meeting_symbol, CAST(NULL AS DATE) AS date, utterance_id, position_in_meeting, speaker_name, speaker_affiliation, agenda_item_number AS agenda_item, left(coalesce(text, ''), 500) AS text, referenced, reference_type, count(*) OVER (PARTITION BY seed) >= 100 AS truncated FROM t""")
def f5(s, d):
    docs, e, links, chain = spoken_chain(s, d)
    meetings = graph.chain_meetings(docs, e, b.utterances(s, d), links, chain)
    return graph.chain_utterances(docs, b.utterances(s, d), links, chain, meetings)


# ---- coalitions and vectors (2.H, 2.I)

SCORES = f"(SELECT actor_id, document_id, CASE arg_min(vote_type, struct_pack(a := l_linenumber, b := l_partkey, c := vote_type)) WHEN 'in_favour' THEN 1 WHEN 'against' THEN -1 ELSE 0 END AS score FROM {VOTES} GROUP BY 1, 2)"


def scores(s, d):
    return coalition.vote_scores(b.votes(s, d), F.struct("l_linenumber", "l_partkey", "vote_type"))


@query("h1_vote_scores", f"SELECT actor_id, document_id, CAST(score AS INTEGER) AS score FROM {SCORES}")
def h1(s, d):
    return scores(s, d)


def correlation_sql(scores: str, above: float, k: int) -> str:
    return f"""WITH x AS (SELECT * FROM {scores}), n AS (SELECT count(DISTINCT document_id) AS n FROM x), u AS (SELECT actor_id, name, CAST(sum(score) AS BIGINT) AS s, CAST(sum(score * score) AS BIGINT) AS q FROM x JOIN {ACTORS} a ON a.id = x.actor_id GROUP BY 1, 2),
 p AS (SELECT a.actor_id AS ia, b.actor_id AS ib, CAST(sum(a.score * b.score) AS BIGINT) AS p FROM x a JOIN x b ON a.document_id = b.document_id AND a.actor_id < b.actor_id WHERE a.score <> 0 AND b.score <> 0 GROUP BY 1, 2),
 r AS (SELECT least(a.name, b.name) AS a, greatest(a.name, b.name) AS b, CAST(n * coalesce(p, 0) - a.s * b.s AS DOUBLE) / nullif(sqrt(CAST(n * a.q - a.s * a.s AS DOUBLE)) * sqrt(CAST(n * b.q - b.s * b.s AS DOUBLE)), 0) AS c, n AS n_resolutions
 FROM u a JOIN u b ON a.actor_id < b.actor_id LEFT JOIN p ON ia = a.actor_id AND ib = b.actor_id CROSS JOIN n) SELECT a, b, round(c, 3) AS correlation, n_resolutions FROM r WHERE c > {above} ORDER BY correlation DESC, a, b LIMIT {k}"""


@query("h2_vote_correlation", correlation_sql(SCORES, -1, 20))
def h2(s, d):
    return coalition.vote_correlation(coalition.require_resolutions(scores(s, d)), b.actors(s, d), min_corr=-1.0, k=20)


@query("i1_semantic_search", """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), r AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS similarity FROM embeddings, q)
 SELECT vec_id, label, round(similarity, 4) AS similarity FROM r WHERE similarity >= 0.1 ORDER BY r.similarity DESC, vec_id LIMIT 10""")
def i1(s, d):
    e = b.table(s, d, "embeddings")
    first = e.filter("vec_id = 0").select("embedding").first()
    return vectors.semantic_search(e, first["embedding"] if first else [1.0], "embedding", ["vec_id", "label"], "vec_id", min_similarity=0.1, k=10)


# Each supplier says in every month that it delivers for whether its nation's turn has come; its first line decides.
TURNS = """(SELECT actor_id, document_id, CASE arg_min(vote_type, struct_pack(a := l_orderkey, b := l_linenumber)) WHEN 'in_favour' THEN 1 ELSE -1 END AS score FROM
 (SELECT l_suppkey AS actor_id, year(o_orderdate) * 12 + month(o_orderdate) AS document_id, l_orderkey, l_linenumber, CASE WHEN (year(o_orderdate) - 1992) * 12 + month(o_orderdate) + 3 * l_linenumber > 12 * (s_nationkey % 5) + 10 THEN 'in_favour' ELSE 'against' END AS vote_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2)"""


@query("h2_coalitions", correlation_sql(TURNS, 0.75, 30))
def h2b(s, d):
    """Coalitions above 0.75, the best 30, by the first of repeated votes."""
    rows = b.table(s, d, "lineitem").join(b.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(b.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    turn = month - 1992 * 12 + 3 * F.col("l_linenumber") > 12 * (F.col("s_nationkey") % 5) + 10
    votes = rows.select(month.alias("document_id"), F.col("l_suppkey").alias("actor_id"), F.when(turn, "in_favour").otherwise("against").alias("vote_type"), "l_orderkey", "l_linenumber")
    return coalition.vote_correlation(coalition.require_resolutions(coalition.vote_scores(votes, F.struct("l_orderkey", "l_linenumber"))), b.actors(s, d), min_corr=0.75, k=30)


@query("i2_semantic_search_filtered", """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), r AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS similarity FROM embeddings, q WHERE label IN (1, 2, 3))
 SELECT vec_id, label, round(similarity, 4) AS similarity FROM r WHERE similarity >= 0.0 ORDER BY r.similarity DESC, vec_id LIMIT 10""")
def i2(s, d):
    e = b.table(s, d, "embeddings")
    first = e.filter("vec_id = 0").select("embedding").first()
    return vectors.semantic_search(e, first["embedding"] if first else [1.0], "embedding", ["vec_id", "label"], "vec_id", F.col("label").isin(1, 2, 3), min_similarity=0.0, k=10)


@query("i2_semantic_search_utterances", f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), m AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS id, c_nationkey % 5 + 76 AS session FROM customer),
 r AS (SELECT u.id, speaker_affiliation, speaker_name, agenda_item_number AS agenda_item, m.id AS meeting_symbol, left(text, 500) AS text_preview, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS similarity
  FROM {UTTERANCES} u JOIN embeddings e ON e.vec_id = (u.conv_id * 31 + u.position_in_meeting) % (SELECT count(*) FROM embeddings) JOIN m ON m.id = u.meeting_id, q WHERE m.session = 78 AND (speaker_affiliation ILIKE '%ASSIST%' OR speaker_affiliation ILIKE '%use%'))
 SELECT * REPLACE (round(similarity, 4) AS similarity) FROM r WHERE similarity >= -0.5 ORDER BY r.similarity DESC, id LIMIT 10""")
def i2b(s, d):
    """Speeches with the embedding of a numbered vector, in meetings of one session, by users and assistants."""
    e = b.table(s, d, "embeddings")
    first = e.filter("vec_id = 0").select("embedding").first()
    u = b.utterances(s, d).withColumn("vec_id", (F.col("conv_id") * 31 + F.col("position_in_meeting")) % max(1, e.count())).join(e.select("vec_id", F.col("embedding").alias("text_embedding")), "vec_id")
    meetings = b.table(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_nationkey") % 5 + 76).alias("session")).withColumn("symbol", F.col("id"))
    return vectors.semantic_search_utterances(u, meetings, first["embedding"] if first else [1.0], speakers=["ASSIST", "use"], session=78, min_similarity=-0.5, k=10)


@query("i3_semantic_search_batch", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS similarity FROM embeddings, q WHERE vec_id <> query_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM r) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(similarity, 4) AS similarity FROM k WHERE rank <= 10""")
def i3(s, d):
    e = b.table(s, d, "embeddings")
    return vectors.semantic_search_batch(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "vec_id", "embedding")


@query("i1_semantic_search_cells", """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), r AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS similarity FROM embeddings, q)
 SELECT vec_id, label, round(similarity, 4) AS similarity FROM r WHERE similarity >= 0.25 ORDER BY r.similarity DESC, vec_id LIMIT 10""")
def i1c(s, d):
    """From the cells of a stored index that can reach the similarity; the others are not read."""
    e = b.table(s, d, "embeddings")
    first = e.filter("vec_id = 0").select("embedding").first()
    query_vector = first["embedding"] if first else [1.0]
    index = cells.build(e, "vec_id", "embedding")
    near = index.near(query_vector, min_similarity=0.25).select(F.col("id").alias("vec_id"), "v").join(e.select("vec_id", "label"), "vec_id")
    return vectors.semantic_search(near, query_vector, "v", ["vec_id", "label"], "vec_id", min_similarity=0.25, k=10)


@query("i3_semantic_search_cells", SQL["i3_semantic_search_batch"].replace("WHERE rank <= 10", "WHERE rank <= 10 AND similarity >= 0.2"))
def i3c(s, d):
    e = b.table(s, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return cells.build(e, "vec_id", "embedding").search(asked, min_similarity=0.2, exact=True)


# ---- scalar projections (2.B)


@query("b_symbols", f"""SELECT id, upper(replace(replace(replace(trim(lower(symbol)), '_', '/'), '/ ', '/'), ' .', '.')) AS etl, upper(replace(replace(symbol, '\\', '/'), '_', '/')) AS ui,
 session_part AS session, CAST(session_part AS VARCHAR) AS between, CAST(regexp_extract(symbol, '/C\\.(\\d+)/', 1) AS INTEGER) AS committee, CAST(split_part(symbol, 'L.', 2) AS INTEGER) AS number, symbol AS base,
 replace(symbol, '/', '_') AS file_name, contains(symbol, '/') AS looks, 'https://docs.un.org/en/' || symbol AS url, CASE WHEN contains(symbol, '/L.') THEN 'draft' ELSE 'forwards' END AS mode
 FROM (SELECT *, CAST(NULLIF(regexp_extract(symbol, '/(\\d+)/', 1), '') AS INTEGER) AS session_part FROM {DOCS})""")
def b_symbols(s, d):
    v = F.col("symbol")
    return b.documents(s, d).select(
        "id", c.normalize_symbol(F.lower(v)).alias("etl"), F.upper(c.normalize_symbol(v, "ui")).alias("ui"), c.session_of(v).alias("session"), c.session_between_slashes(v).alias("between"), c.committee_no(v).alias("committee"),
        c.draft_parts(v)["number"].alias("number"), c.version_parts(v)["base"].alias("base"), c.symbol_filename(v).alias("file_name"), c.looks_like_symbol(v).alias("looks"), c.access_url(v).alias("url"), trajectories.trace_mode(v).alias("mode"),
    )


@query("b_text_stats", """SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word_count, len(string_split(text, chr(10))) AS line_count, contains(lower(text), 'annex') AS has_annex,
 trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS collapsed, CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END AS dots,
 CASE WHEN length(text) > 2000 THEN left(text, 1500) || '... [truncated] ...' || right(text, 500) ELSE text END AS middle, trim(split_part(text, ':', 1), ' ') AS title FROM documents""")
def b_text_stats(s, d):
    t = F.col("text")
    return b.table(s, d, "documents").select("doc_id", c.text_stats(t).alias("x"), F.trim(c.collapse_ws(t)).alias("collapsed"), c.preview(t, 600, "dots").alias("dots"), c.preview(t, 0, "middle").alias("middle"), c.clean_title(t).alias("title")).select("doc_id", "x.*", "collapsed", "dots", "middle", "title")


MONTH = "strftime(o_orderdate, '%B')"


@query("b_dates", f"""SELECT o_orderkey, CASE WHEN {MONTH} = 'May' THEN CAST(o_orderdate AS DATE) WHEN month(o_orderdate) = 9 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS library_date, CAST(o_orderdate AS DATE) AS long_date, CAST(o_orderdate AS DATE) AS meeting_date FROM orders""")
def b_dates(s, d):
    o = b.table(s, d, "orders")
    day = F.dayofmonth("o_orderdate").cast("string")
    short = F.when(F.month("o_orderdate") == 9, "Sept").otherwise(F.date_format("o_orderdate", "MMM"))
    library = F.concat(F.lit("[New York] : UN, "), day, F.lit(" "), short, F.lit(". "), F.year("o_orderdate").cast("string"))
    long = F.concat(F.lit("[Place] : UN, "), day, F.lit(" "), F.date_format("o_orderdate", "MMMM yyyy"))
    meeting = F.concat(F.lit("Tuesday, "), day, F.lit(" "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(", 10 a.m."))
    return o.select("o_orderkey", c.parse_un_date(library).alias("library_date"), c.parse_un_date(long).alias("long_date"), c.parse_meeting_date(meeting).alias("meeting_date"))


@query("b_vote_summaries", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'without_vote' ELSE 'recorded_vote' END AS vote_type, CASE WHEN l_returnflag <> 'N' THEN CAST(l_partkey AS INTEGER) END AS yes,
 CASE WHEN l_returnflag <> 'N' THEN CAST(l_suppkey AS INTEGER) END AS no, CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber AS INTEGER) END AS abstain, CAST(l_suppkey AS VARCHAR) || 'th plenary meeting' AS meeting,
 CASE WHEN l_returnflag = 'N' THEN 'rejected' WHEN l_partkey > l_suppkey THEN 'adopted' ELSE 'rejected' END AS outcome FROM lineitem""")
def b_vote_summaries(s, d):
    v = b.table(s, d, "lineitem")
    said = F.when(F.col("l_returnflag") == "N", "Adopted without vote").otherwise(F.format_string("Adopted %d-%d-%d", "l_partkey", "l_suppkey", "l_linenumber"))
    parsed = c.parse_vote_summary(F.concat(said, F.lit(", "), F.col("l_suppkey").cast("string"), F.lit("nd plenary meeting")))
    rows = v.select("l_orderkey", "l_linenumber", parsed.alias("p")).select("l_orderkey", "l_linenumber", "p.*")
    return rows.withColumn("outcome", c.final_outcome(F.col("yes"), F.col("no"), F.lit(True)))


@query("b_agenda_refs", """SELECT p_partkey, 'A/78/251_item_' || CAST(p_size AS VARCHAR) || CASE p_partkey % 3 WHEN 2 THEN 'i' ELSE '' END AS id, 'A/78/251' AS agenda_symbol, CAST(p_size AS INTEGER) AS item_number,
 CASE WHEN p_partkey % 3 = 2 THEN 'i' END AS sub_item, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE p_name || '. ' || p_type END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS subjects, 'A/78/251|' || CAST(p_size AS VARCHAR) || '|' || CASE p_partkey % 3 WHEN 2 THEN 'i' ELSE '' END AS node_key FROM part""")
def b_agenda_refs(s, d):
    p = b.table(s, d, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    item = F.when(k == 0, size).when(k == 1, F.concat(F.lit("["), size, F.lit("]"))).otherwise(F.concat(size, F.lit("i")))
    ref = F.concat(F.lit("A/78/251 "), item, F.lit(" "), "p_name", F.lit(". "), "p_type")
    return p.select("p_partkey", c.parse_agenda_ref(ref).alias("a")).select("p_partkey", "a.*", c.agenda_key(F.col("a.agenda_symbol"), F.col("a.item_number"), F.col("a.sub_item")).alias("node_key"))


@query("b_speakers", """SELECT s_suppkey, 'Mr. ' || s_name || ' (' || n_name || ')' AS raw, n_name AS affiliation, CAST(NULL AS VARCHAR) AS role, 'Mr.' AS honorific, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def b_speakers(s, d):
    v = b.table(s, d, "supplier").join(b.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return v.select("s_suppkey", c.parse_speaker(F.concat(F.lit("Mr.  "), "s_name", F.lit("  ("), "n_name", F.lit(")"))).alias("p")).select("s_suppkey", "p.*")


@query("b_kinds_and_buckets", f"""SELECT n.id, e.relationship_type, {BUCKET} AS bucket, CASE WHEN doc_type = 'meeting' THEN 'meetings' WHEN doc_type = 'draft' THEN 'drafts' ELSE 'other' END AS path_kind, coalesce(title, 'x') AS title FROM {EDGES} e JOIN {NODES} n ON e.source_id = n.id""")
def b_kinds(s, d):
    rows = b.edges(s, d).join(b.nodes(s, d), F.col("source_id") == F.col("id"))
    path = F.concat(F.lit("data/"), F.when(F.col("doc_type") == "meeting", "meetings").when(F.col("doc_type") == "draft", "drafts").otherwise("x"), F.lit("/f.json"))
    return rows.select("id", "relationship_type", c.relation_bucket(F.col("relationship_type"), F.col("doc_type")).alias("bucket"), c.kind_from_path(path).alias("path_kind"), c.json_title(F.col("title"), F.lit('{"metadata": {"title": "x"}}')).alias("title"))


@query("b_json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def b_json(s, d):
    return b.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ---- row-expanding text operators (2.C)


@query("c1_mentions", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
 m AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS context, unnest(regexp_extract_all(line, '[0-9]{3,}')) AS symbol FROM l)
 SELECT doc_id, symbol, context, CAST(min(line_no) AS INTEGER) AS line_no FROM m GROUP BY 1, 2, 3""")
def c1(s, d):
    return x.mentions(b.table(s, d, "documents"), "doc_id", "text", r"[0-9]{3,}").drop("pos")


@query("c2_first_mentions", """WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]*ti[a-z]*')) AS l, regexp_extract_all(text, '[A-Z][a-z]*ti[a-z]*') AS f FROM documents), u AS (SELECT doc_id, unnest(l) AS symbol, f FROM m)
 SELECT doc_id, symbol, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position(f, symbol)) - 1 AS INTEGER) AS pos FROM u""")
def c2(s, d):
    return b.table(s, d, "documents").select("doc_id", F.posexplode(x.first_mentions(F.col("text"), "[A-Z][a-z]*ti[a-z]*")).alias("pos", "symbol"))


@query("c4_draft_ordinals", """SELECT p_partkey, 'I,' || CAST(p_size AS VARCHAR) AS ordinals FROM part""")
def c4(s, d):
    t = F.concat("p_name", F.lit(" draft resolution IV and Draft Resolution "), F.col("p_size").cast("string"), F.lit(", draft resolution iv"))
    return b.table(s, d, "part").select("p_partkey", F.array_join(x.draft_ordinals(t), ",").alias("ordinals"))


@query("c5_paragraphs", """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), k AS (SELECT * FROM l WHERE line <> ''),
 n AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|Of|In|La|De|Der|Die|En|Le)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM k)
 SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, string_agg(line, ' ' ORDER BY pos) AS text FROM n GROUP BY 1, 2""")
def c5(s, d):
    return x.paragraphs(b.table(s, d, "documents"), "doc_id", "text", "^(The|Of|In|La|De|Der|Die|En|Le)")


@query("c7_vote_lists", """SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'in_favour' WHEN 'R' THEN 'against' ELSE 'abstaining' END AS vote_type, s_name AS state FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey""")
def c7(s, d):
    named = b.votes(s, d).select("document_id", "vote_type", "actor_id").distinct().join(b.actors(s, d), F.col("id") == F.col("actor_id"))
    lists = [F.array_join(F.collect_list(F.when(F.col("vote_type") == k, F.col("name"))), ", ").alias(k) for k in aggregates.KINDS]
    text = F.concat(F.lit("In favour: "), "in_favour", F.lit(" Against: "), "against", F.lit(" Abstaining: "), "abstaining", F.lit(" Draft resolution I was adopted by 3 votes."))
    return x.extract_vote_lists(named.groupBy("document_id").agg(*lists).select(F.col("document_id").alias("id"), text.alias("text")), "id", "text")


@query("c8_country_lists", """SELECT p_partkey, p_name || ';' || p_type || ';' || p_brand AS names FROM part""")
def c8(s, d):
    t = F.concat("p_name", F.lit(", "), "p_type", F.lit(" and "), "p_brand")
    return b.table(s, d, "part").select("p_partkey", F.array_join(x.country_list(t), ";").alias("names"))


@query("c9_strip_page_noise", """SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(html, '(</p>)', '\\1' || chr(10), 'g'), chr(10)), lambda l: NOT regexp_matches(trim(l, ' '), '(?i)please recycle') AND NOT regexp_matches(trim(l, ' '), '^_{10,}$')), chr(10)) AS text FROM pages""")
def c9(s, d):
    pages = b.table(s, d, "pages").select("page_id", F.lit(2).alias("page_no"), F.concat(F.regexp_replace("html", "(</p>)", "$1\\\n"), F.lit("\nA/C.3/78/L.41\n23-21227 (E) 131123\n*2321227*\n__________________\nPlease recycle")).alias("html"))
    return x.strip_page_noise(pages, "page_id", "page_no", "html").drop("page_no")


@query("c12_agenda_ranges", """SELECT p_partkey, CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 3 AS VARCHAR) AS label, array_to_string(list_transform(range(p_size, p_size + 4), lambda n: CAST(n AS VARCHAR)), ',') AS numbers FROM part""")
def c12(s, d):
    line = F.concat(F.lit("Agenda items "), F.col("p_size").cast("string"), F.lit(" to "), (F.col("p_size") + 3).cast("string"), F.lit(" (continued)"))
    return b.table(s, d, "part").select("p_partkey", x.expand_agenda_range(line).alias("r")).select("p_partkey", "r.label", F.array_join("r.numbers", ",").alias("numbers"))


@query("c16_tag_dictionary", """SELECT DISTINCT p_partkey, t.p_type AS name FROM part JOIN (SELECT DISTINCT p_type FROM part) t ON contains(part.p_name || ' ' || part.p_type, t.p_type)""")
def c16(s, d):
    p = b.table(s, d, "part")
    return x.tag_dictionary(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), "p_partkey", "text", p, "p_type")


@query("c18_meeting_transcripts", """SELECT conv_id, string_agg(repeat('=', 80) || chr(10) || role || ' (' || role || '):' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1""")
def c18(s, d):
    return x.meeting_transcript(b.utterances(s, d), "conv_id", "position_in_meeting", "speaker_name", "text", "speaker_affiliation")


@query("c11_meetings_parsed", r"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, trim(regexp_replace(regexp_replace(text, '[\n:]', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM conversations)
 SELECT 'C' || CAST(conv_id AS VARCHAR) || '_section_1_utterance_' || CAST(k AS VARCHAR) AS id, 'C' || CAST(conv_id AS VARCHAR) AS meeting_id, k AS position_in_section, upper(role[1]) || role[2:] AS name, role AS affiliation,
 len(list_filter(string_split(said, ' '), lambda w: w <> '')) AS word_count FROM t""")
def c11(s, d):
    """Transcripts of all conversations, parsed again into speeches."""
    u = b.utterances(s, d)
    line = F.concat(F.lit("Mr. "), F.initcap("speaker_name"), F.lit(" ("), "speaker_name", F.lit("): "), F.regexp_replace("text", r"[\n:]", " "))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position_in_meeting", line.alias("t")))), lambda z: z["t"]), "\n")
    docs = u.groupBy("meeting_id").agg(F.concat(F.lit("Preface\nAgenda item 7 (continued)\nA title\n"), body).alias("text"))
    _, said = x.parse_meetings(docs, "meeting_id", "text")
    return said.select("id", "meeting_id", "position_in_section", "speaker.name", "speaker.affiliation", "word_count")


# ---- ordered sequences (2.D)


@query("d1_positions", f"""SELECT id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY section_id, position_in_meeting) AS INTEGER) AS position_in_meeting, CAST(row_number() OVER (PARTITION BY meeting_id, section_id ORDER BY position_in_meeting) AS INTEGER) AS position_in_section FROM {UTTERANCES} QUALIFY trim(coalesce(text, '')) <> ''""")
def d1(s, d):
    return sequences.with_positions(b.utterances(s, d).withColumnRenamed("position_in_meeting", "turn"), "meeting_id", "section_id", "turn").select("id", "position_in_meeting", "position_in_section")


@query("d2_carry_forward", f"""SELECT event_id, last_value(CASE WHEN stage = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS active FROM {STEPS}""")
def d2(s, d):
    e = b.steps(s, d)
    return sequences.carry_forward(e, ["trajectory_id"], ["ts", "event_id"], F.when(F.col("stage") == "purchase", F.col("value")), "active").select("event_id", "active")


@query("d5_timesteps", f"SELECT event_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t FROM {STEPS}")
def d5(s, d):
    return sequences.number_timesteps(b.steps(s, d), "trajectory_id", "ts", "event_id").select("event_id", "t")


def numbered(s, d):
    return sequences.number_timesteps(b.steps(s, d), "trajectory_id", "ts", "event_id")


NUMBERED = f"(SELECT *, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t FROM {STEPS})"


@query("d6_first_of_stage", f"SELECT trajectory_id, stage, arg_min(event_id, t) AS event_id FROM {NUMBERED} GROUP BY 1, 2")
def d6(s, d):
    return sequences.first_of_stage(numbered(s, d), "trajectory_id", "stage", "event_id")


@query("d6_last_of_stage", f"SELECT trajectory_id, stage, arg_max(event_id, t) AS event_id FROM {NUMBERED} GROUP BY 1, 2")
def d6b(s, d):
    return sequences.last_of_stage(numbered(s, d), "trajectory_id", "stage", "event_id")


@query("d7_transitions", f"SELECT event_id, stage, next_stage, next_value FROM (SELECT event_id, stage, lead(stage) OVER w AS next_stage, lead(value) OVER w AS next_value, lead(1) OVER w AS more FROM {STEPS} WINDOW w AS (PARTITION BY trajectory_id ORDER BY ts, event_id)) WHERE more = 1")
def d7(s, d):
    return sequences.transitions(b.steps(s, d), "trajectory_id", ["stage", "value"], ["ts", "event_id"]).select("event_id", "stage", "next_stage", "next_value")


@query("d8_timeline", f"SELECT id, CAST(row_number() OVER (PARTITION BY custkey ORDER BY CASE WHEN month(date) = 9 THEN NULL ELSE date END NULLS LAST, id) AS INTEGER) AS place FROM {DOCS}")
def d8(s, d):
    docs = b.documents(s, d).withColumnRenamed("custkey", "trajectory_id")
    raw = F.when(F.month("date") == 9, "8 Sept. 2023").otherwise(F.date_format("date", "d MMMM yyyy"))
    return sequences.timeline(docs, c.parse_un_date(raw), "id").select("id", "place")


@query("d9_preview_sample", f"""SELECT event_id, place FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY ts, event_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY trajectory_id) AS n FROM {STEPS})
 WHERE n <= 50 OR place <= 10 OR place > n - 5 OR place BETWEEN n // 2 - 1 AND n // 2 + 3""")
def d9(s, d):
    return sequences.preview_sample(b.steps(s, d), ["ts", "event_id"], ["trajectory_id"]).select("event_id", "place")


@query("d3_contexts", f"""WITH u AS (SELECT *, position_in_meeting IN (0, 3) AS chair, CASE position_in_meeting WHEN 0 THEN 'I give the floor for an explanation of vote before the vote' WHEN 3 THEN 'We have heard the last speaker in explanation of vote' ELSE text END AS said FROM {UTTERANCES}),
 m AS (SELECT *, CASE WHEN chair AND regexp_matches(said, '(?i)(\\d+|several|multiple|a number of)\\s+draft\\s+resolutions?') THEN NULL WHEN position_in_meeting = 0 THEN 'before_vote' WHEN position_in_meeting = 3 THEN 'CLOSE' END AS mark FROM u),
 w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY position_in_meeting ROWS UNBOUNDED PRECEDING) AS now FROM m)
 SELECT id, CASE WHEN mark <> 'CLOSE' THEN mark END AS eov_section_announcement, coalesce(mark = 'CLOSE', false) AS eov_section_closed, CASE WHEN NOT chair AND now <> 'CLOSE' THEN now END AS speech_timing, coalesce(NOT chair AND now <> 'CLOSE', false) AS is_explanation_of_vote,
 NOT chair AND regexp_matches(coalesce(said, ''), '(?i)\\bexplanation of (vote|position)\\b') AS self_declared_explanation FROM w""")
def d3(s, d):
    """Every conversation as a debate that its first speech opens and its fourth closes."""
    u = b.utterances(s, d)
    said = F.when(F.col("position_in_meeting") == 0, "I give the floor for an explanation of vote before the vote").when(F.col("position_in_meeting") == 3, "We have heard the last speaker in explanation of vote").otherwise(F.col("text"))
    who = F.when(F.col("position_in_meeting").isin(0, 3), "The President").otherwise(F.col("speaker_name"))
    rows = u.withColumns({"speaker_raw": who, "text": said, "draft_mentions": x.draft_ordinals(F.col("text"))})
    return sequences.tag_contexts(rows, ["meeting_id"], ["position_in_meeting"]).select("id", "eov_section_announcement", "eov_section_closed", "speech_timing", "is_explanation_of_vote", "self_declared_explanation")


# ---- table building (2.E). Ids of built rows are hashes, so natural keys are shown.


@query("e1_build_actors", "SELECT DISTINCT trim(c_mktsegment) AS name, 'country' AS actor_type FROM customer UNION SELECT DISTINCT p_type, 'country' FROM part")
def e1(s, d):
    names = b.table(s, d, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(b.table(s, d, "part").select(F.col("p_type").alias("name")))
    return tables.build_actors(names, b.actors(s, d)).select("name", "actor_type")


@query("e2_build_subjects", "SELECT DISTINCT p_partkey AS document_id, upper(trim(s)) AS name FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS s FROM part) WHERE trim(s) <> ''")
def e2(s, d):
    docs = b.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("subjects"))
    subjects, bridge = tables.build_subjects(docs)
    return bridge.join(subjects, bridge["subject_id"] == subjects["id"]).select("document_id", "name")


def halves(s, d):
    """Documents as two loads: all but meetings with some titles missing, and all but resolutions."""
    docs = b.documents(s, d).select("id", "symbol", "doc_type", F.when(F.col("id") % 5 != 0, F.col("title")).alias("title"), "date", "session", F.lit(None).cast("string").alias("body_text"), F.lit(None).cast("string").alias("doc_metadata"))
    other = b.documents(s, d).select("id", "symbol", F.lit("loaded").alias("doc_type"), F.concat(F.lit("new "), "title").alias("title"), "date", "session", F.col("title").alias("body_text"), F.lit(None).cast("string").alias("doc_metadata"))
    return docs.filter("doc_type <> 'meeting'"), other.filter("session is not null")


MERGED = f"""SELECT n.symbol, CASE WHEN o.doc_type = 'resolution' THEN 'resolution' ELSE 'loaded' END AS doc_type, coalesce(o.title, 'new ' || n.title) AS title, n.title AS body_text FROM {DOCS} n LEFT JOIN (SELECT symbol, doc_type, CASE WHEN id % 5 <> 0 THEN title END AS title FROM {DOCS} WHERE doc_type <> 'meeting') o USING (symbol)"""


@query("e3_merge_fill", MERGED)
def e3(s, d):
    return tables.merge_documents(*halves(s, d), "fill", keep_resolutions=True).select("symbol", "doc_type", "title", "body_text")


@query("e3_merge_overwrite", f"SELECT symbol, 'loaded' AS doc_type, 'new ' || title AS title, title AS body_text FROM {DOCS}")
def e3b(s, d):
    return tables.merge_documents(*halves(s, d), "overwrite").select("symbol", "doc_type", "title", "body_text")


@query("e3_merge_by_buckets", MERGED)
def e3e(s, d):
    """Documents in a table of buckets, into which the others are merged twice."""
    columns = ["id", "symbol", "doc_type", "title", "date", "session", "body_text", "doc_metadata"]
    old, new = halves(s, d)
    at = keyed.KeyedTable.create(old.select(columns), f"{stored_below(s)}/documents-{uuid.uuid4().hex[:12]}", ["symbol"], 16)
    for _ in range(2):
        at.merge(new, lambda old_, new_: tables.merge_documents(old_, new_, "fill", keep_resolutions=True))
    return at.rows().select("symbol", "doc_type", "title", "body_text")


@query("e3_placeholders", "SELECT CAST(l_partkey AS VARCHAR) AS symbol, min(l_linestatus) AS doc_type FROM lineitem WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def e3c(s, d):
    docs = b.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("symbol"))
    return tables.placeholders(docs, b.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_linestatus").alias("doc_type"))).select("symbol", "doc_type")


@query("e3_placeholders_of_late_parts", "SELECT 'P' || CAST(l_partkey AS VARCHAR) AS symbol, min(l_linestatus) AS doc_type FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def e3d(s, d):
    """Of parts, the small ones are loaded; line items refer to all."""
    named = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    docs = b.table(s, d, "part").filter("p_size <= 25").select(named.alias("symbol"))
    referred = b.table(s, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_linestatus").alias("doc_type"))
    return tables.placeholders(docs, referred).select("symbol", "doc_type")


@query("e4_refresh_body", "WITH b AS (SELECT source, arg_max(text, struct_pack(a := length(text), b := encode(text))) AS new_text FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN length(new_text) > length(coalesce(text, '')) THEN new_text ELSE text END AS body_text FROM documents d LEFT JOIN b ON d.source = b.source")
def e4(s, d):
    docs = b.table(s, d, "documents").select("doc_id", F.col("source").alias("symbol"), F.col("text").alias("body_text"))
    return tables.refresh_body(docs, docs.select("symbol", "body_text")).select("doc_id", "body_text")


@query("e5_standalone", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def e5(s, d):
    return tables.standalone(b.table(s, d, "documents").select("doc_id", "lang"), b.table(s, d, "labels"), "doc_id")


@query("e6_build_relationships", """SELECT DISTINCT 'O' || CAST(l_orderkey AS VARCHAR) AS target_id, CASE l_returnflag WHEN 'A' THEN 'S' ELSE 'C' END || CAST(l_suppkey AS VARCHAR) AS source_id, CASE l_returnflag WHEN 'A' THEN 'draft_of' WHEN 'R' THEN 'committee_report_for' ELSE 'meeting_record_for' END AS relationship_type FROM lineitem""")
def e6(s, d):
    v = b.table(s, d, "lineitem")
    ref = lambda flag, p: F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct(F.concat(F.lit(p), F.col("l_suppkey").cast("string")).alias("text"), F.lit(None).cast("string").alias("url"))))
    records = v.groupBy(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("symbol")).agg(F.struct(ref("A", "s").alias("drafts"), ref("R", "c").alias("committee_reports"), ref("N", "c").alias("meeting_records")).alias("related_documents"))
    records = records.withColumn("agenda", F.array().cast("array<struct<id:string,agenda_symbol:string>>"))
    return tables.build_relationships(records, b.nodes(s, d)).select("source_id", "target_id", "relationship_type")


@query("e7_votes_from_records", f"SELECT document_id, actor_id, vote_type, 'plenary' AS vote_context FROM {VOTES}")
def e7(s, d):
    named = b.votes(s, d).join(b.actors(s, d).select(F.col("id").alias("actor_id"), "name"), "actor_id")
    lists = F.struct(*[F.collect_list(F.when(F.col("vote_type") == k, F.col("name"))).alias(k) for k in aggregates.KINDS])
    records = named.groupBy("document_id").agg(lists.alias("vote_lists")).join(b.documents(s, d).select(F.col("id").alias("document_id"), "symbol"), "document_id").select("symbol", "vote_lists")
    return tables.votes_from_records(records, b.documents(s, d), b.actors(s, d)).select("document_id", "actor_id", "vote_type", "vote_context")


@query("e8_votes_from_meetings", f"SELECT DISTINCT v.document_id, v.actor_id, v.vote_type FROM {VOTES} v WHERE NOT EXISTS (SELECT 1 FROM {VOTES} o WHERE o.l_linenumber = 1 AND o.actor_id = v.actor_id AND o.vote_type = v.vote_type AND o.document_id = v.document_id)")
def e8(s, d):
    v = b.votes(s, d)
    named = v.join(b.actors(s, d).select(F.col("id").alias("actor_id"), "name"), "actor_id").select("name", "vote_type", "document_id", "vote_event_id")
    return tables.votes_from_meetings(named, b.actors(s, d), v.filter("l_linenumber = 1")).select("document_id", "actor_id", "vote_type")


@query("e9_build_vote_events", f"""WITH d AS (SELECT id, symbol FROM {DOCS} UNION ALL SELECT id + 1000000000, 'A/78/L.' || CAST(id AS VARCHAR) FROM {DOCS} WHERE id % 3 <> 0),
 e AS (SELECT *, event_id % 5 AS k FROM events), n AS (SELECT e.*, CASE k WHEN 0 THEN o.symbol WHEN 1 THEN 'A/78/L.' || CAST(event_id AS VARCHAR) WHEN 3 THEN 'A/C.9/78/L.' || CAST(event_id AS VARCHAR) WHEN 4 THEN 'L.' || CAST(event_id AS VARCHAR) || '/REV.1' END AS draft_symbol FROM e LEFT JOIN {DOCS} o ON o.id = e.event_id)
 SELECT event_id AS utterance_id, coalesce(t.id, r.id) AS target FROM n LEFT JOIN d t ON t.symbol = n.draft_symbol LEFT JOIN {DOCS} r ON r.id = n.user_id""")
def e9(s, d):
    """Drafts as full symbols (own ones and some that are not loaded), as short forms, as bare numbers and as revisions."""
    own = b.documents(s, d).select("id", "symbol")
    docs = own.unionByName(own.filter("id % 3 <> 0").select((F.col("id") + 1000000000).alias("id"), F.concat(F.lit("A/78/L."), F.col("id").cast("string")).alias("symbol")))
    e = b.table(s, d, "events").join(own.select(F.col("id").alias("event_id"), F.col("symbol").alias("own")), "event_id", "left").join(own.select(F.col("id").alias("user_id"), F.col("symbol").alias("res")), "user_id", "left")
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    draft = F.when(k == 0, F.lower("own")).when(k == 1, F.concat(F.lit("L."), n)).when(k == 2, n).when(k == 3, F.concat(F.lit("A/C.9/78/L."), n)).otherwise(F.concat(F.lit("L."), n, F.lit("/Rev.1")))
    rows = e.select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("utterance_id"), F.lit(78).alias("session"), draft.alias("draft"), F.col("res").alias("resolution_symbol"), "event_type", F.col("props").alias("description"), F.lit(None).cast("string").alias("result"))
    return tables.build_vote_events(rows, docs).select("utterance_id", F.col("target_document_id").alias("target"))


@query("e10_build_utterances", f"""SELECT meeting_id, position_in_meeting, s_suppkey AS speaker_actor_id, text, '{{"tags":"' || speaker_name || '"}}' AS utterance_metadata FROM {UTTERANCES} u LEFT JOIN supplier ON s_suppkey = u.position_in_meeting + 1 WHERE trim(coalesce(text, '')) <> ''""")
def e10(s, d):
    u = b.utterances(s, d).drop("speaker_affiliation", "id").join(b.actors(s, d).select((F.col("id") - 1).alias("position_in_meeting"), F.col("name").alias("speaker_affiliation")), "position_in_meeting", "left").withColumn("tags", F.col("speaker_name"))
    return tables.build_utterances(u, b.actors(s, d)).select("meeting_id", "position_in_meeting", "speaker_actor_id", "text", "utterance_metadata")


@query("e11_link_utterances", f"SELECT u.id AS utterance_id, d.id AS document_id, CASE WHEN d.id % 2 = 0 OR u.position_in_meeting % 2 = 0 THEN 'mentioned' ELSE 'voting_on' END AS reference_type FROM {UTTERANCES} u JOIN {DOCS} d ON u.conv_id = d.custkey")
def e11(s, d):
    pairs = b.utterances(s, d).join(b.documents(s, d).select("symbol", F.col("id").alias("doc"), F.col("custkey").alias("conv_id")), "conv_id")
    said = (F.col("doc") % 2 == 0) | (F.col("position_in_meeting") % 2 == 0)
    ref = F.struct(F.when(F.col("doc") % 3 == 0, "").otherwise(F.lower("symbol")).alias("symbol"), F.concat(F.lit("on "), "symbol", F.lit(" now")).alias("context"))
    u = pairs.groupBy("id").agg(F.collect_list(F.when(said, ref)).alias("documents"), F.collect_list("symbol").alias("voting_on"))
    return tables.link_utterances(u, b.documents(s, d)).select("utterance_id", "document_id", "reference_type")


@query("e12_meeting_edges", f"SELECT DISTINCT u.meeting_id AS source_id, l.document_id AS target_id, 'meeting_record_for' AS relationship_type FROM {LINKS} l JOIN {UTTERANCES} u ON u.id = l.utterance_id JOIN {DOCS} d ON d.id = l.document_id WHERE d.doc_type IN ('resolution', 'draft')")
def e12(s, d):
    return tables.meeting_edges(b.links(s, d), b.utterances(s, d), b.documents(s, d))


@query("e13_build_sponsorships", f"SELECT document_id, actor_id, CASE WHEN max(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END) = 1 THEN 'initial' ELSE 'additional' END AS sponsorship_type FROM {VOTES} GROUP BY 1, 2")
def e13(s, d):
    named = b.votes(s, d).join(b.actors(s, d).select(F.col("id").alias("actor_id"), "name"), "actor_id")
    early = F.col("l_linenumber") <= 2
    docs = named.groupBy(F.col("document_id").alias("id")).agg(F.collect_list(F.when(early, F.col("name"))).alias("authors"), F.concat(F.lit("Additional sponsors: "), F.array_join(F.collect_list(F.when(~early, F.col("name"))), ", "), F.lit(" (A/78/1)")).alias("notes"))
    return tables.build_sponsorships(docs, b.actors(s, d))


@query("e14_upsert_utterances", f"SELECT meeting_id, position_in_meeting, CASE WHEN position_in_meeting % 2 = 0 THEN text ELSE 'new ' || text END AS text FROM {UTTERANCES}")
def e14(s, d):
    u = b.utterances(s, d).select("meeting_id", "position_in_meeting", "text")
    return tables.upsert_utterances(u.filter("position_in_meeting % 2 = 0"), u.withColumn("text", F.concat(F.lit("new "), "text")))


@query("e14_relinked", f"""SELECT 'link' AS kind, CAST(utterance_id AS VARCHAR) AS a, CAST(document_id AS VARCHAR) AS b, reference_type AS c, document_id % 2 = 1 AS late FROM {LINKS}
 UNION ALL SELECT 'edge', 'C' || CAST(conv_id AS VARCHAR), CAST(d.id AS VARCHAR), 'meeting_record_for', d.id % 2 = 1 FROM (SELECT DISTINCT conv_id FROM conversations) u JOIN {DOCS} d ON u.conv_id = d.custkey WHERE doc_type IN ('resolution', 'draft')""")
def e14b(s, d):
    """Speeches loaded while only documents of even numbers were there, and loaded again when all are."""
    u, docs = b.utterances(s, d), b.documents(s, d)
    said = u.select("id", "meeting_id", "position_in_meeting", "text")
    named = b.links(s, d).join(docs.select(F.col("id").alias("document_id"), "symbol"), "document_id").groupBy(F.col("utterance_id").alias("id")).agg(
        F.collect_list(F.when(F.col("reference_type") == "mentioned", F.struct("symbol", F.lit(None).cast("string").alias("context")))).alias("documents"), F.collect_list(F.when(F.col("reference_type") == "voting_on", F.col("symbol"))).alias("voting_on")
    )
    incoming = said.join(named, "id", "left")
    early = docs.filter("id % 2 = 0")
    none = s.createDataFrame([], "utterance_id long, document_id long, reference_type string, context string")
    no_edges = s.createDataFrame([], "source_id string, target_id long, relationship_type string")
    _, links, edges = tables.reload_utterances(said.limit(0), incoming, none, early, no_edges)
    links, edges = stored(links, "links"), stored(edges, "edges")
    _, after, edges_after = tables.reload_utterances(said, incoming, links, docs, edges)
    late = F.col("document_id").cast("long") % 2 == 1
    rows = after.select(F.lit("link").alias("kind"), F.col("utterance_id").cast("string").alias("a"), F.col("document_id").cast("string").alias("b"), F.col("reference_type").alias("c"), late.alias("late"))
    return rows.unionByName(edges_after.select(F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").cast("string").alias("b"), F.col("relationship_type").alias("c"), (F.col("target_id") % 2 == 1).alias("late")))


@query("e15_purge_documents", f"""WITH g AS (SELECT id FROM {DOCS} WHERE doc_type = 'meeting'), u AS (SELECT id FROM {UTTERANCES} WHERE conv_id NOT IN (SELECT id FROM g)),
 v AS (SELECT event_id, user_id, CASE WHEN event_id NOT IN (SELECT id FROM g) THEN event_id END AS target FROM events WHERE user_id NOT IN (SELECT id FROM g))
 SELECT 'documents' AS name, CAST(id AS VARCHAR) AS row FROM {DOCS} WHERE doc_type <> 'meeting' UNION ALL SELECT 'votes', CAST(document_id AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM {VOTES} WHERE document_id NOT IN (SELECT id FROM g)
 UNION ALL SELECT 'utterances', CAST(id AS VARCHAR) FROM u UNION ALL SELECT 'vote_events', CAST(event_id AS VARCHAR) || '-' || coalesce(CAST(target AS VARCHAR), '') FROM v
 UNION ALL SELECT 'utterance_documents', CAST(utterance_id AS VARCHAR) || '-' || CAST(document_id AS VARCHAR) FROM {LINKS} WHERE utterance_id IN (SELECT id FROM u) AND document_id NOT IN (SELECT id FROM g)""")
def e15(s, d):
    """Meetings leave with their votes, speeches, links and vote events; events on them lose their target."""
    docs = b.documents(s, d)
    u = b.utterances(s, d).select("id", F.col("conv_id").alias("meeting_id"))
    events = b.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("meeting_id"), F.lit(None).cast("long").alias("utterance_id"), F.col("event_id").alias("target_document_id"))
    held = {"documents": docs, "votes": b.votes(s, d), "utterances": u, "vote_events": events, "utterance_documents": b.links(s, d)}
    out = tables.purge_documents(held, docs.filter("doc_type = 'meeting'"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    shown = {"documents": ["id"], "votes": ["document_id", "l_linenumber"], "utterances": ["id"], "vote_events": ["id", "target_document_id"], "utterance_documents": ["utterance_id", "document_id"]}
    parts = [out[n].select(F.lit(n).alias("name"), F.concat_ws("-", *map(text, c)).alias("row")) for n, c in shown.items()]
    return reduce(DataFrame.unionByName, parts)


LOADED = "SELECT CASE WHEN quality = 0 THEN 'errors' WHEN l.doc_id IS NULL THEN 'skipped' ELSE 'loaded' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"


def parsed_records(s, d):
    rows = b.table(s, d, "documents").join(b.table(s, d, "labels").select(F.col("doc_id").alias("k"), "quality"), F.col("doc_id") == F.col("k"), "left")
    return rows.select(F.when(F.col("quality") == 0, "x").alias("_corrupt"), F.col("k").cast("string").alias("symbol"), "text")


@query("e16_load_stats", LOADED)
def e16(s, d):
    return tables.load_stats(parsed_records(s, d))


@query("e16_observed_load", f"SELECT status, n, n AS observed FROM ({LOADED})")
def e16b(s, d):
    path = f"{stored_below(s)}/load-{uuid.uuid4().hex[:12]}"
    seen = s.createDataFrame(list(tables.load_observed(parsed_records(s, d), path).items()), "status string, observed long")
    written = s.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return written.join(seen, "status")


# ---- scans (2.A)


@query("a2_document_index", """WITH r AS (SELECT o_custkey, 'root/c' || CAST(o_custkey AS VARCHAR) || '_' || o_orderpriority || '.html' AS path, o_orderkey FROM orders)
 SELECT upper('c' || CAST(o_custkey AS VARCHAR)) AS symbol_norm, max(path) AS path FROM r GROUP BY 1""")
def a2(s, d):
    o = b.table(s, d, "orders")
    records = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("symbol"), F.concat(F.lit("root/c"), F.col("o_custkey").cast("string"), F.lit("_"), "o_orderpriority", F.lit(".html")).alias("path"), F.lit("resolutions").alias("kind"), F.lit(0).alias("root"))
    return trajectories.document_index(records).select("symbol_norm", "path")


@query("a5_page_links", """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>[^<]*</a>') AS l FROM pages), u AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM a)
 SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(a, '>([^<]*)</a>', 1) AS text, 'https://library.example.org' || regexp_extract(a, 'href="([^"]*)"', 1) AS url FROM u""")
def a5(s, d):
    return readers.page_links(b.table(s, d, "pages"), "https://library.example.org")


@query("a5_page_titles", "SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages")
def a5b(s, d):
    return readers.page_metadata(b.table(s, d, "pages")).select("page_id", "title")


@query("a10_mermaid_lines", f"""SELECT '    ' || source_id || ' -->|' || relationship_type || '| ' || target_id AS line FROM {EDGES} UNION ALL SELECT '    ' || id || '["' || replace(coalesce(title, id), '"', '''') || '"]' FROM {NODES} UNION ALL SELECT 'graph LR'""")
def a10(s, d):
    e = b.edges(s, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship_type").alias("relation"))
    return writers.graph_mermaid_lines(b.nodes(s, d), e).select("line")


# ---- genealogies, trajectories, quality, episodes (2.J)


def order_records(s, d):
    """Orders as records: their lines as references, their priority as agenda item."""
    v = b.table(s, d, "lineitem")
    # Numbers are collected, and spelled out after the shuffle.
    spelled = lambda k, p: F.struct(F.concat(F.lit(p), k.cast("string")).alias("text"), F.concat(F.lit("https://library.example.org/record/"), k.cast("string")).alias("url"))
    ref = lambda flag, p: F.array_sort(F.transform(F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey"))), lambda k: spelled(k, p)))
    refs = v.groupBy(F.col("l_orderkey").alias("id")).agg(F.struct(ref("A", "S").alias("drafts"), ref("R", "S").alias("committee_reports"), ref("N", "X").alias("meeting_records")).alias("related_documents"))
    docs = b.documents(s, d).withColumn("kind", F.when(F.col("doc_type") == "resolution", "resolutions").when(F.col("doc_type") == "draft", "drafts").otherwise("committee-reports"))
    number = F.left("title", F.lit(1)).cast("int")
    return docs.join(refs, "id").withColumn("agenda", F.array(F.struct(F.lit("A/78/251").alias("agenda_symbol"), number.alias("item_number"), F.lit(None).cast("string").alias("sub_item"))))


def supplier_index(s, d):
    return b.table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol_norm"), F.lit("p").alias("path"))


REFS = f"(SELECT DISTINCT d.symbol, CASE l_returnflag WHEN 'A' THEN 'draft' WHEN 'R' THEN 'committee_report' ELSE 'meeting' END AS type, CASE l_returnflag WHEN 'N' THEN 'X' ELSE 'S' END || CAST(l_suppkey AS VARCHAR) AS ref_symbol, l_returnflag <> 'N' AS found FROM lineitem JOIN {DOCS} d ON l_orderkey = d.id UNION ALL SELECT symbol, 'agenda_item', 'A/78/251', false FROM {DOCS} WHERE id IN (SELECT l_orderkey FROM lineitem))"


@query("j1_trace_backwards", f"SELECT symbol, type, ref_symbol, found FROM {REFS}")
def j1(s, d):
    return trajectories.trace_backwards(order_records(s, d), supplier_index(s, d)).select("symbol", "type", "ref_symbol", "found")


@query("j3_trace_forwards", f"SELECT DISTINCT left(title, 1) AS label, symbol FROM {DOCS} WHERE id IN (SELECT l_orderkey FROM lineitem)")
def j3(s, d):
    targets = b.documents(s, d).select(F.lit("a/78/251").alias("agenda_symbol"), F.left("title", F.lit(1)).alias("label")).distinct()
    return trajectories.trace_forwards(order_records(s, d), targets).select("label", "symbol")


@query("j6_graph_nodes", f"SELECT id, bool_and(found) AS found, min(type) AS type, min(title) AS title FROM (SELECT DISTINCT symbol AS id, true AS found, 'resolution' AS type FROM {REFS} UNION ALL SELECT ref_symbol, found, type FROM {REFS}) LEFT JOIN (SELECT symbol, title FROM {DOCS}) ON symbol = id GROUP BY 1")
def j6(s, d):
    r = order_records(s, d)
    nodes, _ = trajectories.genealogy_graph(trajectories.trace_backwards(r, supplier_index(s, d)), r)
    return nodes.select("id", "found", "type", "title")


@query("j6_graph_edges", f"SELECT DISTINCT ref_symbol AS source, symbol AS target, type AS relation FROM {REFS}")
def j6b(s, d):
    r = order_records(s, d)
    return trajectories.genealogy_graph(trajectories.trace_backwards(r, supplier_index(s, d)), r)[1]


@query("j10_country_actions", f"SELECT document_id AS trajectory_id, name AS country, 'voted_' || vote_type AS action FROM {VOTES} v JOIN {ACTORS} a ON a.id = v.actor_id UNION ALL SELECT id, doc_type, 'submit_draft' FROM {DOCS} UNION ALL SELECT id, doc_type, 'co_sponsor' FROM {DOCS} UNION ALL SELECT id, title, 'co_sponsor' FROM {DOCS}")
def j10(s, d):
    v = b.votes(s, d).join(b.actors(s, d).select(F.col("id").alias("actor_id"), F.col("name").alias("country")), "actor_id").select(F.col("document_id").alias("trajectory_id"), F.lit(0).alias("t"), "country", "vote_type")
    sponsors = b.documents(s, d).select(F.col("id").alias("trajectory_id"), F.lit(0).alias("t"), F.array("doc_type", "title").alias("sponsors"))
    return trajectories.country_actions(v, sponsors).drop("t")


@query("j11_vote_shift", f"""WITH f AS (SELECT trajectory_id, arg_max(struct_pack(y := yes, n := no, a := abstain), t) FILTER (stage = 'view') AS a, arg_max(struct_pack(y := yes, n := no, a := abstain), t) FILTER (stage = 'purchase') AS b FROM {NUMBERED} GROUP BY 1)
 SELECT trajectory_id, b.y - a.y AS yes_shift, b.n - a.n AS no_shift, b.a - a.a AS abstain_shift FROM f WHERE a IS NOT NULL AND b IS NOT NULL""")
def j11(s, d):
    return trajectories.vote_shift(numbered(s, d), first="view", last="purchase")


@query("j12_availability", f"SELECT event_id, value IS NOT NULL AS has_value, props IS NOT NULL AS has_props FROM {STEPS}")
def j12(s, d):
    return trajectories.availability(b.steps(s, d), "event_id", "value", "props")


# Some records without agenda, some without other references, and some that are asked for but not there.
QA_REFS = f"(SELECT r.* FROM {REFS} r JOIN {DOCS} d ON d.symbol = r.symbol WHERE CASE WHEN r.type = 'agenda_item' THEN d.id % 4 <> 0 ELSE d.id % 10 <> 0 END)"
QA = f"""(SELECT w.symbol, CASE WHEN NOT known THEN 'error' WHEN coalesce(e - f, 0) = 0 THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN NOT known THEN 'not found' END AS error, coalesce(e, 0) AS expected, coalesce(f, 0) AS found, CAST(coalesce(e - f, 0) AS INTEGER) AS missing, coalesce(lost, '') AS lost
 FROM (SELECT symbol, true AS known FROM {DOCS} WHERE id IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'X/' || symbol, false FROM {DOCS} WHERE id % 7 = 0) w
 LEFT JOIN (SELECT symbol, count(*) AS e, count(*) FILTER (found) AS f, string_agg(CASE WHEN NOT found THEN type || ':' || ref_symbol END, ',' ORDER BY type, ref_symbol) AS lost FROM {QA_REFS} GROUP BY 1) q USING (symbol))"""


def qa_of_orders(s, d):
    r = stored(order_records(s, d), "records")
    asked = r.select("symbol").unionByName(b.documents(s, d).filter("id % 7 = 0").select(F.concat(F.lit("X/"), "symbol").alias("symbol")))
    r = r.withColumns({"related_documents": F.when(F.col("id") % 10 != 0, F.col("related_documents")), "agenda": F.when(F.col("id") % 4 != 0, F.col("agenda"))})
    return trajectories.trajectory_qa(r, supplier_index(s, d), asked)


@query("j13_trajectory_qa", f"SELECT * FROM {QA}")
def j13(s, d):
    return qa_of_orders(s, d).withColumn("lost", F.array_join(F.transform("lost", lambda x: F.concat_ws(":", x["type"], x["ref_symbol"])), ","))


@query("j13_labelled_qa", "SELECT lang, source, count(*) AS expected, count(l.doc_id) AS found, count(*) = count(l.doc_id) AS complete FROM (SELECT DISTINCT lang, source, doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def j13b(s, d):
    qa = trajectories.reference_qa(b.table(s, d, "documents"), b.table(s, d, "labels"), "lang", "source", "doc_id")
    return qa.select("lang", "source", "expected", "found", (F.col("status") == "complete").alias("complete"))


@query("j14_qa_summary", f"SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'error') AS errors, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(found) AS BIGINT) AS found, round(count(*) FILTER (status = 'complete') / count(*), 4) AS rate, count(*) FILTER (status = 'complete') / count(*) >= 0.9 AS accepted FROM {QA}")
def j14(s, d):
    return trajectories.qa_summary(qa_of_orders(s, d))


@query("j14_missing_by_type", f"SELECT type, count(*) AS missing FROM {QA_REFS} WHERE NOT found GROUP BY 1")
def j14b(s, d):
    return trajectories.missing_by_type(qa_of_orders(s, d))


@query("j15_missing_with_url", f"SELECT ref_symbol AS symbol, type, CASE WHEN type = 'agenda_item' THEN 'https://docs.un.org/en/A/78/251' ELSE 'https://library.example.org/record/' || replace(ref_symbol, 'X', '') END AS url, CASE WHEN type <> 'agenda_item' THEN replace(ref_symbol, 'X', '') END AS record_id FROM (SELECT DISTINCT ref_symbol, type FROM {REFS} WHERE NOT found)")
def j15(s, d):
    r = order_records(s, d)
    refs = stored(trajectories.references(r), "references")
    return trajectories.missing_with_url(trajectories.trajectory_qa(r, supplier_index(s, d), refs=refs), refs)


@query("j16_sample", f"SELECT symbol FROM {DOCS} ORDER BY md5(symbol || '/42'), symbol LIMIT 20")
def j16(s, d):
    return trajectories.sample_rows(b.documents(s, d), "symbol", 20).select("symbol")


TALLIED = f"(SELECT document_id, list(DISTINCT actor_id) FILTER (vote_type = 'in_favour') AS y, list(DISTINCT actor_id) FILTER (vote_type = 'against') AS n, list(DISTINCT actor_id) FILTER (vote_type = 'abstaining') AS a FROM {VOTES} GROUP BY 1)"


def voted_trajectories(s, d):
    """Documents with the voters of their committee and plenary votes; who votes first sponsors. Some have no such vote."""
    who = F.col("actor_id").cast("string")

    def lists(context):
        own = F.col("vote_context") == context
        sets = F.struct(*[F.collect_set(F.when(own & (F.col("vote_type") == k), who)).alias(n) for k, n in (("in_favour", "yes"), ("against", "no"), ("abstaining", "abstain"))])
        return F.when(F.count_if(own) > 0, sets)

    v = b.votes(s, d).groupBy(F.col("document_id").alias("id")).agg(lists("committee").alias("committee"), lists("plenary").alias("plenary"), F.collect_set(F.when(F.col("l_linenumber") <= 2, who)).alias("sponsors"))
    outcome = F.when(F.col("doc_type") == "resolution", "Adopted").when(F.col("doc_type") == "meeting", "rejected")
    return b.documents(s, d).join(v, "id").select(F.col("id").alias("trajectory_id"), F.lit(0).alias("topic_id"), "sponsors", "committee", "plenary", outcome.alias("final_outcome"))


def lists_sql(context: str, p: str) -> str:
    kinds = {"yes": "in_favour", "no": "against", "abstain": "abstaining"}
    return ", ".join(f"list(DISTINCT actor_id) FILTER (vote_context = '{context}' AND vote_type = '{v}') AS {p}_{k}" for k, v in kinds.items())


VOTED = f"(SELECT document_id, list(DISTINCT actor_id) FILTER (l_linenumber <= 2) AS sponsors, {lists_sql('committee', 'c')}, {lists_sql('plenary', 'p')}, count(*) FILTER (vote_context = 'committee') AS nc, count(*) FILTER (vote_context = 'plenary') AS np FROM {VOTES} GROUP BY 1)"


def state_sql() -> str:
    """Every field of both states of a step t in 0, 1, 2, as the episodes of the record model have them."""
    rows = {
        "s_stage": "CASE WHEN t = 2 THEN 2 ELSE 0 END", "n_stage": "CASE t WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END", "s_topic_id": "0", "n_topic_id": "0", "s_sponsor_count": "n_sponsors", "n_sponsor_count": "n_sponsors",
        "s_agent_is_sponsor": "CASE WHEN t > 0 AND sponsor THEN 1 ELSE 0 END", "n_agent_is_sponsor": "CASE WHEN sponsor THEN 1 ELSE 0 END", "s_t": "CASE t WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END", "n_t": "CASE t WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END",
    }
    for k in ("yes", "no", "abstain"):
        rows |= {f"s_committee_{k}": f"CASE WHEN t = 2 THEN n_c_{k} ELSE 0 END", f"n_committee_{k}": f"CASE WHEN t >= 1 THEN n_c_{k} ELSE 0 END", f"s_plenary_{k}": "0", f"n_plenary_{k}": f"CASE WHEN t = 2 THEN n_p_{k} ELSE 0 END"}
    return ", ".join(f"CAST({v} AS INTEGER) AS {k}" for k, v in rows.items())


@query("j18_episodes", f"""WITH c AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS c FROM region), e AS (SELECT document_id, c, d.doc_type, len(coalesce(sponsors, [])) AS n_sponsors, coalesce(list_contains(sponsors, c), false) AS sponsor,
 {', '.join(f"len(coalesce({p}_{k}, [])) AS n_{p}_{k}" for p in 'cp' for k in ('yes', 'no', 'abstain'))}, {', '.join(f"CASE WHEN list_contains({p}_yes, c) THEN 1 WHEN list_contains({p}_no, c) THEN 2 ELSE 3 END AS {p}_action" for p in 'cp')}
 FROM {VOTED} JOIN {DOCS} d ON d.id = document_id, c WHERE nc > 0 AND np > 0), s AS (SELECT *, unnest([0, 1, 2]) AS t FROM e)
 SELECT document_id AS trajectory_id, CAST(c AS VARCHAR) AS country, CAST(t AS INTEGER) AS t, CAST(CASE t WHEN 0 THEN CASE WHEN sponsor THEN 0 ELSE 4 END WHEN 1 THEN c_action ELSE p_action END AS INTEGER) AS action,
 CASE WHEN t = 2 AND sponsor THEN CASE WHEN doc_type = 'meeting' THEN -1.0 ELSE 1.0 END ELSE 0.0 END AS reward, t = 2 AS done, {state_sql()} FROM s""")
def j18(s, d):
    countries = b.table(s, d, "region").select((F.col("r_regionkey") + 1).cast("string").alias("country"))
    e = episodes.episodes(voted_trajectories(s, d), countries)
    fields = [F.col(f"{x}.{c}").alias(f"{p}_{c}") for p, x in (("s", "state"), ("n", "next_state")) for c in ("stage", *episodes.SCALARS)]
    return e.select("trajectory_id", "country", "t", "action", "reward", "done", *fields)


STAGE = "(CASE stage WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END)"


def event_states(s, d):
    """Every event as a state; its type is the stage, and its numbers are the tallies."""
    e = b.steps(s, d)
    stage = F.when(F.col("stage") == "signup", 0).when(F.col("stage") == "view", 1).when(F.col("stage") == "click", 2).otherwise(3)
    known = {"topic_id": F.col("abstain"), "sponsor_count": F.col("yes"), "agent_is_sponsor": F.col("no") > 3, "committee_yes": F.col("yes"), "committee_no": F.col("no"), "plenary_yes": F.col("no"), "t": F.col("abstain")}
    st = F.struct(stage.alias("stage"), *[known.get(n, F.lit(0)).cast("int").alias(n) for n in episodes.SCALARS])
    return e.withColumn("state", st).withColumn("action", (F.col("event_id") % 5).cast("int"))


@query("j20_state_vectors", f"SELECT event_id, concat_ws(',', {', '.join(f'CAST(CASE WHEN {STAGE} = {k} THEN 1 ELSE 0 END AS VARCHAR)' for k in range(4))}, abstain, yes, CAST(no > 3 AS INTEGER), yes, no, 0, no, 0, 0, abstain) AS vector, {STAGE} AS stage, yes AS sponsor_count FROM {STEPS}")
def j20(s, d):
    v = event_states(s, d).select("event_id", episodes.state_vector(F.col("state")).alias("v"))
    back = episodes.state_from_vector(F.col("v"))
    return v.select("event_id", F.array_join(F.transform("v", lambda z: z.cast("int").cast("string")), ",").alias("vector"), back["stage"].alias("stage"), back["sponsor_count"].alias("sponsor_count"))


@query("j21_valid_actions", f"SELECT event_id, CASE {STAGE} WHEN 0 THEN event_id % 5 IN (0, 4) WHEN 3 THEN event_id % 5 = 4 ELSE event_id % 5 IN (1, 2, 3) END AS valid FROM {STEPS}")
def j21(s, d):
    return event_states(s, d).select("event_id", episodes.valid_action(F.col("state.stage"), F.col("action")).alias("valid"))


@query("j22_episode_stats", f"WITH e AS (SELECT trajectory_id, count(*) AS l, bool_or(no > 3 AND yes > 90) AS s FROM {STEPS} GROUP BY 1), r AS (SELECT avg(value - 50) AS m, stddev_pop(value - 50) AS d, count(*) FILTER (value > 50) AS u, count(*) FILTER (value < 50) AS v FROM {STEPS}) SELECT count(*) AS episodes, CAST(sum(l) AS BIGINT) AS transitions, round(avg(l), 6) AS mean_length, round(any_value(m), 4) AS reward_mean, round(any_value(d), 4) AS reward_std, any_value(u) AS positive, any_value(v) AS negative, round(avg(CAST(s AS INTEGER)), 6) AS sponsor_rate FROM e, r")
def j22(s, d):
    r = episodes.episode_stats(b.steps(s, d).withColumn("value", F.col("value") - 50), ["trajectory_id"], value="value", is_sponsor=(F.col("no") > 3) & (F.col("yes") > 90))
    return r.withColumns({"mean_length": F.round("mean_length", 6), "reward_mean": F.round("reward_mean", 4), "reward_std": F.round("reward_std", 4), "sponsor_rate": F.round("sponsor_rate", 6)})


@query("j22_action_distribution", f"SELECT stage, count(*) AS n FROM {STEPS} GROUP BY 1")
def j22b(s, d):
    return episodes.action_distribution(b.steps(s, d), "stage")


@query("j23_action_share", f"SELECT trajectory_id, stage, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY trajectory_id), 4) AS share FROM {STEPS} GROUP BY 1, 2")
def j23(s, d):
    return episodes.action_share(b.steps(s, d), "trajectory_id", "stage")


@query("j24_compare_trajectories", f"""WITH a AS (SELECT trajectory_id AS episode, t, stage AS action, value AS reward FROM {NUMBERED}), b AS (SELECT episode, t, CASE WHEN t % 3 = 0 THEN 'x' ELSE action END AS action, reward - 50 AS reward FROM a WHERE t < 40),
 l AS (SELECT episode, count(*) AS n, arg_max(reward, t) AS r FROM a GROUP BY 1), k AS (SELECT episode, count(*) AS n, arg_max(reward, t) AS r FROM b GROUP BY 1), q AS (SELECT episode, count(*) FILTER (a.action = b.action) AS e FROM a JOIN b USING (episode, t) GROUP BY 1)
 SELECT episode, round(coalesce(e, 0) / l.n, 6) AS action_accuracy, (coalesce(l.r, 0) > 0) = (coalesce(k.r, 0) > 0) AS outcome_match, abs(l.n - k.n) AS length_diff FROM l JOIN k USING (episode) LEFT JOIN q USING (episode)""")
def j24(s, d):
    a = numbered(s, d).select(F.col("trajectory_id").alias("episode"), "t", F.col("stage").alias("action"), F.col("value").alias("reward"))
    other = a.filter("t < 40").select("episode", "t", F.when(F.col("t") % 3 == 0, "x").otherwise(F.col("action")).alias("action"), (F.col("reward") - 50).alias("reward"))
    return episodes.compare_trajectories(a, other).withColumn("action_accuracy", F.round("action_accuracy", 6))


@query("j25_prediction_metrics", f"""WITH z AS (SELECT 0 AS dim, CAST(yes AS DOUBLE) AS p, CAST(no AS DOUBLE) AS q FROM {STEPS} UNION ALL SELECT 1, abstain + 0.4, abstain FROM {STEPS} UNION ALL SELECT 2, value, value + 1 FROM {STEPS} WHERE value IS NOT NULL),
 d AS (SELECT dim, sum((p - q) * (p - q)) AS sq, count(*) AS n, count(DISTINCT q) AS v, avg(CASE WHEN round_even(p, 0) = q THEN 1 ELSE 0 END) AS acc FROM z GROUP BY 1) SELECT round(sum(sq) / sum(n), 6) AS mse, round(sqrt(sum(sq) / sum(n)), 6) AS rmse, round(avg(acc) FILTER (v < 10), 6) AS mean_accuracy, max(n) AS n FROM d""")
def j25(s, d):
    e = b.steps(s, d).filter("value is not null")
    p = e.select(F.array(F.col("yes").cast("double"), F.col("abstain") + 0.4, F.col("value")).alias("p"), F.array(F.col("no").cast("double"), F.col("abstain").cast("double"), F.col("value") + 1).alias("q"))
    return episodes.prediction_metrics(p, "p", "q").withColumns({k: F.round(k, 6) for k in ("mse", "rmse", "mean_accuracy")})


@query("j26_policy_metrics", f"WITH e AS (SELECT trajectory_id, avg(CASE WHEN no = yes % 7 THEN 1 ELSE 0 END) AS acc, sum(value) AS r FROM {STEPS} GROUP BY 1) SELECT round(avg(acc), 6) AS accuracy_mean, round(stddev_pop(acc), 6) AS accuracy_std, round(avg(r), 4) AS return_mean, round(stddev_pop(r), 4) AS return_std, count(*) AS episodes FROM e")
def j26(s, d):
    e = b.steps(s, d).withColumn("guess", (F.col("yes") % 7).cast("int"))
    r = episodes.policy_metrics(e, "trajectory_id", "guess", "no", "value")
    return r.withColumns({"accuracy_mean": F.round("accuracy_mean", 6), "accuracy_std": F.round("accuracy_std", 6), "return_mean": F.round("return_mean", 4), "return_std": F.round("return_std", 4)})


@query("j27_feature_expectations", f"SELECT round(avg(CAST(no > 3 AS INTEGER)), 6) AS is_sponsor, round(avg(yes), 6) AS sponsor_count, round(avg(yes - no), 6) AS committee_support, round(avg(no), 6) AS plenary_support, round(avg(CASE WHEN {STAGE} = 0 THEN 1 ELSE 0 END), 6) AS in_draft, round(avg(CASE WHEN {STAGE} = 1 THEN 1 ELSE 0 END), 6) AS in_committee, round(avg(CASE WHEN {STAGE} = 2 THEN 1 ELSE 0 END), 6) AS in_plenary FROM {STEPS}")
def j27(s, d):
    f = event_states(s, d).select(episodes.irl_features(episodes.state_vector(F.col("state"))).alias("features"))
    return episodes.feature_expectations(f).select(*[F.round(n, 6).alias(n) for n in episodes.FEATURES])


@query("j28_fit_reward")
def j28(s, d):
    f = event_states(s, d).filter("value is not null").select(episodes.irl_features(episodes.state_vector(F.col("state"))).alias("features"), F.col("value").alias("reward"))
    weights = episodes.fit_reward(f)
    return s.createDataFrame([(k, float(w)) for k, w in weights.items()], "feature string, weight double")


@query("j29_holdout_last", f"SELECT event_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY t DESC) = 1 AS is_test FROM {NUMBERED}")
def j29(s, d):
    return episodes.holdout_last(numbered(s, d), ["trajectory_id"]).select("event_id", "is_test")


VERSIONED = f"(SELECT id, 'A/' || CAST(custkey AS VARCHAR) || '/L.1' AS base, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '/Rev.' || CAST(id % 9 AS VARCHAR) ELSE '/Add.' || CAST(id % 9 AS VARCHAR) END AS suffix, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 1 END AS o, CASE id % 3 WHEN 0 THEN 0 ELSE id % 9 END AS n FROM {DOCS})"


@query("j30_version_chains", f"SELECT base, string_agg(base || suffix, ',' ORDER BY o, n) AS versions FROM {VERSIONED} GROUP BY 1")
def j30(s, d):
    suffix = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.concat(F.lit("/Rev."), (F.col("id") % 9).cast("string"))).otherwise(F.concat(F.lit("/Add."), (F.col("id") % 9).cast("string")))
    drafts = b.documents(s, d).select("id", F.concat(F.lit("A/"), F.col("custkey").cast("string"), F.lit("/L.1"), suffix).alias("symbol"))
    e = drafts.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("draft_of").alias("relationship_type"))
    return graph.version_chains(drafts, e, drafts).select("base", F.array_join("versions", ",").alias("versions"))


@query("j31_stage_summary", f"""WITH x AS (SELECT DISTINCT symbol AS trajectory_id, 'resolution' AS stage, symbol FROM {REFS} UNION ALL SELECT symbol, type, ref_symbol FROM {REFS})
 SELECT x.trajectory_id, x.stage, x.symbol, d.date, d.title, CASE WHEN d.id IS NOT NULL THEN CAST(d.id % 9 AS INTEGER) END AS yes, CASE WHEN d.id IS NOT NULL THEN 2 END AS no, CASE WHEN d.id IS NOT NULL THEN 3 END AS abstain,
 CASE WHEN x.stage = 'meeting' THEN CAST(substr(x.symbol, 2) AS BIGINT) % 5 ELSE 0 END AS statements FROM x LEFT JOIN {DOCS} d ON d.symbol = x.symbol""")
def j31(s, d):
    r = order_records(s, d).withColumn("voting", F.struct((F.col("id") % 9).cast("int").alias("yes"), F.lit(2).alias("no"), F.lit(3).alias("abstain")))
    traces = stored(trajectories.trace_backwards(r, supplier_index(s, d)), "traces")
    said = traces.filter("type = 'meeting'").select(F.col("symbol").alias("trajectory_id"), F.col("ref_symbol").alias("meeting"), (F.substring("ref_symbol", 2, 20).cast("long") % 5).alias("statements")).filter("statements > 0")
    return trajectories.stage_summary(traces, r, said)


# ---- evidence (2.K)


@query("k2_stringify", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props FROM events")
def k2(s, d):
    return evidence.stringify(b.table(s, d, "events").select("event_id", "user_id", "event_type", "props"))


@query("k3_evidence_union", f"SELECT 'analysis' AS evidence, 0 AS priority, CAST(id AS VARCHAR) AS id, symbol, NULL AS text FROM {DOCS} UNION ALL SELECT 'utterance', 1, CAST(id AS VARCHAR), NULL, text FROM {UTTERANCES}")
def k3(s, d):
    return evidence.evidence_union(("analysis", b.documents(s, d).select("id", "symbol")), ("utterance", b.utterances(s, d).select("id", "text")))


@query("k4_pick_text", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END, ' '), ''), nullif(trim(lang, ' '), '')) AS picked FROM documents")
def k4(s, d):
    docs = b.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"), F.col("lang").alias("title"))
    return evidence.pick_text(docs, ["doc_id"], None).select("doc_id", "picked")


@query("k5_evidence_text", "SELECT 'n_name: ' || n_name || chr(10) || 'n_nationkey: ' || CAST(n_nationkey AS VARCHAR) AS line FROM nation")
def k5(s, d):
    return evidence.evidence_text(b.table(s, d, "nation").select("n_name", "n_nationkey"), ["n_name"], 100)


@query(
    "k5_evidence_text_documents",
    """SELECT concat_ws(chr(10), 'doc_id: ' || CAST(doc_id AS VARCHAR), CASE WHEN trim(lang, ' ') <> '' THEN 'lang: ' || lang END,
    CASE WHEN trim(text, ' ') <> '' THEN 'text: ' || CASE WHEN length(text) > 2000 THEN left(text, 1500) || '... [truncated] ...' || right(text, 500) ELSE text END END) AS line
    FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100)""",
)
def k5_documents(s, d):
    return evidence.evidence_text(b.table(s, d, "documents").select("doc_id", "lang", "text"), ["doc_id"], 100)


@query("k6_source_links", f"SELECT upper(symbol) AS symbol, 'https://docs.un.org/en/' || upper(symbol) AS url FROM {DOCS}")
def k6(s, d):
    docs = b.documents(s, d)
    files = docs.select("symbol", F.array().cast("array<struct<language:string,url:string>>").alias("files"))
    return evidence.source_links(docs.select("id", F.col("symbol").alias("document_symbol"), "title"), files)


# ---- further operators over texts built from the tables


@query("c3_cited_decisions", "SELECT p_partkey, '78/' || CAST(p_size AS VARCHAR) || ' A;78/' || CAST(p_size AS VARCHAR) || ' B;78/' || CAST(p_size AS VARCHAR) || ' C;79/' || CAST(p_size AS VARCHAR) AS cited FROM part")
def c3(s, d):
    t = F.format_string("%s (decisions 78/%d A to C, 79/%d)", "p_name", "p_size", "p_size")
    return b.table(s, d, "part").select("p_partkey", F.array_join(x.cited_decisions(t), ";").alias("cited"))


@query("c6_split_states", "SELECT document_id, string_agg(name || ' (' || vote_type || ', x)', ';' ORDER BY name, vote_type) AS states FROM " + VOTES + " v JOIN " + ACTORS + " a ON a.id = v.actor_id GROUP BY 1")
def c6(s, d):
    v = b.votes(s, d).join(b.actors(s, d).select(F.col("id").alias("actor_id"), "name"), "actor_id")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "vote_type"))), lambda r: F.concat(r["name"], F.lit(" ("), r["vote_type"], F.lit(", x)"))), ",  ")
    return v.groupBy("document_id").agg(said.alias("t")).select("document_id", F.array_join(x.split_states(F.concat("t", F.lit("."))), ";").alias("states"))


@query("c13_utterance_facts", "SELECT l_orderkey, l_linenumber, 'II' AS ordinal, '78/' || CAST(l_partkey AS VARCHAR) AS number, 'A/RES/78/' || CAST(l_partkey AS VARCHAR) AS symbol, CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'adopted' END AS status, CAST(l_suppkey AS INTEGER) AS yes, CAST(l_linenumber AS INTEGER) AS no, CAST(l_quantity AS INTEGER) AS abstained, 'recorded_vote' AS kind FROM lineitem")
def c13(s, d):
    v = b.table(s, d, "lineitem")
    how = F.when(F.col("l_returnflag") == "R", "rejected").otherwise("adopted")
    t = F.concat(F.lit("Draft resolution II was "), how, F.format_string(" by a vote of %d to %d, with %d abstentions (resolution 78/%d).", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"), "l_partkey"))
    counted = v.select("l_orderkey", "l_linenumber", t.alias("t")).withColumn("votes", x.vote_counts(F.col("t")))
    f = counted.select("l_orderkey", "l_linenumber", x.utterance_facts(F.col("t"), F.col("votes")).alias("f"))
    return f.select("l_orderkey", "l_linenumber", F.col("f.draft_resolution_identifier").alias("ordinal"), F.col("f.resolution_number").alias("number"), F.col("f.resolution_symbol").alias("symbol"), F.col("f.adoption_status").alias("status"), F.col("f.vote_in_favor").alias("yes"), F.col("f.vote_against").alias("no"), F.col("f.vote_abstentions").alias("abstained"), F.col("f.vote_type").alias("kind"))


@query("c10_agenda_items", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), n AS (SELECT c_nationkey, 3 * max(r) AS last FROM c GROUP BY 1)
 SELECT c_nationkey AS id, 1 AS item_no, 'committee_header' AS type, NULL AS item_number, NULL AS sub_item, NULL AS section_letter, 'Third Committee' AS committee, 'Third Committee' AS title, 'Third Committee' AS text, '' AS resolutions, '' AS decisions FROM n
 UNION ALL SELECT c_nationkey, 2, 'section', NULL, NULL, 'B', 'Third Committee', 'Promotion of justice', 'Promotion of justice', '', '' FROM n
 UNION ALL SELECT c_nationkey, 1 + 2 * r, 'main', CAST(c_custkey AS INTEGER), NULL, 'B', 'Third Committee', c_name, c_name || ' of ' || c_mktsegment || ' (resolutions 78/' || CAST(c_custkey AS VARCHAR) || ' and 78/7)', '78/' || CAST(c_custkey AS VARCHAR) || ',78/7', '' FROM c
 UNION ALL SELECT c_nationkey, 2 + 2 * r, 'sub', CAST(c_custkey AS INTEGER), 'a', 'B', 'Third Committee', 'Follow-up (decision 78/9 A and B)', 'Follow-up (decision 78/9 A and B)', '', '78/9 A,78/9 B' FROM c""")
def c10(s, d):
    item = lambda r: F.concat(r["c_custkey"].cast("string"), F.lit(". "), r["c_name"], F.lit("\n  of "), r["c_mktsegment"], F.lit(" (resolutions 78/"), r["c_custkey"].cast("string"), F.lit(" and 78/7)\n(a) Follow-up (decision 78/9 A and B)"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))), item)
    docs = b.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.concat(F.lit("Preface\nThird Committee\nB. Promotion of justice\n"), F.array_join(lines, "\n")).alias("t"))
    rows = x.agenda_items(docs, "id", "t")
    return rows.select("id", "item_no", "type", "item_number", "sub_item", "section_letter", "committee", "title", "text", F.array_join("resolutions", ",").alias("resolutions"), F.array_join("decisions", ",").alias("decisions"))


@query("c8_country_lists_by_space", "SELECT p_partkey, 'New Zealand;Chile;' || replace(p_name, ' ', ';') AS names FROM part")
def c8b(s, d):
    t = F.concat(F.lit("Chile "), "p_name", F.lit(" New Zealand"))
    return b.table(s, d, "part").select("p_partkey", F.array_join(x.country_list(t, "space"), ";").alias("names"))


@query("b14_lenient_outcomes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_returnflag = 'N' OR l_partkey > l_suppkey THEN 'adopted' ELSE 'rejected' END AS outcome FROM lineitem")
def b14(s, d):
    v = b.table(s, d, "lineitem")
    counted = F.col("l_returnflag") == "A"
    return v.select("l_orderkey", "l_linenumber", c.final_outcome(F.when(counted, F.col("l_partkey")), F.when(counted, F.col("l_suppkey")), F.col("l_returnflag") != "R", F.col("l_returnflag") == "N", strict=False).alias("outcome"))



@query("c17_report_items", "SELECT o_custkey AS id, 'A/C.3/78/L.' || CAST(o_orderkey AS VARCHAR) AS draft_symbol, CAST(o_orderkey AS INTEGER) AS draft_number, o_orderpriority AS title, CASE o_orderstatus WHEN 'F' THEN 'without a vote' END AS vote_info, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS INTEGER) END AS in_favor, CASE WHEN o_orderstatus <> 'F' THEN 7 END AS abstentions FROM orders")
def c17(s, d):
    vote = F.when(F.col("o_orderstatus") == "F", "adopted without a vote").otherwise(F.format_string("adopted by a recorded vote of %d to 3, with 7 abstentions", "o_custkey"))
    item = F.concat(F.format_string('B. Draft resolution A/C.3/78/L.%d\nsubmitted by Chile, entitled "%s", ', "o_orderkey", "o_orderpriority"), vote)
    reports = b.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("Introduction\n"), F.array_join(F.collect_list(item), "\n")).alias("t"))
    return x.report_items(reports, "id", "t").select("id", "draft_symbol", "draft_number", "title", "vote_info", "in_favor", "abstentions")


@query("g18_record_stats", f"SELECT session, count(*) AS items, count(*) FILTER (y + n > 0) AS items_with_references, CAST(sum(y) AS BIGINT) AS total_resolutions, CAST(sum(n) AS BIGINT) AS total_decisions FROM (SELECT d.session, len(coalesce(y, [])) AS y, len(coalesce(n, [])) AS n FROM {DOCS} d LEFT JOIN {TALLIED} t ON t.document_id = d.id) GROUP BY 1")
def g18(s, d):
    v = b.votes(s, d).groupBy(F.col("document_id").alias("id")).agg(F.collect_set(F.when(F.col("vote_type") == "in_favour", F.col("actor_id"))).alias("resolutions"), F.collect_set(F.when(F.col("vote_type") == "against", F.col("actor_id"))).alias("decisions"))
    return aggregates.record_stats(b.documents(s, d).join(v, "id", "left"), "session")


@query("j4_trace_draft", f"""SELECT symbol AS draft, 'agenda_item' AS type, 'A/78/251' AS ref_symbol, false AS found FROM {DOCS} WHERE doc_type = 'draft' AND id IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT symbol, CASE WHEN id % 2 = 0 THEN 'resolution' ELSE 'committee_report' END, 'T/' || CAST(id AS VARCHAR), id % 3 = 0 FROM {DOCS} WHERE doc_type = 'draft' AND id % 5 <> 0 AND id IN (SELECT l_orderkey FROM lineitem)""")
def j4(s, d):
    """Most drafts are referred to by a text or by a report."""
    r = stored(order_records(s, d), "records")
    name = F.concat(F.lit("T/"), F.col("id").cast("string"))
    none = F.array().cast("array<struct<text:string,url:string>>")
    refs = F.struct(F.array(F.struct(F.lower("symbol").alias("text"), F.lit(None).cast("string").alias("url"))).alias("drafts"), none.alias("committee_reports"), none.alias("meeting_records"))
    later = r.filter("doc_type = 'draft' and id % 5 <> 0").withColumns({"related_documents": refs, "agenda": F.expr("slice(agenda, 1, 0)"), "kind": F.when(F.col("id") % 2 == 0, "resolutions").otherwise("committee-reports")}).withColumn("symbol", name)
    index = supplier_index(s, d).unionByName(later.filter("id % 3 = 0").select(F.col("symbol").alias("symbol_norm"), F.lit("p").alias("path")))
    return trajectories.trace_draft(r.unionByName(later), index)


@query("j17_country_actions", f"SELECT d.id, CASE WHEN d.doc_type = 'draft' THEN CASE WHEN list_contains(sponsors, a.id) THEN 0 ELSE 4 END WHEN list_contains(p_yes, a.id) THEN 1 WHEN list_contains(p_no, a.id) THEN 2 WHEN list_contains(p_abstain, a.id) THEN 3 END AS action, CASE WHEN NOT coalesce(list_contains(sponsors, a.id), false) THEN 0.0 WHEN d.doc_type = 'resolution' THEN 1.0 ELSE -1.0 END AS reward FROM {DOCS} d JOIN {VOTED} t ON t.document_id = d.id, (SELECT min(id) AS id FROM {ACTORS}) a")
def j17(s, d):
    who = b.actors(s, d).agg(F.min("id").cast("string").alias("who"))  # one row
    t = voted_trajectories(s, d).join(b.documents(s, d).select(F.col("id").alias("trajectory_id"), "doc_type"), "trajectory_id").crossJoin(F.broadcast(who))
    w = F.col("who")
    action = episodes.country_action(F.col("sponsors"), F.col("plenary.yes"), F.col("plenary.no"), F.col("plenary.abstain"), w, F.col("doc_type") == "draft")
    return t.select(F.col("trajectory_id").alias("id"), action.alias("action"), episodes.reward(F.array_contains("sponsors", w), F.coalesce("final_outcome", F.lit("none"))).alias("reward"))


# ---- trajectories of all orders (J2, J7). Suppliers stand for drafts, reports (S), meetings (X) and summary records (SR).


def dossier(s, d):
    """(traces, records, deliberations, items, speeches): what is found, dated, voted and said follows from numbers."""
    k = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda p, n=F.col("k"): F.concat(F.lit(p), n.cast("string"))
    sr = name("A/C.3/78/SR.")
    index = k.filter("k % 5 <> 0").select(name("S").alias("symbol_norm"), F.lit("p").alias("path")).unionByName(k.filter("k % 2 = 0").select(name("X").alias("symbol_norm"), F.lit("p").alias("path"))).unionByName(k.filter("k % 3 <> 0").select(sr.alias("symbol_norm"), F.lit("p").alias("path")))
    index = index.unionByName(k.filter("k = 1").select(F.lit("A/78/251").alias("symbol_norm"), F.lit("p").alias("path")))
    orders = order_records(s, d).withColumn("voting", F.when(F.col("id") % 3 != 0, F.struct((F.col("id") % 4).cast("int").alias("yes"), F.lit(1).alias("no"))))
    traces = trajectories.trace_backwards(orders, index)
    day = F.make_date(F.lit(2024), F.lit(1), (F.col("k") % 9 + 1).cast("int"))
    dated = k.select(name("S").alias("symbol"), day.alias("date"), F.lit(None).cast("string").alias("action_note")).unionByName(k.select(name("X").alias("symbol"), day.alias("date"), F.when(F.col("k") % 3 == 0, name("note ")).alias("action_note")))
    records = orders.withColumn("action_note", F.lit(None).cast("string")).unionByName(dated, allowMissingColumns=True)
    reports = k.select(name("S").alias("symbol"), F.concat(F.lit("It met ("), sr, F.lit(").")).alias("introduction"))
    deliberations = trajectories.committee_deliberations(traces, reports, index)
    some = lambda n: F.when(F.col("k") % n > 0, F.transform(F.sequence(F.lit(1), (F.col("k") % n).cast("int")), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    own = k.select(name("S").alias("report"), F.lit(0).alias("item_no"), name("S", F.col("k") + 1).alias("draft_symbol"), F.lit("").alias("item_text"), F.array(name("c"), F.lit("a")).alias("sponsors"), some(4).alias("in_favour"), some(3).alias("against"), some(2).alias("abstaining"), F.lit("adopted").alias("adoption_status"))
    other = k.select(name("S").alias("report"), F.lit(1).alias("item_no"), F.lit(None).cast("string").alias("draft_symbol"), F.concat(F.lit("on "), name("S", F.col("k") + 2), F.lit(" now")).alias("item_text"), F.array(name("z")).alias("sponsors"), none.alias("in_favour"), none.alias("against"), none.alias("abstaining"), F.lit(None).cast("string").alias("adoption_status"))
    about = b.table(s, d, "lineitem").filter("l_returnflag = 'N'").join(b.documents(s, d), F.col("l_orderkey") == F.col("id")).groupBy(F.col("l_suppkey").alias("k")).agg(F.min("symbol").alias("resolution_symbol"))
    meetings = k.select("k", name("X").alias("meeting")).unionByName(k.select("k", sr.alias("meeting"))).join(about, "k", "left")
    motion = F.array(F.struct(name("S", F.col("k") % 10).alias("draft_id"), F.lit("motion_for_division").alias("event_type"), F.lit("rejected").alias("adoption_status")))
    lists = F.struct(some(5).alias("in_favour"), some(3).alias("against"), some(2).alias("abstaining"))
    first = meetings.select("meeting", F.lit(1).alias("utterance_id"), F.lit(0).alias("position"), F.concat(F.lit("On "), name("s", F.col("k") + 1), F.lit(" we speak")).alias("text"), F.lit(None).cast("string").alias("resolution_symbol"), F.lit(None).cast(SPEECH_VOTES).alias("vote_details"), F.when(F.col("k") % 2 == 0, motion).alias("events"))
    second = meetings.select("meeting", F.lit(2).alias("utterance_id"), F.lit(1).alias("position"), F.when(F.col("k") % 4 == 0, "World PEACE").otherwise("x").alias("text"), "resolution_symbol", F.when(F.col("k") % 3 != 0, lists).alias("vote_details"), F.lit(None).cast("array<struct<draft_id:string,event_type:string,adoption_status:string>>").alias("events"))
    return traces, records, deliberations, own.unionByName(other), first.unionByName(second)


SPEECH_VOTES = "struct<in_favour:array<string>,against:array<string>,abstaining:array<string>>"
DOSSIER = f"""WITH r AS (SELECT symbol, type, ref_symbol, TRY_CAST(substr(ref_symbol, 2) AS BIGINT) AS k, row_number() OVER (PARTITION BY symbol, type ORDER BY ref_symbol) - 1 AS pos FROM {REFS}),
 f AS (SELECT *, 'S' || CAST(k AS VARCHAR) AS s, CAST(make_date(2024, 1, CAST(k % 9 + 1 AS INTEGER)) AS VARCHAR) AS day FROM r WHERE CASE type WHEN 'agenda_item' THEN true WHEN 'meeting' THEN k % 2 = 0 ELSE k % 5 <> 0 END),
 drafts AS (SELECT symbol, ref_symbol AS draft FROM r WHERE type = 'draft'), reports AS (SELECT symbol, k, pos, day FROM f WHERE type = 'committee_report'), meetings AS (SELECT symbol, k, pos, CASE WHEN k % 3 = 0 THEN 'note ' || CAST(k AS VARCHAR) ELSE day END AS day FROM f WHERE type = 'meeting'),
 summaries AS (SELECT DISTINCT symbol, k FROM reports WHERE k % 3 <> 0),
 said AS (SELECT s_suppkey AS k, 1 AS u, 'on s' || CAST(s_suppkey + 1 AS VARCHAR) || ' we speak' AS text FROM supplier UNION ALL SELECT s_suppkey, 2, CASE WHEN s_suppkey % 4 = 0 THEN 'world peace' ELSE 'x' END FROM supplier),
 relevant AS (SELECT k, u, draft, contains(text, 'peace') AS kw FROM said LEFT JOIN (SELECT DISTINCT draft FROM drafts) ON contains(text, lower(draft))),
 talk AS (SELECT q.symbol, q.k, count(DISTINCT u) AS statements FROM (SELECT symbol, k FROM summaries UNION SELECT symbol, k FROM meetings) q JOIN relevant v ON v.k = q.k WHERE v.kw OR EXISTS (SELECT 1 FROM drafts d WHERE d.symbol = q.symbol AND d.draft = v.draft) GROUP BY 1, 2),"""


@query("j2_committee_deliberations", f"{DOSSIER} x AS (SELECT 1) SELECT symbol, 'S' || CAST(k AS VARCHAR) AS report, 'A/C.3/78/SR.' || CAST(k AS VARCHAR) AS record, k % 3 <> 0 AS found FROM reports")
def j2(s, d):
    return dossier(s, d)[2]


@query("j7_trajectories", f"""{DOSSIER}
 items AS (SELECT d.symbol, d.draft, p.k, CASE WHEN d.draft = 'S' || CAST(p.k + 1 AS VARCHAR) THEN ['c' || CAST(p.k AS VARCHAR), 'a'] ELSE ['z' || CAST(p.k AS VARCHAR)] END AS names FROM drafts d JOIN reports p ON p.symbol = d.symbol AND (d.draft = 'S' || CAST(p.k + 1 AS VARCHAR) OR contains('on S' || CAST(p.k + 2 AS VARCHAR) || ' now', d.draft))),
 sponsors AS (SELECT symbol, draft, list_sort(list_distinct(flatten(list(names)))) AS names FROM items GROUP BY 1, 2),
 about AS (SELECT l_suppkey AS k, min(symbol) AS symbol FROM lineitem JOIN {DOCS} ON id = l_orderkey WHERE l_returnflag = 'N' GROUP BY 1),
 st AS (SELECT symbol, 1 AS part, 0 AS place, 1 AS after, 0 AS within, ref_symbol AS source, 'agenda_allocation' AS stage, NULL AS date, 'allocate_to_committee' AS action_type, 'General Assembly' AS actor, NULL AS sponsors, NULL AS yes, NULL AS no, NULL AS abstain, NULL AS outcome, NULL AS n_statements FROM f WHERE type = 'agenda_item'
  UNION ALL SELECT f.symbol, 2, pos, 2, 0, ref_symbol, 'draft_submission', day, 'submit_draft', coalesce(p.names[1], 'Unknown'), array_to_string(coalesce(p.names, []), ','), NULL, NULL, NULL, NULL, NULL FROM f LEFT JOIN sponsors p ON p.symbol = f.symbol AND p.draft = f.ref_symbol WHERE type = 'draft'
  UNION ALL SELECT symbol, 3, 0, 3, 0, 'A/C.3/78/SR.' || CAST(k AS VARCHAR), 'committee_deliberation', NULL, 'statements', 'Multiple delegations', NULL, NULL, NULL, NULL, NULL, statements FROM summaries JOIN talk USING (symbol, k)
  UNION ALL SELECT p.symbol, 4, pos, 4, 0, 'S' || CAST(p.k AS VARCHAR), 'committee_vote', day, 'recorded_vote', NULL, NULL, p.k % 4, p.k % 3, p.k % 2, 'adopted', NULL FROM reports p JOIN drafts d ON d.symbol = p.symbol AND d.draft = 'S' || CAST(p.k + 1 AS VARCHAR)
  UNION ALL SELECT m.symbol, 5, pos, 5, 0, 'X' || CAST(m.k AS VARCHAR), 'plenary_procedural_vote', day, 'motion_for_division', 'General Assembly', NULL, NULL, NULL, NULL, 'rejected', NULL FROM meetings m WHERE EXISTS (SELECT 1 FROM drafts d WHERE d.symbol = m.symbol AND contains(d.draft, 'S' || CAST(m.k % 10 AS VARCHAR)))
  UNION ALL SELECT symbol, 5, pos, 6, 0, 'X' || CAST(k AS VARCHAR), 'plenary_discussion', day, 'statements', 'Multiple delegations', NULL, NULL, NULL, NULL, NULL, statements FROM meetings JOIN talk USING (symbol, k)
  UNION ALL SELECT m.symbol, 5, pos, 7, 0, 'X' || CAST(m.k AS VARCHAR), 'plenary_vote', day, 'recorded_vote', 'General Assembly Members', NULL, m.k % 5, m.k % 3, m.k % 2, CASE WHEN m.k % 5 > m.k % 3 THEN 'adopted' ELSE 'rejected' END, NULL FROM meetings m JOIN about a ON a.k = m.k AND a.symbol = m.symbol WHERE m.k % 3 <> 0)
 SELECT st.symbol AS trajectory_id, CAST(row_number() OVER (PARTITION BY st.symbol ORDER BY part, place, source, after) - 1 AS INTEGER) AS t, stage, st.date, action_type, actor, source, sponsors, CAST(yes AS INTEGER) AS yes, CAST(no AS INTEGER) AS no, CAST(abstain AS INTEGER) AS abstain, outcome, n_statements,
 CASE WHEN d.id % 3 = 0 THEN 'unknown' WHEN d.id % 4 > 1 THEN 'adopted' ELSE 'rejected' END AS final_outcome FROM st JOIN {DOCS} d ON d.symbol = st.symbol""")
def j7(s, d):
    steps = trajectories.build_trajectories(*dossier(s, d), keywords=["Peace"])
    return steps.select("trajectory_id", "t", "stage", "date", "action_type", "actor", "source", F.array_join("sponsors", ",").alias("sponsors"), "yes", "no", "abstain", "outcome", "n_statements", "final_outcome")


# ---- sources and sinks (2.A) over files that are written below the shared folder and read back


def folder(s, name):
    return f"{stored_below(s)}/{name}-{uuid.uuid4().hex[:12]}"


@query("a1_read_parsed", "SELECT symbol, draft_text, word_count, broken FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'A/78/L.' || CAST(doc_id AS VARCHAR) END AS symbol, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS draft_text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE length(text) END AS word_count, doc_id % 7 = 0 AS broken FROM documents)")
def a1(s, d):
    """Documents as JSON lines of parsed drafts; every seventh is cut short."""
    record = F.to_json(F.struct(F.struct(F.concat(F.lit("A/78/L."), F.col("doc_id").cast("string")).alias("symbol")).alias("metadata"), F.col("text").alias("draft_text"), F.struct(F.length("text").alias("word_count")).alias("stats")))
    path = folder(s, "parsed")
    b.table(s, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.lit('{"metadata": {"symbol"')).otherwise(record).alias("value")).write.text(path)
    r = readers.read_parsed(s, path, "drafts", one_per_line=True)
    return r.select("symbol", "draft_text", F.col("stats.word_count").cast("long").alias("word_count"), F.col("_corrupt").isNotNull().alias("broken"))


def marc(tag, **codes):
    """A field of a catalogue record; subfields whose value is null are left out."""
    parts = F.filter(F.array(*[F.struct(v.cast("string").alias("_VALUE"), F.lit(k).alias("_code")) for k, v in codes.items()]), lambda p: p["_VALUE"].isNotNull())
    return F.struct(F.lit(tag).alias("_tag"), F.lit(" ").alias("_ind1"), F.lit(" ").alias("_ind2"), parts.alias("subfield"))


RECORDS_IN_FILE = 20_000  # an XML file is read whole by one task


def write_catalogue(s, d):
    """Orders as catalogue records, with their lines as a roll call and their type as a subject; plain XML would take thirty times
    the disk."""
    v = b.votes(s, d).join(b.actors(s, d).select(F.col("id").alias("actor_id"), "name"), "actor_id")
    sign = F.when(F.col("vote_type") == "in_favour", "Y").when(F.col("vote_type") == "against", "N")
    v = v.select(F.col("document_id").alias("id"), "name", sign.alias("sign"))  # fields are made of them behind the shuffle
    calls = v.groupBy("id").agg(F.collect_list(F.struct("name", "sign")).alias("calls"), F.count_if(F.col("sign") == "Y").alias("yes"), F.count_if(F.col("sign") == "N").alias("no"))
    docs = b.documents(s, d).join(calls, "id").withColumn("calls", F.transform("calls", lambda v: marc("967", e=v["name"], d=v["sign"])))
    n = F.col("id").cast("string")
    fields = F.array(
        marc("191", a=F.col("symbol")), marc("245", a=F.col("title"), b=F.lit("part two")), marc("269", a=F.col("date")), marc("650", a=F.lit("PEACE")), marc("650", a=F.col("doc_type")), marc("710", a=F.concat(F.lit("C"), F.col("custkey").cast("string"))),
        marc("856", y=F.lit("English"), s=n, u=F.concat(F.lit("http://x/"), n, F.lit("-en.pdf"))), marc("856", y=F.lit("French"), u=F.lit(None)), marc("996", b=F.col("yes"), c=F.col("no")),
    )
    path = folder(s, "catalogue")
    control = F.array(F.struct(n.alias("_VALUE"), F.lit("001").alias("_tag")))
    records = docs.select(control.alias("controlfield"), F.concat(fields, "calls").alias("datafield"))
    records.write.format("xml").options(rowTag="record", rootTag="collection", indent="", compression="gzip", maxRecordsPerFile=RECORDS_IN_FILE).save(path)
    delete_at_end(s, path)
    return path


LISTED = f"{DOCS} WHERE id IN (SELECT l_orderkey FROM lineitem)"


@query("a3_catalogue_records", f"SELECT CAST(id AS VARCHAR) AS record_id, symbol, title || ' part two' AS title, CAST(date AS VARCHAR) AS date, 'PEACE,' || doc_type AS subjects, 'C' || CAST(custkey AS VARCHAR) AS authors, 'English ' || CAST(id AS VARCHAR) || ' http://x/' || CAST(id AS VARCHAR) || '-en.pdf' AS files FROM {LISTED}")
def a3(s, d):
    r = readers.read_marc_records(s, write_catalogue(s, d))
    files = F.array_join(F.transform("files", lambda f: F.concat_ws(" ", f["language"], f["size"].cast("string"), f["url"])), ",")
    return r.select("record_id", "symbol", "title", "date", F.array_join("subjects", ",").alias("subjects"), F.array_join("authors", ",").alias("authors"), files.alias("files"))


@query("a4_roll_calls", f"SELECT 'vote_' || CAST(document_id AS VARCHAR) AS symbol, name AS country, CASE vote_type WHEN 'in_favour' THEN 'Y' WHEN 'against' THEN 'N' ELSE 'X' END AS vote FROM {VOTES} v JOIN {ACTORS} a ON a.id = v.actor_id JOIN {DOCS} d ON d.id = v.document_id")
def a4(s, d):
    return readers.explode_roll_call(readers.read_marc_votes(s, write_catalogue(s, d)))


@query("a4_roll_call_counts", f"SELECT CAST(document_id AS VARCHAR) AS record_id, CAST(count(*) FILTER (vote_type = 'in_favour') AS INTEGER) AS yes, CAST(count(*) FILTER (vote_type = 'against') AS INTEGER) AS no, 0 AS abstain, 0 AS total FROM {VOTES} JOIN {DOCS} d ON d.id = document_id GROUP BY 1")
def a4b(s, d):
    return readers.read_marc_votes(s, write_catalogue(s, d)).select("record_id", "counts.yes", "counts.no", "counts.abstain", "counts.total")


@query("a5_page_rows", "SELECT page_id, 'Title' AS label, 'v' || CAST(page_id AS VARCHAR) || ' b' AS value FROM pages UNION ALL SELECT page_id, 'Date', CAST(page_id % 28 + 1 AS VARCHAR) || ' May 2023' FROM pages")
def a5c(s, d):
    """Every page with two rows of metadata put in front."""
    row = lambda label, value: F.concat(F.lit(f'<div class="metadata-row"><span class="title col">{label}</span>\n<span class="value"> '), value, F.lit(" </span></div>"))
    n = F.col("page_id").cast("string")
    html = F.concat(row("Title", F.concat(F.lit("v"), n, F.lit("<b> b</b>"))), row("Date", F.concat((F.col("page_id") % 28 + 1).cast("string"), F.lit(" May 2023"))), F.coalesce("html", F.lit("")))
    m = readers.page_metadata(b.table(s, d, "pages").withColumn("html", html))
    return m.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.label", F.regexp_replace("r.value", r"\s+", " ").alias("value"))


@query("a5_file_links", "SELECT page_id, 'FR' AS language, 'https://lib.org/' || CAST(page_id AS VARCHAR) || '.pdf' AS url FROM pages UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ES' ELSE 'EN' END, 'https://lib.org/x/' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '-es' ELSE '' END || '.pdf?a=1' FROM pages")
def a5d(s, d):
    """Links with either quote, with tags inside of their text, and twice the same."""
    n = F.col("page_id").cast("string")
    end = F.when(F.col("page_id") % 2 == 0, "-es").otherwise("")
    html = F.concat(F.lit("<a class=x href='/"), n, F.lit(".pdf'><b>Français</b> </a><A HREF=\"/"), n, F.lit('.pdf">English</a><a href="/x/'), n, end, F.lit('.pdf?a=1">file</a><a href="/y">no</a>'))
    return readers.file_links(readers.page_links(b.table(s, d, "pages").withColumn("html", html), "https://lib.org"))


@query("a6_tables_as_views", f"SELECT a.name, count(*) AS n FROM {VOTES} v JOIN {ACTORS} a ON a.id = v.actor_id GROUP BY 1")
def a6(s, d):
    """Tables written, registered as views, and read by SQL."""
    path = folder(s, "tables")
    writers.write_tables({"actors": b.actors(s, d), "votes": b.votes(s, d)}, path)
    readers.register_tables(s, path, ["actors", "votes"])
    return s.sql("SELECT a.name, count(*) AS n FROM votes v JOIN actors a ON a.id = v.actor_id GROUP BY a.name")


@query("a8_csv", f"SELECT id, symbol, title, CAST(date AS VARCHAR) AS date FROM (SELECT id, symbol, CASE WHEN id % 3 <> 0 THEN title || ', \"x\"' END AS title, date FROM {DOCS} ORDER BY id LIMIT 500)")
def a8(s, d):
    path = folder(s, "csv")
    docs = b.documents(s, d).select("id", "symbol", F.when(F.col("id") % 3 != 0, F.concat("title", F.lit(', "x"'))).alias("title"), "date")
    writers.write_csv(docs.orderBy("id"), path)
    return s.read.option("header", True).option("escape", '"').schema("id long, symbol string, title string, date string").csv(path)


@query("a9_json", "SELECT conv_id, turn, role, text FROM conversations")
def a9(s, d):
    path = folder(s, "json")
    writers.write_json(b.table(s, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return s.read.schema("conv_id long, turn long, role string, text string").json(path)


@query("a10_mermaid_file", "SELECT line FROM (SELECT 'graph LR' AS line UNION ALL SELECT '    R' || CAST(r_regionkey AS VARCHAR) || '[\"' || r_name || '\"]' FROM region UNION ALL SELECT '    N' || CAST(n_nationkey AS VARCHAR) || '[\"' || n_name || '\"]' FROM nation UNION ALL SELECT '    S' || CAST(s_suppkey AS VARCHAR) || '[\"' || s_name || '\"]' FROM supplier UNION ALL SELECT '    N' || CAST(n_nationkey AS VARCHAR) || ' -->|meeting_record_for| R' || CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT '    S' || CAST(s_suppkey AS VARCHAR) || ' -->|agenda_item_for| N' || CAST(s_nationkey AS VARCHAR) FROM supplier)")
def a10b(s, d):
    path = folder(s, "mermaid")
    nodes = b.nodes(s, d).filter(F.col("id").rlike("^[RNS]"))
    e = b.edges(s, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship_type").alias("relation"))
    writers.write_mermaid(nodes, e, path)
    return s.read.text(path).withColumnRenamed("value", "line")


# ---- heads, bodies, titles and sponsors of texts built from the tables


@query("b3_committee_names", f"SELECT id, CASE id % 3 WHEN 0 THEN 'Third Committee' WHEN 1 THEN ['First', 'Second', 'Third', 'Fourth', 'Fifth', 'Sixth'][CAST(custkey % 6 + 1 AS INTEGER)] || ' Committee' ELSE 'Special Political And Decolonization Committee' END AS name FROM {DOCS}")
def b3(s, d):
    said = F.when(F.col("id") % 3 == 0, "Report of the THIRD   Committee").when(F.col("id") % 3 == 1, "nothing").otherwise("Special Political and Decolonization Committee")
    return b.documents(s, d).select("id", c.collapse_ws(c.committee_name(said, F.col("symbol"))).alias("name"))


@query("b13_document_kinds", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'amendment' WHEN 1 THEN 'draft_decision' WHEN 2 THEN 'resolution' WHEN 3 THEN 'draft_resolution' END AS kind FROM part")
def b13(s, d):
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, "Amendment to draft resolution").when(k == 1, "Draft Decision").when(k == 2, "Resolution adopted by the General Assembly").when(k == 3, "draft resolution").otherwise("none")
    return b.table(s, d, "part").select("p_partkey", c.document_kind(F.concat("p_name", F.lit("\n"), said, F.lit("\nx"))).alias("kind"))


@query("b15_symbols_of_stems", f"SELECT id, symbol FROM {DOCS}")
def b15(s, d):
    return b.documents(s, d).select("id", c.symbol_of_stem(c.symbol_filename(F.col("symbol"))).alias("symbol"))


@query("b22_bodies", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nullif(text, '') WHEN 1 THEN nullif(lang, '') WHEN 2 THEN nullif(source, '') ELSE concat_ws(chr(10) || chr(10), nullif(lang, ''), nullif(source, '')) END AS body FROM documents")
def b22(s, d):
    k = F.col("doc_id") % 4
    record = F.struct(F.when(k == 0, F.col("text")).alias("introduction"), F.when(k == 1, F.col("lang")).otherwise("").alias("draft_text"), F.struct(F.when(k == 2, F.col("source")).alias("full_text")).alias("raw_text"), F.struct(F.when(k == 3, F.col("lang")).alias("preamble"), F.when(k == 3, F.col("source")).alias("operative")).alias("text_segments"))
    return b.table(s, d, "documents").select("doc_id", F.nullif(c.body_text(record, "resolutions"), F.lit("")).alias("body"))


@query("b23_draft_heads", "SELECT p_partkey, 'A/78/L.' || CAST(p_partkey AS VARCHAR) AS symbol, 'Limited' AS distribution, CAST(p_size AS VARCHAR) || ' May 2023' AS date, 'English' AS original_language, 'Seventy-eighth session' AS session_name, p_size AS agenda_item, 'Draft resolution on ' || p_type AS submission_type FROM part")
def b23(s, d):
    head = F.concat(F.lit("A\nUnited Nations /78/L."), F.col("p_partkey").cast("string"), F.lit("\nDistr.: Limited\n"), F.col("p_size").cast("string"), F.lit(" May 2023\nOriginal: English\nSeventy-eighth session\nAgenda item "), F.col("p_size").cast("string"), F.lit("\n"), "p_name", F.lit("\nDraft resolution on "), "p_type", F.lit("\nThe General Assembly"))
    f = b.table(s, d, "part").select("p_partkey", c.header_fields(head, "draft").alias("f"))
    return f.select("p_partkey", *[f"f.{k}" for k in ("symbol", "distribution", "date", "original_language", "session_name", "agenda_item", "submission_type")])


@query("b23_meeting_heads", "SELECT s_suppkey, 'A/78/PV.' || CAST(s_suppkey AS VARCHAR) AS symbol, 'Seventy-eighth session' AS session, CAST(s_suppkey AS INTEGER) AS meeting_number, 'Geneva' AS location, 'Mr. ' || s_name AS president, '3 p' AS called_to_order_at FROM supplier")
def b23b(s, d):
    n = F.col("s_suppkey").cast("string")
    head = F.concat(F.lit("United Nations A / 78 / PV."), n, F.lit("\nSeventy-eighth session\n"), n, F.lit("th plenary meeting\nTuesday, 9 January 2024, 10 a.m.\nGeneva\nPresident: Mr. "), "s_name", F.lit("\nThe meeting was called to order at 3 p.m.\n"))
    f = b.table(s, d, "supplier").select("s_suppkey", c.header_fields(head, "meeting").alias("f"))
    return f.select("s_suppkey", *[f"f.{k}" for k in ("symbol", "session", "meeting_number", "location", "president", "called_to_order_at")])


@query("b24_draft_bodies", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Recalling ' || p_name || chr(10) || 'end' WHEN 1 THEN p_name || chr(10) || 'end' ELSE 'The General Assembly,' || chr(10) || p_name END AS body FROM part")
def b24(s, d):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("A\nUnited Nations\n  Recalling "), "p_name", F.lit("\nend"))).when(k == 1, F.concat(F.lit("Distr.\n" * 12), "p_name", F.lit("\nend"))).otherwise(F.concat(F.lit("A\nRecalling x\nThe General Assembly,\n"), "p_name"))
    return b.table(s, d, "part").select("p_partkey", c.draft_body(t).alias("body"))


@query("b25_titles", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name || ' ' || p_brand WHEN 2 THEN p_name ELSE p_brand END AS title FROM part")
def b25(s, d):
    k = F.col("p_partkey") % 4
    resolution = F.concat(F.lit("Agenda item 9\n\n"), "p_name", F.lit("\n"), "p_brand", F.lit("\n\nResolution adopted by the General Assembly\n"))
    numbered = F.concat(F.lit("Resolution adopted by the General Assembly\n78/9. "), "p_name", F.lit("\nThe General Assembly"))
    draft = F.concat(F.lit("x: draft resolution\n\n"), "p_brand", F.lit("\n\nThe General Assembly,\nRecalling"))
    t = F.when(k == 1, resolution).when(k == 2, numbered).otherwise(draft)
    return b.table(s, d, "part").select("p_partkey", c.title_of(t, F.when(k == 0, F.concat("p_type", F.lit(" : sponsors")))).alias("title"))


@query("c2_summary_records", "SELECT s_suppkey, CAST(unnest([0, 1]) AS INTEGER) AS pos, 'A/C.' || CAST(unnest([3, 4]) AS VARCHAR) || '/78/SR.' || CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier")
def c2b(s, d):
    n = F.col("s_suppkey").cast("string")
    t = F.concat(F.lit("see A/C.3/78/SR."), n, F.lit(" and (A/C.4/78/SR."), n, F.lit("), A/C.3/78/SR."), n, F.lit(" again, not A/78/PV.1"))
    return x.sr_references(b.table(s, d, "supplier").select("s_suppkey", t.alias("t")), "s_suppkey", "t")


@query("c5_resolution_paragraphs", """SELECT p_partkey, 'preamble' AS part, 1 AS ordinal, NULL AS sub, 'The General Assembly, ' || p_name AS text FROM part UNION ALL SELECT p_partkey, 'preamble', 2, NULL, 'Recalling ' || p_type FROM part
 UNION ALL SELECT p_partkey, 'operative', 1, NULL, '1. Decides ' || p_brand || ':' FROM part UNION ALL SELECT p_partkey, 'sub', 1, 'a', '(a) To go; and' FROM part UNION ALL SELECT p_partkey, 'sub', 1, 'b', '(b) To stay.' FROM part UNION ALL SELECT p_partkey, 'operative', 2, NULL, '2. Requests ' || p_name || '.' FROM part""")
def c5b(s, d):
    t = F.concat(F.lit("The General Assembly,\n"), "p_name", F.lit("\nRecalling "), "p_type", F.lit("\n1. Decides "), "p_brand", F.lit(":\n(a) To go; and\n(b) To stay.\n2. Requests "), "p_name", F.lit(".\n"))
    return x.segment_text(b.table(s, d, "part").select("p_partkey", t.alias("t")), "p_partkey", "t")


@query("c14_draft_sponsors", "SELECT 'A/C.3/78/L.' || CAST(n_nationkey AS VARCHAR) AS draft_symbol, string_agg(DISTINCT name, ',' ORDER BY name) AS sponsors FROM (SELECT n_nationkey, s_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT n_nationkey, 'Chile' FROM nation JOIN supplier ON s_nationkey = n_nationkey) GROUP BY 1")
def c14(s, d):
    """Suppliers of a nation submit its draft in items of their own; Chile joins. Some items name the draft in the text only."""
    v = b.table(s, d, "supplier")
    draft = F.concat(F.lit("A/C.3/78/L."), F.col("s_nationkey").cast("string"))
    named = F.col("s_suppkey") % 2 == 0
    text = F.concat(F.when(named, "").otherwise(F.concat(F.lit("On "), draft, F.lit(" "))), F.lit("submitted by "), "s_name", F.lit(". Subsequently, Chile joined in sponsoring."))
    items = v.select(F.when(named, draft).alias("draft_symbol"), text.alias("item_text"))
    return x.draft_sponsors(items, v.select(draft.alias("draft_symbol"))).withColumn("sponsors", F.array_join("sponsors", ","))


@query("c15_title_page_sponsors", "SELECT p_partkey, 'Austria,Belgium Brazil,Chile' AS sponsors, 'Denmark,' || p_brand AS later FROM part")
def c15(s, d):
    t = F.concat(F.lit("United Nations\nAgenda item 7\n"), F.lower("p_name"), F.lit("\nAustria, Belgium\nBrazil and Chile: draft resolution\n"), "p_type")
    notes = F.concat(F.lit("Additional sponsors: Denmark and "), "p_brand", F.lit(" (A/78/1)"))
    return b.table(s, d, "part").select("p_partkey", F.array_join(x.header_sponsors(t), ",").alias("sponsors"), F.array_join(x.additional_sponsors(notes), ",").alias("later"))


@query("d2_active_draft", f"SELECT id, last_value(CASE WHEN position_in_meeting % 3 = 1 THEN 'A/78/L.' || CAST(position_in_meeting AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY position_in_meeting, id ROWS UNBOUNDED PRECEDING) AS active_draft FROM {UTTERANCES}")
def d2b(s, d):
    u = b.utterances(s, d)
    named = F.when(F.col("position_in_meeting") % 3 == 1, F.array(F.lit("A/78/1"), F.concat(F.lit("A/78/L."), F.col("position_in_meeting").cast("string")))).otherwise(F.array(F.lit("A/78/1")))
    return sequences.carry_active_draft(u.withColumn("documents", named), ["meeting_id"], ["position_in_meeting", "id"]).select("id", "active_draft")


@query("j30_version_stats", f"WITH g AS (SELECT base, count(*) AS n, bool_or(o = 4) AS r, bool_or(o = 1) AS a FROM {VERSIONED} GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (n > 1) AS with_versions, count(*) FILTER (n = 1) AS single, round(avg(n), 6) AS mean_versions, count(*) FILTER (r) AS with_rev, count(*) FILTER (a) AS with_add FROM g")
def j30b(s, d):
    suffix = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.concat(F.lit("/Rev."), (F.col("id") % 9).cast("string"))).otherwise(F.concat(F.lit("/Add."), (F.col("id") % 9).cast("string")))
    drafts = b.documents(s, d).select("id", F.concat(F.lit("A/"), F.col("custkey").cast("string"), F.lit("/L.1"), suffix).alias("symbol"))
    none = b.edges(s, d).limit(0).select(F.col("source_id").cast("long").alias("source_id"), F.col("target_id").cast("long").alias("target_id"), "relationship_type")
    t = graph.version_stats(graph.version_chains(drafts, none, drafts))
    return t.select("total", "with_versions", "single", F.round("mean_versions", 6).alias("mean_versions"), "with_rev", "with_add")


@query("k1_capped", "SELECT count(*) > 100 AS more, least(count(*), 100) AS shown FROM documents")
def k1(s, d):
    rows, more = evidence.capped(b.table(s, d, "documents").select("doc_id"), 100)
    return rows.agg(F.lit(more).alias("more"), F.count(F.lit(1)).alias("shown"))
