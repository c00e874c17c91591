"""Look-ups over the record tables (inventory F6 to F21). Arguments left out add no condition.

Those that look for words inside texts take the trigram postings of that column (``postings.index``, by the id column),
and scan the column where there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.functions.columns import json_title, preview, relation_bucket
from folkmoot.operators.postings import Postings


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def optional(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """the conjunction of those conditions that are given."""
    for c in conditions:
        df = df if c is None else df.filter(c)
    return df


def named_docs(docs: DataFrame, key: str, prefix: str = "") -> DataFrame:
    return docs.select(F.col("id").alias(key), *[F.col(c).alias(prefix + c) for c in ("symbol", "doc_type", "title", "date", "session")])


def votes_for(votes: DataFrame, actors: DataFrame, docs: DataFrame, symbol: str | None = None, vote_event_id: int | None = None, vote_type: str | None = None) -> DataFrame:
    """(actor, vote_type, vote_context) of a document, an event, or both."""
    if symbol is None and vote_event_id is None:
        raise ValueError("a symbol or a vote event is needed")
    v = optional(votes, None if vote_event_id is None else F.col("vote_event_id") == vote_event_id, None if vote_type is None else F.col("vote_type") == vote_type)
    if symbol is not None:
        v = v.join(docs.filter(F.col("symbol") == symbol).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return v.join(actors.select(F.col("id").alias("actor_id"), F.col("name").alias("actor")), "actor_id").select("actor", "vote_type", "vote_context")


def vote_events(events: DataFrame, docs: DataFrame, votes: DataFrame, target_symbol: str | None = None, meeting_symbols: list[str] | None = None, event_types: list[str] | None = None, include_tallies: bool = True) -> DataFrame:
    """events with their meeting and, where known, target; tallies on request."""
    e = optional(events, None if event_types is None else F.col("event_type").isin(*event_types))
    e = e.join(named_docs(docs, "meeting_id").select("meeting_id", F.col("symbol").alias("meeting")), "meeting_id")
    e = e.join(docs.select(F.col("id").alias("target_document_id"), F.col("symbol").alias("target")), "target_document_id", "left")
    e = optional(e, None if target_symbol is None else F.col("target") == target_symbol, None if meeting_symbols is None else F.col("meeting").isin(*meeting_symbols))
    out = e.select("id", "meeting", "target", "event_type", "description", "result")
    if include_tallies:
        from folkmoot.operators.aggregates import vote_tallies

        out = vote_tallies(out.withColumnRenamed("id", "vote_event_id"), votes, "vote_event_id").withColumnRenamed("vote_event_id", "id")
    return out


def utterances_of(utterances: DataFrame, docs: DataFrame, meetings: list[str] | None = None, countries: list[str] | None = None, full_text: bool = False, index: Postings | None = None) -> DataFrame:
    """F8: speeches of meetings, by position; the text or its first 500 characters. ``index``: of speaker_affiliation."""
    if countries and index is not None:
        utterances = index.holding(utterances, "id", "speaker_affiliation", countries)
    u = utterances.join(docs.select(F.col("id").alias("meeting_id"), F.col("symbol").alias("meeting")), "meeting_id")
    u = optional(u, None if not meetings else F.col("meeting").isin(*meetings), None if not countries else any_of([F.col("speaker_affiliation").ilike(f"%{c}%") for c in countries]))
    text = F.col("text") if full_text else preview(F.col("text"), 500)
    return u.select("meeting", "position_in_meeting", "speaker_name", "speaker_affiliation", text.alias("text")).orderBy("meeting", "position_in_meeting")


def related_utterances(utterances: DataFrame, docs: DataFrame, links: DataFrame, symbols: list[str] | None = None, reference_type: str | None = None, country: str | None = None, limit: int = 200, index: tuple[Postings, Postings] | None = None) -> DataFrame:
    """speeches that refer to documents, by symbol, date and position. ``index``: of speaker_affiliation and speaker_name."""
    if country is not None and index is not None:
        named = [i.matches(utterances, "id", c, utterances.sparkSession.createDataFrame([(country,)], "pattern string")) for i, c in zip(index, ("speaker_affiliation", "speaker_name"))]
        hits = named[0].unionByName(named[1]).select(F.col("key").alias("id")).distinct()
        utterances = utterances.join(hits, "id", "left_semi")
    rows = optional(links, None if reference_type is None else F.col("reference_type") == reference_type)
    rows = rows.join(docs.select(F.col("id").alias("document_id"), "symbol"), "document_id")
    rows = optional(rows, None if symbols is None else F.col("symbol").isin(*symbols))
    rows = rows.join(utterances.withColumnRenamed("id", "utterance_id"), "utterance_id").join(docs.select(F.col("id").alias("meeting_id"), F.col("symbol").alias("meeting"), "date"), "meeting_id")
    rows = optional(rows, None if country is None else F.col("speaker_affiliation").ilike(f"%{country}%") | F.col("speaker_name").ilike(f"%{country}%"))
    return rows.select("symbol", "meeting", "date", "position_in_meeting", "utterance_id", "speaker_name", "speaker_affiliation", "reference_type", preview(F.col("text"), 500).alias("text")).orderBy("symbol", F.asc_nulls_last("date"), "position_in_meeting", "utterance_id").limit(limit)


def document_details(docs: DataFrame, symbols: list[str]) -> DataFrame:
    """F10."""
    return docs.filter(F.col("symbol").isin(*symbols))


def full_text_context(docs: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """documents that point to each target, newest first, with their bucket."""
    near = edges.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(named_docs(docs, "source_id"), "source_id")
    return near.select("target_id", "symbol", "doc_type", "date", "relationship_type", relation_bucket(F.col("relationship_type"), F.col("doc_type")).alias("bucket")).orderBy("target_id", F.desc_nulls_last("date"), "symbol")


def link_report(docs: DataFrame, edges: DataFrame, symbol: Column) -> DataFrame:
    """the resolutions for which ``symbol`` holds, and under each its incoming links."""
    titled = docs.withColumn("shown", json_title(F.col("title"), F.col("doc_metadata")))
    own = titled.filter(symbol)
    rows = own.select(F.col("symbol").alias("target"), F.lit("resolution").alias("relationship_type"), "symbol", "doc_type", F.col("shown").alias("title"))
    incoming = own.select(F.col("id").alias("target_id"), F.col("symbol").alias("target")).join(edges, "target_id").join(titled.select(F.col("id").alias("source_id"), "symbol", "doc_type", F.col("shown").alias("title")), "source_id")
    return rows.unionByName(incoming.select("target", "relationship_type", "symbol", "doc_type", "title"))


def search_titles(docs: DataFrame, words: str, doc_type: str | None = None, limit: int = 10, index: Postings | None = None) -> DataFrame:
    """F13. ``index``: of title."""
    if index is not None:
        docs = index.holding(docs, "id", "title", [words])
    found = optional(docs.filter(F.col("title").ilike(f"%{words}%")), None if doc_type is None else F.col("doc_type") == doc_type)
    return found.orderBy(F.desc_nulls_last("date"), "symbol").limit(limit).select("symbol", "doc_type", "title", "date")


def actor_vote(votes: DataFrame, actors: DataFrame, docs: DataFrame, name: str, symbol: str | None = None, index: Postings | None = None) -> DataFrame:
    """F14. ``index``: of the actors' name."""
    if index is not None:
        actors = index.holding(actors, "id", "name", [name])
    who = actors.filter(F.col("name").ilike(f"%{name}%")).select(F.col("id").alias("actor_id"), F.col("name").alias("actor"))
    v = votes.join(who, "actor_id").join(docs.select(F.col("id").alias("document_id"), "symbol"), "document_id")
    return optional(v, None if symbol is None else F.col("symbol") == symbol).select("actor", "symbol", "vote_type", "vote_context")


def drafts_to_resolutions(docs: DataFrame, edges: DataFrame, relation: str = "draft_of") -> DataFrame:
    """(draft, resolution)."""
    e = edges.filter(F.col("relationship_type") == relation)
    return e.join(docs.select(F.col("id").alias("source_id"), F.col("symbol").alias("draft")), "source_id").join(docs.select(F.col("id").alias("target_id"), F.col("symbol").alias("resolution")), "target_id").select("draft", "resolution")


def divergent_votes(votes: DataFrame, actors: DataFrame, docs: DataFrame, a: str, vote_a: str, b: str, vote_b: str) -> DataFrame:
    """F16: symbols of documents on which a voted one way and b the other; both sides are filtered before the join."""
    named = votes.join(actors.select(F.col("id").alias("actor_id"), "name"), "actor_id").filter("document_id is not null")
    side = lambda n, v: named.filter((F.col("name") == n) & (F.col("vote_type") == v)).select("document_id").distinct()
    both = side(a, vote_a).join(side(b, vote_b), "document_id")
    return both.join(docs.select(F.col("id").alias("document_id"), "symbol"), "document_id").select("symbol").distinct()


def utterances_by_agenda(utterances: DataFrame, docs: DataFrame, number: str) -> DataFrame:
    """F17."""
    u = utterances.filter(F.col("agenda_item_number") == number)
    return u.join(docs.select(F.col("id").alias("meeting_id"), F.col("symbol").alias("meeting")), "meeting_id").select("meeting", "position_in_meeting", "speaker_name", preview(F.col("text"), 500).alias("text"))


def documents_by_subject(docs: DataFrame, bridge: DataFrame, subjects: DataFrame, subject: str | None = None) -> DataFrame:
    """(symbol, doc_type, subject)."""
    s = optional(subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), None if subject is None else F.col("subject") == subject)
    return bridge.join(s, "subject_id").join(docs.select(F.col("id").alias("document_id"), "symbol", "doc_type"), "document_id").select("symbol", "doc_type", "subject")


def sponsors_of(docs: DataFrame, sponsorships: DataFrame, actors: DataFrame) -> DataFrame:
    """(symbol, actor, sponsorship_type)."""
    s = sponsorships.join(actors.select(F.col("id").alias("actor_id"), F.col("name").alias("actor")), "actor_id")
    return s.join(docs.select(F.col("id").alias("document_id"), "symbol"), "document_id").select("symbol", "actor", "sponsorship_type")


def meetings_of(docs: DataFrame, edges: DataFrame, relation: str = "meeting_record_for", types: tuple[str, ...] = ("meeting", "committee_meeting")) -> DataFrame:
    """(symbol, meeting)."""
    held = docs.filter(F.col("doc_type").isin(*types)).select(F.col("id").alias("source_id"), F.col("symbol").alias("meeting"))
    e = edges.filter(F.col("relationship_type") == relation).join(held, "source_id")
    return e.join(docs.select(F.col("id").alias("target_id"), "symbol"), "target_id").select("symbol", "meeting")
