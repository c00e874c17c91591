"""Building the conformed tables from parsed records (inventory 2.E): dimensions, facts and bridges as set operations.

Ids are 64-bit hashes of natural keys, so tables can be built apart and again with equal results, without one global
numbering. Bridges are joined after all documents exist, so the order of loading does not matter.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from folkmoot._store import kept
from folkmoot.functions.columns import extracted, normalize_symbol
from folkmoot.functions.text import SYMBOL, additional_sponsors, tag_dictionary


def key_id(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def build_actors(names: DataFrame, existing: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(id, name, actor_type) of names not yet among the existing actors, by exact name after optional aliases."""
    n = names.select(F.trim("name").alias("name")).filter("name <> ''")
    if aliases is not None:
        n = n.join(aliases, n["name"] == aliases["alias"], "left").select(F.coalesce(aliases["canonical"], n["name"]).alias("name"))
    n = n.distinct()
    if existing is not None:
        n = n.join(existing.select("name"), "name", "left_anti")
    return n.select(key_id(F.col("name")).alias("id"), "name", F.lit("country").alias("actor_type"))


def build_subjects(docs: DataFrame, subjects: str = "subjects") -> tuple[DataFrame, DataFrame]:
    """(subjects, document_subjects): names trimmed and in upper case, empty ones dropped, pairs unique."""
    pairs = docs.select(F.col("id").alias("document_id"), F.explode(subjects).alias("s")).select("document_id", F.upper(F.trim("s")).alias("name")).filter("name <> ''").distinct()
    bridge = pairs.select("document_id", key_id(F.col("name")).alias("subject_id"))
    return pairs.select(key_id(F.col("name")).alias("id"), "name").distinct(), bridge


def merge_documents(existing: DataFrame, incoming: DataFrame, policy: str = "fill", keep_resolutions: bool = False) -> DataFrame:
    """By symbol. ``fill`` sets what is missing; ``overwrite`` replaces title, body and metadata where they come.

    The type is taken from the incoming row, unless ``keep_resolutions`` finds an existing resolution.
    """
    cols = ["title", "date", "session", "body_text", "doc_metadata"]
    e, i = existing.alias("e"), incoming.alias("i")
    joined = e.join(i, F.col("e.symbol") == F.col("i.symbol"), "full_outer")

    def pick(c: str) -> Column:
        old, new = F.col(f"e.{c}"), F.col(f"i.{c}")
        text = c not in ("date", "session")
        if text:
            old, new = F.nullif(old, F.lit("")), F.nullif(new, F.lit(""))
        return F.coalesce(new, old) if policy == "overwrite" and text else F.coalesce(old, new)

    kind = F.coalesce(F.col("i.doc_type"), F.col("e.doc_type"))
    if keep_resolutions:
        kind = F.when(F.col("e.doc_type") == "resolution", "resolution").otherwise(kind)
    symbol = F.coalesce(F.col("e.symbol"), F.col("i.symbol"))
    return joined.select(F.coalesce(F.col("e.id"), key_id(symbol)).alias("id"), symbol.alias("symbol"), kind.alias("doc_type"), *[pick(c).alias(c) for c in cols])


def placeholders(docs: DataFrame, referenced: DataFrame) -> DataFrame:
    """Documents that are referred to but not loaded, by (symbol, doc_type)."""
    new = referenced.filter("symbol <> ''").groupBy("symbol").agg(F.min("doc_type").alias("doc_type")).join(docs.select("symbol"), "symbol", "left_anti")
    return new.select(key_id(F.col("symbol")).alias("id"), "symbol", "doc_type")


def refresh_body(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The body is replaced where it is missing or shorter than a new one; of several, the longest."""
    best = incoming.groupBy("symbol").agg(F.max_by("body_text", F.struct(F.length("body_text"), "body_text")).alias("new_text"))
    rows = existing.join(best, "symbol", "left")
    longer = F.col("new_text").isNotNull() & (F.length("new_text") > F.coalesce(F.length("body_text"), F.lit(0)))
    return rows.withColumn("body_text", F.when(longer, F.col("new_text")).otherwise(F.col("body_text"))).drop("new_text")


def standalone(a: DataFrame, b: DataFrame, key: str = "symbol") -> DataFrame:
    """E5: rows of a whose key b lacks."""
    return a.join(b.select(key), key, "left_anti")


REFERENCES = {"drafts": "draft_of", "committee_reports": "committee_report_for", "meeting_records": "meeting_record_for"}


def build_relationships(records: DataFrame, docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges (id, source_id, target_id, relationship_type) of records (symbol, related_documents, agenda)."""
    # All lists go through one pass over the records.
    edge = lambda source, kind: F.struct(source.alias("source"), F.lit(kind).alias("relationship_type"))
    named = lambda field, kind: F.transform(field, lambda r: edge(normalize_symbol(r["text"]), kind))
    lists = [named(f"related_documents.{field}", kind) for field, kind in REFERENCES.items()]
    lists.append(F.transform("agenda", lambda a: edge(F.coalesce(a["id"], a["agenda_symbol"]), "agenda_item_for")))
    none = F.array().cast("array<struct<source:string,relationship_type:string>>")
    edges = records.select(F.col("symbol").alias("target"), F.explode(F.concat(*[F.coalesce(x, none) for x in lists])).alias("e")).select("target", "e.source", "e.relationship_type")
    ids = docs.select("id", "symbol")
    out = edges.distinct().join(ids.select(F.col("id").alias("source_id"), F.col("symbol").alias("source")), "source").join(ids.select(F.col("id").alias("target_id"), F.col("symbol").alias("target")), "target")
    out = out.select("source_id", "target_id", "relationship_type").distinct()
    if existing is not None:
        out = out.join(existing, ["source_id", "target_id", "relationship_type"], "left_anti")
    return out.select(key_id(F.col("source_id"), F.col("target_id"), F.col("relationship_type")).alias("id"), "*")


def _long(lists: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("vote_type"), lists[k].alias("names")) for k in ("in_favour", "against", "abstaining")]))


def votes_from_records(records: DataFrame, docs: DataFrame, actors: DataFrame, context: str = "plenary") -> DataFrame:
    """Votes of records (symbol, vote_lists), a repeated name as often as it is listed; tallies that are numbers stay on
    the record and make no rows."""
    v = records.select("symbol", _long(F.col("vote_lists")).alias("v")).select("symbol", "v.vote_type", F.explode("v.names").alias("name")).filter("trim(name) <> ''")
    named = v.join(docs.select(F.col("id").alias("document_id"), "symbol"), "symbol").join(actors.select(F.col("id").alias("actor_id"), "name"), "name")
    return named.select("document_id", "actor_id", F.lit(None).cast("long").alias("vote_event_id"), "vote_type", F.lit(context).alias("vote_context"))


VOTE_KEY = ["actor_id", "vote_type", "document_id", "vote_event_id"]


def votes_from_meetings(votes: DataFrame, actors: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Votes (name, vote_type, document_id, vote_event_id), blanks skipped, once each, and not those that exist."""
    v = votes.withColumn("name", F.trim("name")).filter("name <> ''").join(actors.select(F.col("id").alias("actor_id"), "name"), "name").select(*VOTE_KEY).distinct()
    if existing is not None:
        old = existing.select(*VOTE_KEY).distinct()
        v = v.join(old, reduce(and_, [v[c].eqNullSafe(old[c]) for c in VOTE_KEY]), "left_anti")
    return v.withColumn("vote_context", F.lit("plenary"))


def build_vote_events(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Events (meeting_id, utterance_id, session, draft, resolution_symbol, ...) with their target by a ladder.

    A draft id with a slash is a full symbol, and one that begins with ``L.<number>`` belongs to ``A/<session>/``; neither
    is tried as the other. Where that finds no document, the resolution's symbol is tried.
    """
    draft = F.col("draft")
    named = F.when(draft.contains("/"), normalize_symbol(draft)).when(draft.rlike(r"^L\.\d+"), F.concat(F.lit("A/"), F.col("session").cast("string"), F.lit("/"), draft))
    rungs = {"by_draft": named, "by_resolution": normalize_symbol(F.col("resolution_symbol"))}
    e = events.withColumns(rungs)
    for k in rungs:
        e = e.join(docs.select(F.col("symbol").alias(k), F.col("id").alias(f"{k}_id")), k, "left")
    target = F.coalesce("by_draft_id", "by_resolution_id")
    return e.select(key_id(F.col("utterance_id"), F.col("event_type"), F.col("draft")).alias("id"), "meeting_id", "utterance_id", target.alias("target_document_id"), "event_type", "description", "result")


def build_utterances(said: DataFrame, actors: DataFrame) -> DataFrame:
    """Speeches with text; the actor comes from the affiliation only; facts and tags become one JSON column."""
    u = said.filter("trim(coalesce(text, '')) <> ''").join(actors.select(F.col("id").alias("speaker_actor_id"), F.col("name").alias("speaker_affiliation")), "speaker_affiliation", "left")
    meta = F.to_json(F.struct(*[c for c in ("facts", "tags") if c in said.columns])) if {"facts", "tags"} & set(said.columns) else F.lit(None).cast("string")
    return u.withColumn("id", key_id(F.col("meeting_id"), F.col("position_in_meeting"))).withColumn("utterance_metadata", meta).drop("facts", "tags")


def link_utterances(utterances: DataFrame, docs: DataFrame) -> DataFrame:
    """(utterance_id, document_id, reference_type, context) of speeches with ``documents`` (symbol, context),
    and ``voting_on`` symbols. A blank symbol is read from its context; a pair is linked once, mentions first; only
    documents that exist are linked, and symbols are not rewritten."""
    symbol = F.coalesce(F.nullif(F.trim("d.symbol"), F.lit("")), extracted(F.col("d.context"), f"({SYMBOL})"))
    said = utterances.select(F.col("id").alias("utterance_id"), F.explode("documents").alias("d")).select("utterance_id", normalize_symbol(symbol).alias("symbol"), F.lit("mentioned").alias("reference_type"), "d.context", F.lit(1).alias("rank"))
    voted = utterances.select(F.col("id").alias("utterance_id"), F.explode("voting_on").alias("s")).select("utterance_id", normalize_symbol(F.col("s")).alias("symbol"), F.lit("voting_on").alias("reference_type"), F.lit(None).cast("string").alias("context"), F.lit(2).alias("rank"))
    links = said.unionByName(voted).join(docs.select(F.col("id").alias("document_id"), "symbol"), "symbol")
    first = F.min(F.struct("rank", "reference_type", "context"))
    return links.groupBy("utterance_id", "document_id").agg(first.alias("f")).select("utterance_id", "document_id", "f.reference_type", "f.context")


def meeting_edges(links: DataFrame, utterances: DataFrame, docs: DataFrame, existing: DataFrame | None = None, types: tuple[str, ...] = ("resolution", "draft")) -> DataFrame:
    """``meeting_record_for`` edges from meetings to documents spoken of; backfill adds committee reports to types."""
    targets = docs.filter(F.col("doc_type").isin(*types)).select(F.col("id").alias("document_id"))
    pairs = links.join(targets, "document_id", "left_semi").join(utterances.select(F.col("id").alias("utterance_id"), "meeting_id"), "utterance_id")
    edges = pairs.select(F.col("meeting_id").alias("source_id"), F.col("document_id").alias("target_id"), F.lit("meeting_record_for").alias("relationship_type")).distinct()
    return edges if existing is None else edges.join(existing, ["source_id", "target_id", "relationship_type"], "left_anti")


def build_sponsorships(docs: DataFrame, actors: DataFrame) -> DataFrame:
    """``initial`` from authors, ``additional`` from notes where the pair has none; of (id, authors, notes)."""
    initial = tag_dictionary(docs.select("id", F.array_join("authors", "; ").alias("t")), "id", "t", actors, "name").withColumn("rank", F.lit(1))
    extra = docs.select("id", F.array_join(additional_sponsors(F.col("notes")), ", ").alias("t")).filter("t is not null")
    extra = tag_dictionary(extra, "id", "t", actors, "name").withColumn("rank", F.lit(2))
    best = initial.unionByName(extra).groupBy("id", "name").agg(F.min("rank").alias("rank"))
    kind = F.when(F.col("rank") == 1, "initial").otherwise("additional")
    return best.join(actors.select(F.col("id").alias("actor_id"), "name"), "name").select(F.col("id").alias("document_id"), "actor_id", kind.alias("sponsorship_type"))


def upsert_utterances(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing speeches stay; new ones come by (meeting_id, position_in_meeting)."""
    key = ["meeting_id", "position_in_meeting"]
    return existing.unionByName(incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti").select(existing.columns))


def reload_utterances(existing: DataFrame, incoming: DataFrame, links: DataFrame, docs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E14 in full: (utterances, links, edges) after speeches come again.

    Speeches are told by (meeting_id, position_in_meeting); those that exist stay as they are. The references of every
    incoming speech, known or new, are resolved again: a document that has come since is linked now, a pair that is linked
    keeps its link, and meetings get their edges to what is linked. incoming: also ``documents`` and ``voting_on`` (E11).
    """
    key = ["meeting_id", "position_in_meeting"]
    fresh = incoming.dropDuplicates(key)
    after = upsert_utterances(existing, fresh.drop("documents", "voting_on"))
    said = fresh.select(*key, "documents", "voting_on").join(after.select("id", *key), key)
    found = link_utterances(said, docs)
    new = found.join(links.select("utterance_id", "document_id"), ["utterance_id", "document_id"], "left_anti")
    whole = links.unionByName(new.select(links.columns))
    kept_edges = edges.select("source_id", "target_id", "relationship_type")
    return after, whole, kept_edges.unionByName(meeting_edges(whole, after, docs, kept_edges))


CHILDREN = {"votes": ["document_id", "vote_event_id"], "document_relationships": ["source_id", "target_id"], "utterances": ["meeting_id"], "utterance_documents": ["document_id", "utterance_id"], "document_subjects": ["document_id"], "sponsorships": ["document_id"]}


BROADCAST_IDS = 100_000  # ids that go to every task
IDS_A_TASK = 500_000  # ids that one task holds beyond that


def _ids(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Ids written to the shared folder, and how many they are; ``apart`` is 0 for all, see ``_against``."""
    ids = kept(rows.select(F.col(column).alias("gone"), F.lit(0).cast("long").alias("apart")).filter("gone is not null"), "gone")
    return ids, ids.count()


def _against(df: DataFrame, column: str, ids: tuple[DataFrame, int], how: str) -> DataFrame:
    """Rows joined to ids. Few ids are broadcast; more are dealt into tasks that hold a bounded number of them and let the
    rows pass, so rows are not sorted and a task's memory does not grow with them. Rows without an id meet none, so they are
    dealt by their hash, not to one task."""
    gone, n = ids
    if n <= BROADCAST_IDS:
        return df.join(F.broadcast(gone.drop("apart")), df[column] == gone["gone"], how)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // IDS_A_TASK))
    dealt = gone.repartition(tasks, "gone", "apart").hint("shuffle_hash")
    apart = F.when(F.col(column).isNull(), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])).otherwise(F.lit(0).cast("long"))
    rows = df.withColumn("_apart", apart)
    return rows.join(dealt, (rows[column] == dealt["gone"]) & (rows["_apart"] == dealt["apart"]), how).drop("_apart", "apart")


def purge_documents(tables: dict[str, DataFrame], symbols: DataFrame) -> dict[str, DataFrame]:
    """Documents by symbol leave with their children; targets of vote events become null."""
    docs = tables["documents"]
    gone = _ids(_against(docs, "symbol", _ids(symbols, "symbol"), "left_semi"), "id")
    out = {**tables, "documents": _against(docs, "id", gone, "left_anti")}
    lost = dead = None
    if "utterances" in tables:
        lost = _ids(_against(tables["utterances"], "meeting_id", gone, "left_semi"), "id")
    if "vote_events" in tables:
        events = _against(tables["vote_events"], "meeting_id", gone, "left_anti")
        marked = _against(_against(events, "utterance_id", lost, "left_anti") if lost else events, "target_document_id", gone, "left")
        out["vote_events"] = marked.withColumn("target_document_id", F.when(F.col("gone").isNull(), F.col("target_document_id"))).drop("gone")
        if "votes" in tables:
            with_meeting = _against(tables["vote_events"], "meeting_id", gone, "left_semi").select("id")
            with_speech = [_against(events, "utterance_id", lost, "left_semi").select("id")] if lost else []
            dead = _ids(reduce(DataFrame.unionByName, with_speech, with_meeting), "id")
    for name, columns in CHILDREN.items():
        if name in tables:
            for c in columns:
                ids = lost if c == "utterance_id" else dead if c == "vote_event_id" else gone
                out[name] = out[name] if ids is None else _against(out[name], c, ids, "left_anti")
    return out


def load_status(corrupt: str = "_corrupt", symbol: str = "symbol") -> Column:
    """What becomes of a record: errors (it could not be read), skipped (it has no symbol), or loaded."""
    return F.when(F.col(corrupt).isNotNull(), "errors").when(F.coalesce(F.trim(symbol), F.lit("")) == "", "skipped").otherwise("loaded")


def load_stats(records: DataFrame, corrupt: str = "_corrupt", symbol: str = "symbol") -> DataFrame:
    """(status, n): records that could not be read, had no symbol, or were loaded."""
    return records.groupBy(load_status(corrupt, symbol).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def load_observed(records: DataFrame, path: str, corrupt: str = "_corrupt", symbol: str = "symbol") -> dict[str, int]:
    """E16 in the pass that loads: records go to ``status=loaded``, ``status=skipped`` and ``status=errors`` below the path, and
    the numbers of each, 0 for none, are observed on that write, so the input is read once and rejects can be looked up."""
    told, seen = records.withColumn("status", load_status(corrupt, symbol)), Observation("load")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("loaded", "skipped", "errors")]
    told.observe(seen, *counts).write.mode("overwrite").partitionBy("status").parquet(path)
    return seen.get
