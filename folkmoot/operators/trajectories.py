"""Genealogies, trajectories and their completeness (inventory J1 to J16, J31), for all records in one job.

A record here has: symbol, kind, title, related_documents{drafts, committee_reports, meeting_records: [text, url]},
agenda[id, agenda_symbol, item_number, sub_item], text (introduction or body), voting{vote_type, yes, no, abstain}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot._store import kept
from folkmoot.functions.columns import access_url, agenda_label, final_outcome, normalize_symbol, preview, record_id
from folkmoot.functions.text import SUMMARY_RECORD, first_mentions
from folkmoot.operators.postings import Postings
from folkmoot.operators.sequences import number_timesteps

# Kinds of reference, the stage of each, and the order of stages in a trajectory.
KINDS = {"drafts": "draft", "committee_reports": "committee_report", "meeting_records": "meeting"}
STAGES = ["agenda_allocation", "draft_submission", "committee_deliberation", "committee_vote", "plenary_procedural_vote", "plenary_discussion", "plenary_vote"]


def references(records: DataFrame) -> DataFrame:
    """(symbol, type, ref_symbol, url, pos) of every reference of every record, agenda items included, once each and as its
    first mention in a list has it. All lists go through one pass over the records."""
    kind = lambda field, name, text, url: F.transform(F.col(field), lambda r, i: F.struct(F.lit(name).alias("type"), i.alias("pos"), r[text].alias("text"), url(r).alias("url")))
    lists = [kind(f"related_documents.{field}", name, "text", lambda r: r["url"]) for field, name in KINDS.items()]
    lists.append(kind("agenda", "agenda_item", "agenda_symbol", lambda r: F.lit(None).cast("string")))
    empty = F.array().cast("array<struct<type:string,pos:int,text:string,url:string>>")
    every = records.select("symbol", F.explode(F.concat(*[F.coalesce(x, empty) for x in lists])).alias("r"))
    named = every.select("symbol", "r.type", normalize_symbol(F.col("r.text"), "index").alias("ref_symbol"), "r.url", "r.pos").filter("ref_symbol <> ''")
    return named.groupBy("symbol", "type", "ref_symbol").agg(F.min_by("url", F.struct("pos", F.col("url").isNull(), "url")).alias("url"), F.min("pos").alias("pos"))


def document_index(records: DataFrame, symbol: str = "symbol", path: str = "path") -> DataFrame:
    """A2: (symbol_norm, path, kind). The page root counts first, its last file wins; other roots add symbols, and
    replace one only by a ``*_parsed.json`` file. A record without a symbol is named by its file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(_parsed)?\.[a-z]+$", "")
    norm = normalize_symbol(F.coalesce(F.nullif(F.trim(symbol), F.lit("")), F.replace(stem, F.lit("_"), F.lit("/"))), "index")
    parsed = F.col(path).endswith("_parsed.json") & (F.col("root") > 0)
    rows = records.withColumns({"symbol_norm": norm, "precedence": F.when(parsed, 2).when(F.col("root") == 0, 1).otherwise(0)})
    # Parsed files: the latest root and file wins; pages: the last file; other files: the first.
    order = [F.desc("precedence"), F.when(F.col("precedence") > 0, F.col("root")).desc_nulls_last(), F.when(F.col("precedence") > 0, F.col(path)).desc_nulls_last(), "root", path]
    rank = F.row_number().over(Window.partitionBy("symbol_norm").orderBy(*order))
    return rows.withColumn("n", rank).filter("n = 1").select("symbol_norm", path, "kind")


def trace_backwards(records: DataFrame, index: DataFrame) -> DataFrame:
    """(symbol, type, ref_symbol, path, found, pos) of each record's sources."""
    r = references(records).select("symbol", "type", "ref_symbol", "pos")
    return r.join(index.select(F.col("symbol_norm").alias("ref_symbol"), "path"), "ref_symbol", "left").select("symbol", "type", "ref_symbol", "path", F.col("path").isNotNull().alias("found"), "pos")


def committee_deliberations(traces: DataFrame, reports: DataFrame, index: DataFrame) -> DataFrame:
    """(symbol, report, record, found): summary records named in the introduction of each found report."""
    own = traces.filter("type = 'committee_report' and found").select("symbol", F.col("ref_symbol").alias("report"))
    told = reports.select(normalize_symbol(F.col("symbol"), "index").alias("report"), F.explode(first_mentions(F.col("introduction"), SUMMARY_RECORD)).alias("record"))
    hits = own.join(told, "report").join(index.select(F.col("symbol_norm").alias("record"), "path"), "record", "left")
    return hits.select("symbol", "report", "record", F.col("path").isNotNull().alias("found"))


def trace_forwards(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(agenda_symbol, label, symbol, kind): records whose agenda names a target, with its item where one is given."""
    named = records.select("symbol", "kind", F.explode("agenda").alias("a")).select("symbol", "kind", normalize_symbol(F.col("a.agenda_symbol"), "index").alias("agenda_symbol"), agenda_label(F.col("a.item_number"), F.col("a.sub_item")).alias("item"))
    t = targets.select(normalize_symbol(F.col("agenda_symbol"), "index").alias("agenda_symbol"), "label")
    hits = named.join(t, "agenda_symbol").filter(F.col("label").isNull() | (F.col("label") == F.col("item")))
    return hits.select("agenda_symbol", "label", "symbol", "kind").distinct()


def trace_draft(records: DataFrame, index: DataFrame) -> DataFrame:
    """(draft, type, ref_symbol, found): a draft's agenda items, and resolutions and reports that refer to it."""
    r = kept(references(records), "references")  # read for both directions
    drafts = records.filter("kind = 'drafts'").select(normalize_symbol(F.col("symbol"), "index").alias("draft"))
    back = r.filter("type = 'agenda_item'").withColumn("draft", normalize_symbol(F.col("symbol"), "index")).join(drafts, "draft", "left_semi").select("draft", "type", "ref_symbol")
    by = records.select("symbol", "kind")
    ahead = r.filter("type = 'draft'").join(by, "symbol").select(F.col("ref_symbol").alias("draft"), F.when(F.col("kind") == "committee-reports", "committee_report").otherwise("resolution").alias("type"), F.col("symbol").alias("ref_symbol"))
    both = back.unionByName(ahead.join(drafts, "draft", "left_semi")).distinct()
    return both.join(index.select(F.col("symbol_norm").alias("ref_symbol"), "path"), "ref_symbol", "left").select("draft", "type", "ref_symbol", F.col("path").isNotNull().alias("found"))


def trace_mode(symbol: Column) -> Column:
    """J5."""
    return F.when(symbol.contains("/RES/"), "backwards").when(symbol.contains("/L."), "draft").otherwise("forwards")


def genealogy_graph(traces: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). A node is found if every mention of it is; titles are cut to 80 characters."""
    mentions = kept(traces.select("symbol", "type", "ref_symbol", "found"), "mentions")
    own = mentions.select(F.col("symbol").alias("id"), F.lit("resolution").alias("type"), F.lit(True).alias("found"))
    others = mentions.select(F.col("ref_symbol").alias("id"), "type", "found")
    # A row an id and type first: that is a hash table, while the least of strings is a sort of what is left.
    named = own.unionByName(others).groupBy("id", "type").agg(F.bool_and("found").alias("found"))
    nodes = named.groupBy("id").agg(F.bool_and("found").alias("found"), F.min("type").alias("type"))
    shown = titles.select(normalize_symbol(F.col("symbol"), "index").alias("id"), preview(F.col("title"), 80, "fit").alias("title")).groupBy("id").agg(F.min("title").alias("title"))
    edges = mentions.select(F.col("ref_symbol").alias("source"), F.col("symbol").alias("target"), F.col("type").alias("relation")).distinct()
    return nodes.join(shown, "id", "left"), edges


def report_sponsors(drafts: DataFrame, reports: DataFrame, items: DataFrame) -> DataFrame:
    """(trajectory_id, draft, sponsors): sorted names that the trajectory's reports give for a draft, taken from the
    first item of each report that is the draft's own or names it in its text.

    drafts and reports: (trajectory_id, draft) and (trajectory_id, report); items: (report, item_no, draft_symbol,
    item_text, sponsors).
    """
    held = drafts.join(reports, "trajectory_id").join(items, "report")
    own = held.filter((F.col("draft_symbol") == F.col("draft")) | F.contains("item_text", "draft"))
    first = own.groupBy("trajectory_id", "draft", "report").agg(F.min_by("sponsors", "item_no").alias("sponsors"))
    return first.groupBy("trajectory_id", "draft").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sponsors")))).alias("sponsors"))


def build_trajectories(traces: DataFrame, records: DataFrame, deliberations: DataFrame, items: DataFrame, speeches: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """(trajectory_id, t, stage, date, action_type, actor, source, sponsors, yes, no, abstain, outcome, n_statements,
    final_outcome), for all records of ``traces`` (J1) at once.

    Steps come stage by stage, those of the plenary meeting by meeting, never by date. Documents that are not found give
    no step. records: symbol, date, agenda, voting, and action_note, which goes before the date of a meeting. deliberations:
    J2. items: those of committee reports, (report, item_no, draft_symbol, item_text, sponsors, in_favour, against,
    abstaining, adoption_status). speeches of meetings and summary records: (meeting, utterance_id, position, text,
    resolution_symbol, vote_details{in_favour, against, abstaining}, events[draft_id, event_type, adoption_status]).

    * a draft's sponsors come from the reports of its trajectory; the first of them submits it
    * a summary record, and a meeting, gives a step of statements if a speech in it is relevant (J8)
    * a report votes on the first of its items that is about a draft of the trajectory
    * an event of a meeting is a procedural vote if its draft id is part of a draft's symbol (J9)
    * the plenary vote is what the last speech about the record's own symbol lists
    """
    size = lambda a: F.coalesce(F.array_size(a), F.lit(0))
    traces = kept(traces.select("symbol", "type", "ref_symbol", "found", "pos"), "traces")  # all stages read them
    ids = traces.select(F.col("symbol").alias("trajectory_id"), "type", "ref_symbol", "found", "pos")
    has_note = F.coalesce("action_note", F.col("date").cast("string")) if "action_note" in records.columns else F.col("date").cast("string")
    info = records.select(normalize_symbol(F.col("symbol"), "index").alias("ref_symbol"), F.col("date").cast("string").alias("date"), has_note.alias("note")).dropDuplicates(["ref_symbol"])
    found = ids.filter("found").join(info, "ref_symbol", "left")
    drafts = ids.filter("type = 'draft'").select("trajectory_id", F.col("ref_symbol").alias("draft"))

    def step(df: DataFrame, stage: str, action: Column, **cols: Column) -> DataFrame:
        known = {"date": F.lit(None).cast("string"), "place": F.lit(0), "within": F.lit(0), **cols}
        return df.select("trajectory_id", F.lit(stage).alias("stage"), F.col("source"), action.alias("action_type"), *[v.alias(k) for k, v in known.items()])

    entries = records.select(F.col("symbol").alias("trajectory_id"), F.posexplode("agenda").alias("place", "a")).select("trajectory_id", "place", normalize_symbol(F.col("a.agenda_symbol"), "index").alias("ref_symbol"))
    listed = entries.join(found.filter("type = 'agenda_item'").select("trajectory_id", "ref_symbol", "date"), ["trajectory_id", "ref_symbol"]).withColumn("source", F.col("ref_symbol"))
    agenda = step(listed, "agenda_allocation", F.lit("allocate_to_committee"), date=F.col("date"), actor=F.lit("General Assembly"), place=F.col("place"))

    reports = found.filter("type = 'committee_report'").select("trajectory_id", F.col("ref_symbol").alias("report"), "date", "pos")
    named = report_sponsors(drafts, reports.select("trajectory_id", "report"), items).withColumnRenamed("draft", "ref_symbol")
    sent = found.filter("type = 'draft'").join(named, ["trajectory_id", "ref_symbol"], "left").withColumn("source", F.col("ref_symbol"))
    sponsors = F.coalesce("sponsors", F.array().cast("array<string>"))
    submitted = step(sent, "draft_submission", F.lit("submit_draft"), date=F.col("date"), place=F.col("pos"), sponsors=sponsors, actor=F.coalesce(F.try_element_at(sponsors, F.lit(1)), F.lit("Unknown")))

    summaries = deliberations.filter("found").groupBy(F.col("symbol").alias("trajectory_id"), F.col("record").alias("meeting")).agg(F.min("report").alias("report"))
    summaries = summaries.join(info.select(F.col("ref_symbol").alias("meeting"), "date"), "meeting", "left")
    meetings = found.filter("type = 'meeting'").select("trajectory_id", F.col("ref_symbol").alias("meeting"), F.col("note").alias("date"), "pos")
    both = summaries.select("trajectory_id", "meeting").unionByName(meetings.select("trajectory_id", "meeting")).distinct()
    talk = relevant_utterances(speeches.select("meeting", "utterance_id", "text"), both.join(drafts.groupBy("trajectory_id").agg(F.collect_set("draft").alias("drafts")), "trajectory_id", "left"), keywords or [])
    many = F.lit("Multiple delegations")
    debated = step(summaries.join(talk, ["trajectory_id", "meeting"]).withColumn("source", F.col("meeting")), "committee_deliberation", F.lit("statements"), date=F.col("date"), actor=many, n_statements=F.col("statements"))

    about = reports.join(items.select("report", "item_no", F.col("draft_symbol").alias("draft"), "in_favour", "against", "abstaining", "adoption_status"), "report").join(drafts, ["trajectory_id", "draft"])
    lists = F.struct("in_favour", "against", "abstaining", "adoption_status")
    first = about.groupBy("trajectory_id", "report", "date", "pos").agg(F.min_by(lists, "item_no").alias("v")).withColumn("source", F.col("report"))
    voted = step(first, "committee_vote", F.lit("recorded_vote"), date=F.col("date"), place=F.col("pos"), yes=size(F.col("v.in_favour")), no=size(F.col("v.against")), abstain=size(F.col("v.abstaining")), outcome=F.col("v.adoption_status"))

    happened = speeches.select("meeting", "position", F.posexplode("events").alias("n", "e")).join(meetings, "meeting").join(drafts, "trajectory_id").filter(F.contains("draft", "e.draft_id"))
    motions = happened.select("trajectory_id", "meeting", "date", "pos", "position", "n", "e").dropDuplicates(["trajectory_id", "meeting", "position", "n"]).withColumn("source", F.col("meeting"))
    motions = step(motions, "plenary_procedural_vote", F.col("e.event_type"), date=F.col("date"), actor=F.lit("General Assembly"), outcome=F.col("e.adoption_status"), place=F.col("pos"), within=F.col("position") * 1000 + F.col("n"))
    discussed = step(meetings.join(talk, ["trajectory_id", "meeting"]).withColumn("source", F.col("meeting")), "plenary_discussion", F.lit("statements"), date=F.col("date"), actor=many, place=F.col("pos"), n_statements=F.col("statements"))
    told = meetings.join(speeches.select("meeting", "position", F.col("resolution_symbol").alias("trajectory_id"), "vote_details"), ["meeting", "trajectory_id"])
    last = told.groupBy("trajectory_id", "meeting", "date", "pos").agg(F.max_by("vote_details", "position").alias("v")).filter("v is not null").withColumn("source", F.col("meeting"))
    yes, no = size(F.col("v.in_favour")), size(F.col("v.against"))
    decided = step(last, "plenary_vote", F.lit("recorded_vote"), date=F.col("date"), actor=F.lit("General Assembly Members"), place=F.col("pos"), yes=yes, no=no, abstain=size(F.col("v.abstaining")), outcome=F.when(yes > no, "adopted").otherwise("rejected"))

    steps = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [agenda, submitted, debated, voted, motions, discussed, decided])
    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    plenary = F.col("stage").startswith("plenary")
    steps = kept(steps.withColumns({"part": F.when(plenary, 5).otherwise(stage), "after": stage}), "steps")  # read twice to number them
    outcome = records.select(F.col("symbol").alias("trajectory_id"), final_outcome(F.col("voting.yes"), F.col("voting.no"), F.col("voting").isNotNull()).alias("final_outcome")).dropDuplicates(["trajectory_id"])
    return number_timesteps(steps, "trajectory_id", "part", "place", "source", "after", "within").join(outcome, "trajectory_id", "left").drop("part", "place", "after", "within")


def relevant_utterances(utterances: DataFrame, held: DataFrame, keywords: list[str], index: Postings | None = None) -> DataFrame:
    """(trajectory_id, meeting, statements): speeches in a trajectory's meetings that name one of its drafts or hold a
    keyword, in any case of letters. held: (trajectory_id, meeting, drafts), one row a pair; the join is on the meeting.
    With an ``index`` of the texts by utterance_id, drafts and keywords are looked up instead of tried on every speech."""
    if index is None:
        said = utterances.join(held, "meeting")
        text = F.lower("text")
        hit = F.coalesce(F.exists("drafts", lambda d: F.contains(text, F.lower(d))), F.lit(False))
        for k in keywords:
            hit = hit | F.coalesce(text.contains(k.lower()), F.lit(False))
        return said.filter(hit).groupBy("trajectory_id", "meeting").agg(F.countDistinct("utterance_id").alias("statements"))
    words = utterances.sparkSession.createDataFrame([(k,) for k in keywords], "pattern string")
    drafts = held.select("trajectory_id", "meeting", F.explode("drafts").alias("pattern"))
    hits = kept(index.matches(utterances, "utterance_id", "text", drafts.select("pattern").unionByName(words), literal=True), "hits")
    said = hits.join(utterances.select(F.col("utterance_id").alias("key"), "meeting"), "key")
    # A keyword counts for all trajectories of a meeting, so its speeches are counted once a meeting, not once a trajectory.
    by_word = kept(said.join(F.broadcast(words), "pattern", "left_semi").select("meeting", "key").distinct(), "by-word")
    by_draft = said.join(drafts, ["meeting", "pattern"]).select("trajectory_id", "meeting", "key").distinct().join(by_word, ["meeting", "key"], "left_anti")
    spoken = by_word.groupBy("meeting").agg(F.count(F.lit(1)).alias("n")).join(held.select("trajectory_id", "meeting").distinct(), "meeting").select("trajectory_id", "meeting", "n")
    named = by_draft.groupBy("trajectory_id", "meeting").agg(F.count(F.lit(1)).alias("n"))
    return spoken.unionByName(named).groupBy("trajectory_id", "meeting").agg(F.sum("n").alias("statements"))


def country_actions(votes: DataFrame, sponsors: DataFrame) -> DataFrame:
    """(trajectory_id, t, country, action): votes as ``voted_<position>``, the first sponsor submits, all sponsor."""
    v = votes.select("trajectory_id", "t", "country", F.concat(F.lit("voted_"), "vote_type").alias("action"))
    s = sponsors.select("trajectory_id", "t", F.posexplode("sponsors").alias("n", "country"))
    first = s.filter("n = 0").select("trajectory_id", "t", "country", F.lit("submit_draft").alias("action"))
    return v.unionByName(first).unionByName(s.select("trajectory_id", "t", "country", F.lit("co_sponsor").alias("action")))


def vote_shift(steps: DataFrame, key: str = "trajectory_id", stage: str = "stage", first: str = "committee_vote", last: str = "plenary_vote") -> DataFrame:
    """Change of yes, no and abstain from the last committee vote to the last plenary vote."""
    tally = F.struct("yes", "no", "abstain")
    at = lambda s: F.max_by(tally, F.when(F.col(stage) == s, F.col("t")))
    both = steps.filter(F.col(stage).isin(first, last)).groupBy(key).agg(at(first).alias("a"), at(last).alias("b")).filter("a is not null and b is not null")
    return both.select(key, *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"{c}_shift") for c in ("yes", "no", "abstain")])


def availability(stages: DataFrame, key: str, *fields: str) -> DataFrame:
    """Which fields each stage has."""
    return stages.select(key, *[F.col(f).isNotNull().alias(f"has_{f}") for f in fields])


def reference_qa(expected: DataFrame, found: DataFrame, key: str, kind: str, ref: str) -> DataFrame:
    """Per key: expected and found references, sorted missing ones, and whether it is complete."""
    have = found.select(F.col(ref)).distinct().withColumn("ok", F.lit(True))
    rows = expected.select(key, kind, ref).distinct().join(have, ref, "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col(ref))))
    out = rows.groupBy(key, kind).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("ok").isNotNull()).alias("found"), missing.alias("missing"))
    return out.withColumn("status", F.when(F.size("missing") == 0, "complete").otherwise("incomplete"))


def trajectory_qa(records: DataFrame, index: DataFrame, wanted: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """J13 on records: (symbol, status, error, expected, found, missing, lost[type, ref_symbol]), one row a record.

    A record is complete if nothing that it refers to is missing, whatever the type, so one without references is, too.
    ``wanted`` (symbol) asks for certain records; one of them that is not among the records is an error. ``refs`` are the
    references of the records, where they are at hand.
    """
    have = index.select(F.col("symbol_norm").alias("ref_symbol")).distinct().withColumn("ok", F.lit(True))
    rows = (references(records) if refs is None else refs).join(have, "ref_symbol", "left")
    lost = F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.struct("type", "ref_symbol"))))
    per = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("expected"), F.count_if("ok").alias("found"), lost.alias("lost"))
    every = records.select("symbol").distinct().withColumn("known", F.lit(True))
    if wanted is not None:
        every = wanted.select("symbol").distinct().join(every, "symbol", "left")
    out = every.join(per, "symbol", "left")
    missing = F.coalesce(F.array_size("lost"), F.lit(0))
    status = F.when(F.col("known").isNull(), "error").when(missing == 0, "complete").otherwise("incomplete")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("symbol", status.alias("status"), F.when(F.col("known").isNull(), "not found").alias("error"), zero("expected"), zero("found"), missing.alias("missing"), F.coalesce("lost", F.array().cast("array<struct<type:string,ref_symbol:string>>")).alias("lost"))


def qa_summary(qa: DataFrame, accept: float = 0.9) -> DataFrame:
    """Records by status, totals of references, the share of complete ones; accepted from a share of 0.9."""
    rate = F.coalesce(F.count_if(F.col("status") == "complete") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    by = [F.count_if(F.col("status") == s).alias(n) for n, s in (("complete", "complete"), ("incomplete", "incomplete"), ("errors", "error"))]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return qa.agg(F.count(F.lit(1)).alias("total"), *by, total("expected"), total("found"), F.round(rate, 4).alias("rate"), (rate >= accept).alias("accepted"))


def missing_by_type(qa: DataFrame) -> DataFrame:
    """(type, missing) over incomplete records."""
    return qa.filter("status = 'incomplete'").select(F.explode("lost").alias("x")).groupBy("x.type").agg(F.count(F.lit(1)).alias("missing"))


def missing_with_url(qa: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol, type, url, record_id) of each missing document, as its first referrer gives it; agenda items too."""
    lost = qa.select("symbol", F.explode("lost").alias("x")).select("symbol", "x.type", "x.ref_symbol")
    with_url = lost.join(refs.select("symbol", "type", "ref_symbol", "url"), ["symbol", "type", "ref_symbol"], "left")
    first = with_url.groupBy("ref_symbol", "type").agg(F.min_by("url", F.struct(F.col("url").isNull(), "symbol")).alias("url"))
    return first.select(F.col("ref_symbol").alias("symbol"), "type", F.coalesce("url", access_url(F.col("ref_symbol"))).alias("url"), record_id(F.col("url")).alias("record_id"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows by a hash of key and seed; the same rows every time."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary")), key).limit(n)


def stage_summary(traces: DataFrame, records: DataFrame, statements: DataFrame) -> DataFrame:
    """(trajectory_id, stage, symbol, date, title, yes, no, abstain, statements) for any set of trajectories."""
    r = records.select(normalize_symbol(F.col("symbol"), "index").alias("ref_symbol"), "date", "title", "voting")
    own = traces.select("symbol").distinct().select(F.col("symbol").alias("trajectory_id"), F.lit("resolution").alias("stage"), F.col("symbol").alias("ref_symbol"))
    parts = traces.select(F.col("symbol").alias("trajectory_id"), F.col("type").alias("stage"), "ref_symbol")
    rows = own.unionByName(parts).join(r, "ref_symbol", "left").join(statements.select("trajectory_id", F.col("meeting").alias("ref_symbol"), "statements"), ["trajectory_id", "ref_symbol"], "left")
    return rows.select("trajectory_id", "stage", F.col("ref_symbol").alias("symbol"), "date", "title", "voting.yes", "voting.no", "voting.abstain", F.coalesce("statements", F.lit(0)).alias("statements"))
