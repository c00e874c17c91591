"""Aggregations, top-k and set differences (inventory 2.G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("in_favour", "against", "abstaining")


def vote_tallies(keys: DataFrame, votes: DataFrame, key: str) -> DataFrame:
    """G1: the rows of ``keys`` with their three counts, zero where none voted."""
    counts = votes.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(F.col("vote_type") == k).alias(k) for k in KINDS])
    return keys.join(counts, key, "left").fillna(0, list(KINDS))


def voters_by_type(votes: DataFrame, actors: DataFrame, key: str) -> DataFrame:
    """(key, vote_type, voters), sorted names without repeats."""
    named = votes.join(actors.select(F.col("id").alias("actor_id"), "name"), "actor_id")
    return named.groupBy(key, "vote_type").agg(F.array_sort(F.collect_set("name")).alias("voters"))


def vote_distribution(votes: DataFrame, docs: DataFrame) -> DataFrame:
    """(symbol, vote_type, n). Votes are counted by document before symbols are joined."""
    counts = votes.groupBy(F.col("document_id").alias("id"), "vote_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(docs.select("id", "symbol"), "id").select("symbol", "vote_type", "n")


def docs_per_session(docs: DataFrame) -> DataFrame:
    """G4."""
    return docs.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


def top_voters(votes: DataFrame, actors: DataFrame, k: int = 5) -> DataFrame:
    """Actors with the most votes, ties by name."""
    counts = votes.groupBy(F.col("actor_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(actors.select("id", "name"), "id").select("name", "n").orderBy(F.desc("n"), "name").limit(k)


def coverage_by_type(docs: DataFrame, text: str = "body_text") -> DataFrame:
    """Documents by type, and those with text."""
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col(text), F.lit("")) != "").alias("with_text"))


def text_coverage(docs: DataFrame, text: str = "body_text") -> DataFrame:
    """G7."""
    return docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col(text), F.lit("")) != "").alias("with_text"), F.round(F.avg(F.length(text)), 0).cast("long").alias("mean_length"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n)."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def missing_summary(missing: DataFrame, k: int = 10) -> DataFrame:
    """Of (type, symbol): total and distinct missing per type, and its k most common with counts, ties by symbol."""
    each = missing.groupBy("type", "symbol").agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("type").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_symbols"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "symbol"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).join(totals, "type").select("type", "total", "distinct_symbols", "rank", "symbol", "n")


def meeting_stats(utterances: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Per meeting: sections, speeches, speakers and, with links, documents spoken of."""
    stats = utterances.groupBy("meeting_id").agg(F.countDistinct("section_id").alias("section_count"), F.count(F.lit(1)).alias("utterance_count"), F.countDistinct("speaker_name").alias("unique_speakers"))
    if links is None:
        return stats
    docs = links.join(utterances.select(F.col("id").alias("utterance_id"), "meeting_id"), "utterance_id").groupBy("meeting_id").agg(F.countDistinct("document_id").alias("document_references"))
    return stats.join(docs, "meeting_id", "left").fillna(0, ["document_references"])


def mention_counts(links: DataFrame, docs: DataFrame) -> DataFrame:
    """G11."""
    return links.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("mentions")).join(docs.select("id", "symbol"), "id").select("symbol", "mentions")


def distinct_voters(votes: DataFrame, actors: DataFrame, vote_type: str, limit: int | None = None) -> DataFrame:
    """G12."""
    who = votes.filter(F.col("vote_type") == vote_type).select(F.col("actor_id").alias("id")).distinct().join(actors.select("id", "name"), "id").select("name")
    return who if limit is None else who.orderBy("name").limit(limit)


def event_vote_counts(events: DataFrame, votes: DataFrame) -> DataFrame:
    """Events with their number of votes, zero included."""
    counts = votes.filter("vote_event_id is not null").groupBy(F.col("vote_event_id").alias("id")).agg(F.count(F.lit(1)).alias("votes"))
    return events.select("id", "description").join(counts, "id", "left").fillna(0, ["votes"])


def parse_completeness(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per type, inputs, those without output (by stem), and whether none is missing."""
    keys = ["type", "stem"]
    have = outputs.select(*keys).distinct().withColumn("done", F.lit(True))
    joined = inputs.select(*keys).distinct().join(have, keys, "left")
    missing = F.count_if(F.col("done").isNull())
    return joined.groupBy("type").agg(F.count(F.lit(1)).alias("inputs"), missing.alias("missing"), (missing == 0).alias("complete"))


def sponsor_stats(trajectories: DataFrame, sponsors: str = "sponsor_count", outcome: str = "final_outcome") -> DataFrame:
    """Truncated mean and population deviation of sponsors, share adopted; 30, 10 and 0.5 where there is none.

    The count is null where a trajectory has no draft, and then out of the mean; a draft without sponsors counts 0. An
    outcome is read in any case of letters, and a missing one is adopted.
    """
    adopted = F.lower(F.coalesce(outcome, F.lit("adopted"))) == "adopted"
    return trajectories.agg(
        F.coalesce(F.avg(sponsors).cast("int"), F.lit(30)).alias("mean_sponsors"), F.coalesce(F.stddev_pop(sponsors).cast("int"), F.lit(10)).alias("std_sponsors"), F.coalesce(F.avg(adopted.cast("int")), F.lit(0.5)).alias("adoption_rate")
    )


def conversation_stats(turns: DataFrame, conv: str, kind: str, ts: str) -> DataFrame:
    """Conversations, turns by type, mean turns, first and last time; two levels of grouping."""
    each = turns.groupBy(conv).agg(F.count(F.lit(1)).alias("turns"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    totals = each.agg(F.count(F.lit(1)).alias("conversations"), F.avg("turns").alias("mean_turns"), F.min("first").alias("oldest"), F.max("last").alias("newest"))
    return totals.crossJoin(turns.groupBy(F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n")))  # one row on the left


def expire(turns: DataFrame, conv: str, ts: str, hours: float, now: Column) -> DataFrame:
    """Conversations idle for more than the given hours, with the time of their last turn."""
    last = turns.groupBy(conv).agg(F.max(ts).alias("last"))
    return last.filter(F.unix_timestamp("last") < F.unix_timestamp(now) - hours * 3600)


def conversation_sessions(turns: DataFrame, conv: str, ts: str, hours: float) -> DataFrame:
    """(conv, first, last, turns) of every stretch of a conversation without a pause of more than the given hours.

    Turns of one span of that length belong together, so they are added up before the shuffle: a conversation that holds
    most of all turns is a row a span. Turns without a time are in none; those without a conversation make up one.
    """
    gap = round(hours * 3_600_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    spans = turns.filter(F.col(ts).isNotNull()).groupBy(conv, (at - F.pmod(at, F.lit(gap))).alias("span"))
    spans = spans.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("turns"), F.min(at).alias("from"), F.max(at).alias("to"))
    order = Window.partitionBy(conv).orderBy("span")
    opens = F.coalesce(F.col("from") - F.lag("to").over(order) > gap, F.lit(True)).cast("int")
    told = spans.withColumn("opens", opens).withColumn("number", F.sum("opens").over(order))
    return told.groupBy(conv, "number").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("turns").alias("turns")).drop("number")


def top_voters_on(votes: DataFrame, actors: DataFrame, docs: DataFrame, keyword: str, vote_type: str, k: int = 10) -> DataFrame:
    """Actors that most often cast a vote on documents whose title holds a keyword."""
    about = docs.filter(F.col("title").ilike(f"%{keyword}%")).select(F.col("id").alias("document_id"))
    counts = votes.filter(F.col("vote_type") == vote_type).join(about, "document_id", "left_semi").groupBy(F.col("actor_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(actors.select("id", "name"), "id").select("name", "n").orderBy(F.desc("n"), "name").limit(k)


def record_stats(items: DataFrame, key: str) -> DataFrame:
    """Of agenda items with arrays of resolutions and decisions: items, items with references, and totals."""
    r, d = F.coalesce(F.size("resolutions"), F.lit(0)), F.coalesce(F.size("decisions"), F.lit(0))
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("items"), F.count_if(r + d > 0).alias("items_with_references"), F.sum(r).alias("total_resolutions"), F.sum(d).alias("total_decisions"))
