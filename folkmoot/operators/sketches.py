"""Summaries of votes by session that merge over any range of sessions (inventory G5, G12), beside the exact queries.

A stored summary is read instead of the votes. Distinct voters come from HyperLogLog sketches, with a relative standard
error of about 1.04 / sqrt(2**lg_k): 1.6 % for the 12 bits set here. The most active voters come from the ``keep`` largest
counts of each session and, as ``floor``, the largest count left out; so a merged count has a lower and an upper bound,
which always hold, and which are equal for voters that every session keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LG_K = 12


def _of_sessions(votes: DataFrame, docs: DataFrame) -> DataFrame:
    return votes.join(docs.select(F.col("id").alias("document_id"), "session"), "document_id").filter("session is not null")


def voter_sketches(votes: DataFrame, docs: DataFrame) -> DataFrame:
    """(session, votes, voters): one row a session, voters as a sketch; votes without an actor count as votes alone."""
    return _of_sessions(votes, docs).groupBy("session").agg(F.count(F.lit(1)).alias("votes"), F.hll_sketch_agg("actor_id", F.lit(LG_K)).alias("voters"))


def voters_of(sketches: DataFrame) -> DataFrame:
    """(votes, voters) of all given sessions together: votes exact, voters estimated; one row, zeros for no session."""
    return sketches.agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("voters")), F.lit(0)).alias("voters"))


def voter_counts(votes: DataFrame, docs: DataFrame, keep: int = 1000) -> DataFrame:
    """(session, actor_id, n, floor): the most active voters of each session, ties by id."""
    each = _of_sessions(votes, docs).filter("actor_id is not null").groupBy("session", "actor_id").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("session").orderBy(F.desc("n"), "actor_id")
    some = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep + 1)
    left_out = F.coalesce(F.max(F.when(F.col("rank") > keep, F.col("n"))).over(Window.partitionBy("session")), F.lit(0))
    return some.withColumn("floor", left_out).filter(F.col("rank") <= keep).drop("rank")


def most_active(counts: DataFrame, k: int = 5) -> DataFrame:
    """(actor_id, at_least, at_most) of the k voters with the largest lower bounds over all given sessions, ties by id."""
    floors = counts.groupBy("session").agg(F.max("floor").alias("floor")).agg(F.sum("floor").alias("floors"))
    merged = counts.groupBy("actor_id").agg(F.sum("n").alias("at_least"), F.sum("floor").alias("own"))
    bounds = merged.join(F.broadcast(floors)).withColumn("at_most", F.expr("at_least + floors - own"))  # one row on the right
    return bounds.select("actor_id", "at_least", "at_most").orderBy(F.desc("at_least"), "actor_id").limit(k)
