"""Traversal of the typed document graph (inventory F1 to F5), for many seeds at once.

Seeds are dealt into blocks of 64, and a level holds a row for each node of a block, with a bit for each seed that has
reached it. Every level is an equi-join of the frontier with the edges, whose bits are or-ed before and after the shuffle,
so neither paths nor seeds multiply its rows. A join with ``source = x OR target = x`` is written as both directions of
each edge. Levels that are read twice are written to the shared folder; seeds are told apart again at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folkmoot._store import kept
from folkmoot.functions.columns import relation_bucket
from folkmoot.operators.components import components


def both_ways(edges: DataFrame, loops: bool = False) -> DataFrame:
    """(node, next, relationship_type) in both directions, with loops on a node only where asked for."""
    ends = F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("next")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("next")))
    both = edges.select(F.explode(ends).alias("x"), "relationship_type").select("x.node", "x.next", "relationship_type")
    return both if loops else both.filter("node <> next")


def _dealt(seeds: DataFrame) -> DataFrame:
    """(seed, block, bit) of the distinct seeds, 64 a block."""
    place = F.monotonically_increasing_id()
    return kept(seeds.select("seed").distinct().withColumn("place", place).select("seed", F.expr("place div 64").alias("block"), (F.col("place") % 64).cast("int").alias("bit")), "seeds")


def _at_seeds(dealt: DataFrame) -> DataFrame:
    """Level 0: (block, node, reached)."""
    return dealt.groupBy("block", F.col("seed").alias("node")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("reached"))


def _merged(reached: DataFrame, *key: str) -> DataFrame:
    return reached.groupBy("block", *key).agg(F.bit_or("reached").alias("reached"))


def _followed(level: DataFrame, steps: DataFrame) -> DataFrame:
    return level.join(steps, "node").drop("node").withColumnRenamed("next", "node")


def _new(level: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """What a level adds for the seeds of each node to those seen before."""
    earlier = _merged(reduce(DataFrame.unionByName, [r.select("block", "node", "reached") for r in seen]), "node").withColumnRenamed("reached", "before")
    now = _merged(level, "node").join(earlier, ["block", "node"], "left")
    return now.select("block", "node", F.expr("reached & ~coalesce(before, 0L)").alias("reached")).filter("reached <> 0")


def _by_seed(reached: DataFrame, dealt: DataFrame) -> DataFrame:
    """A row for each seed, with its name for its bit."""
    told = reached.join(dealt, "block").filter(F.getbit("reached", "bit") == 1)
    return told.drop("reached", "block", "bit")


def related_documents(docs: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(seed, symbol, doc_type, relationship_type, bucket), distinct.

    The type is that of the last edge. The seed itself comes back when an edge leads to it, and so do nodes of earlier
    levels with another type; but only distinct rows are asked for, so a node whose edges were followed once for a seed
    is not followed again.
    """
    steps, dealt = kept(both_ways(edges), "steps"), _dealt(seeds)
    now, levels = _at_seeds(dealt), []
    followed = [now]
    for depth in range(max_depth):
        level = _followed(now, steps)
        if depth < max_depth - 1:
            level = kept(_merged(level, "node", "relationship_type"), "level")
            now = _new(level, followed)
            followed.append(level)
        levels.append(level)
    found = _merged(reduce(DataFrame.unionByName, levels), "node", "relationship_type")
    named = found.join(docs.select(F.col("id").alias("node"), "symbol", "doc_type"), "node")
    out = _by_seed(_merged(named, "symbol", "doc_type", "relationship_type"), dealt).select("seed", "symbol", "doc_type", "relationship_type")
    return out.withColumn("bucket", relation_bucket(F.col("relationship_type"), F.col("doc_type")))


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "both", max_rounds: int = 1000) -> DataFrame:
    """(seed, node) reached by any number of edges, the seed included.

    Both ways, that is the component of the seed, found by contraction. Forward, each round joins only the nodes that
    the last one found; rounds are written out, and end when none is new.
    """
    if direction == "both":
        members = components(edges, named=False)
        own = seeds.select("seed").distinct().join(members.select(F.col("node").alias("seed"), "component"), "seed", "left")
        reached = own.filter("component is not null").join(members, "component").select("seed", "node")
        return reached.unionByName(own.filter("component is null").select("seed", F.col("seed").alias("node")))
    steps, dealt = kept(edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct(), "steps"), _dealt(seeds)
    rounds = [kept(_at_seeds(dealt), "reached")]
    for _ in range(max_rounds):
        fresh = kept(_new(_followed(rounds[-1], steps), rounds), "reached")
        if fresh.isEmpty():
            return _by_seed(reduce(DataFrame.unionByName, rounds), dealt).select("seed", "node")
        rounds.append(fresh)
    raise RuntimeError("max_rounds reached")


def component_sizes(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, component, size) of every document: the smallest id that it is linked to by any number of edges, and how many
    documents are; one without edges is alone. A representative and its members, never all pairs of a component."""
    named = docs.select("id").join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return named.join(sizes, "component").select("id", "component", "size")


def document_chain(docs: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4, exclude: tuple[str, ...] = ("meeting", "committee_meeting")) -> DataFrame:
    """(seed, id, symbol, doc_type, depth), distinct; documents of excluded types, or of none, are never entered.

    A loop on a document leads to itself one level deeper. Every level is wanted, so a document is followed on each level
    that it is reached on.
    """
    open_ = docs.filter(~F.col("doc_type").isin(*exclude)).select(F.col("id").alias("next"))
    steps = kept(both_ways(edges, loops=True).select("node", "next").distinct().join(open_, "next", "left_semi"), "steps")
    dealt = _dealt(seeds)
    now = _at_seeds(dealt)
    levels = [now.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        now = _merged(_followed(now, steps), "node")
        if depth < max_depth:
            now = kept(now, "level")
        levels.append(now.withColumn("depth", F.lit(depth)))
    named = reduce(DataFrame.unionByName, levels).join(docs.select(F.col("id").alias("node"), "symbol", "doc_type"), "node")
    return _by_seed(named, dealt).select("seed", F.col("node").alias("id"), "symbol", "doc_type", "depth")


def chain_meetings(docs: DataFrame, edges: DataFrame, utterances: DataFrame, links: DataFrame, chain: DataFrame) -> DataFrame:
    """(seed, meeting_id) of documents of a meeting's type at the other end of a ``meeting_record_for`` edge, whichever
    end that is, and of documents of any type in whose speeches one of the chain is named."""
    members = chain.select("seed", F.col("id").alias("document_id")).distinct()
    records = both_ways(edges.filter("relationship_type = 'meeting_record_for'"), loops=True).select(F.col("node").alias("document_id"), F.col("next").alias("meeting_id")).distinct()
    meetings = docs.filter(F.col("doc_type").isin("meeting", "committee_meeting")).select(F.col("id").alias("meeting_id"))
    by_edge = members.join(records, "document_id").select("seed", "meeting_id").join(meetings, "meeting_id", "left_semi")
    spoken = links.select("utterance_id", "document_id").join(utterances.select(F.col("id").alias("utterance_id"), "meeting_id"), "utterance_id").select("document_id", "meeting_id").distinct()
    by_speech = members.join(spoken, "document_id").select("seed", "meeting_id").join(docs.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")
    return by_edge.unionByName(by_speech).distinct()


def chain_utterances(docs: DataFrame, utterances: DataFrame, links: DataFrame, chain: DataFrame, meetings: DataFrame, speakers: list[str] | None = None, limit: int = 100, full_text: bool = False) -> DataFrame:
    """per seed, one row for each speech of its meetings that has no link, and for each link of a speech into the
    chain, by date and position; ``truncated`` at the limit. Of texts the first 500 characters, unless all are asked for."""
    spoken = utterances
    if speakers:
        cond = F.lit(False)
        for s in speakers:
            cond = cond | F.col("speaker_affiliation").ilike(f"%{s}%")
        spoken = spoken.filter(cond)
    # Only what ranks a row goes through joins; what is shown of a speech is joined to the rows that stay.
    held = docs.select(F.col("id").alias("meeting_id"), F.col("symbol").alias("meeting_symbol"), "date")
    own = F.xxhash64("meeting_id", "position_in_meeting", "speaker_name", "speaker_affiliation", "agenda_item_number", "text")  # tells speeches of one id apart
    said = spoken.select(F.col("id").alias("utterance_id"), "meeting_id", "position_in_meeting", own.alias("own")).join(held, "meeting_id")
    linked = links.select("utterance_id", "document_id", "reference_type")
    silent = said.join(linked.select("utterance_id").filter("utterance_id is not null"), "utterance_id", "left_anti").join(meetings, "meeting_id")
    unnamed = said.join(linked.filter("document_id is null"), "utterance_id").join(meetings, "meeting_id").drop("document_id")
    members = chain.select("seed", F.col("id").alias("document_id"), F.col("symbol").alias("referenced")).distinct()
    named = said.join(linked, "utterance_id").join(members, "document_id").filter("referenced is not null").join(meetings, ["seed", "meeting_id"]).drop("document_id")
    rows = named.unionByName(silent.unionByName(unnamed, allowMissingColumns=True), allowMissingColumns=True)
    order = Window.partitionBy("seed").orderBy(F.asc_nulls_last("date"), "position_in_meeting", "utterance_id", F.asc_nulls_first("referenced"))
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    top = top.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy("seed")) >= limit)
    shown = utterances.select(F.col("id").alias("shown_id"), own.alias("shown_own"), "speaker_name", "speaker_affiliation", "agenda_item_number", F.col("text") if full_text else F.left(F.coalesce("text", F.lit("")), F.lit(500)).alias("text"))
    told = top.join(shown.dropDuplicates(["shown_id", "shown_own"]), F.col("own").eqNullSafe(F.col("shown_own")) & F.col("utterance_id").eqNullSafe(F.col("shown_id")))
    return told.select("seed", "rank", "meeting_symbol", "date", "utterance_id", "position_in_meeting", "speaker_name", "speaker_affiliation", F.col("agenda_item_number").alias("agenda_item"), "text", "referenced", "reference_type", "truncated")


def version_chains(drafts: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(base, versions, resolution): versions in order base, Add, Corr, Amend, Rev by number."""
    from folkmoot.functions.columns import version_parts

    order = F.coalesce(F.create_map(*[F.lit(x) for p in {"Add": 1, "Corr": 2, "Amend": 3, "Rev": 4}.items() for x in p])[F.col("v.kind")], F.lit(0))
    v = drafts.select("id", "symbol", version_parts(F.col("symbol")).alias("v"))
    grouped = v.groupBy(F.col("v.base").alias("base")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce("v.number", F.lit(0)).alias("n"), "symbol"))), lambda x: x["symbol"]).alias("versions"), F.collect_set("v.kind").alias("kinds")
    )
    out = edges.filter("relationship_type = 'draft_of'").select(F.col("source_id").alias("id"), F.col("target_id").alias("resolution_id"))
    adopted = v.join(out, "id").join(docs.select(F.col("id").alias("resolution_id"), F.col("symbol").alias("resolution")), "resolution_id").groupBy(F.col("v.base").alias("base")).agg(F.min("resolution").alias("resolution"))
    return grouped.join(adopted, "base", "left")


def version_stats(chains: DataFrame) -> DataFrame:
    """Totals of version chains."""
    n = F.size("versions")
    with_kind = [F.count_if(F.array_contains("kinds", k)).alias(f"with_{k.lower()}") for k in ("Rev", "Add", "Corr", "Amend")]
    return chains.agg(F.count(F.lit(1)).alias("total"), F.count_if(n > 1).alias("with_versions"), F.count_if(n <= 1).alias("single"), F.avg(n).alias("mean_versions"), *with_kind)
