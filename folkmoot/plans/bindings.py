"""The record tables as views over the test tables, for Spark and as SQL.

Orders stand for documents, suppliers for actors, line items for votes, conversations for speeches, events for steps of
trajectories; orders, customers, nations, regions and suppliers make the document graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "resolution").when(F.col("o_orderstatus") == "O", "draft").otherwise("meeting")
    symbol = F.concat(F.lit("A/C."), (F.col("o_custkey") % 6 + 1).cast("string"), F.lit("/"), (F.year("o_orderdate") - 1970).cast("string"), F.lit("/L."), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), symbol.alias("symbol"), kind.alias("doc_type"), F.year("o_orderdate").alias("session"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("custkey"))


def actors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("country").alias("actor_type"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "in_favour").when(F.col("l_returnflag") == "R", "against").otherwise("abstaining")
    context = F.when(F.col("l_linestatus") == "F", "plenary").otherwise("committee")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("actor_id"), F.lit(None).cast("long").alias("vote_event_id"), kind.alias("vote_type"), context.alias("vote_context"), "l_linenumber", "l_partkey")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the graph: orders, customers, nations, regions, suppliers, under prefixed ids."""
    docs = documents(spark, d).select(F.concat(F.lit("O"), F.col("id").cast("string")).alias("id"), "doc_type", "title", "date")
    parts = [("customer", "C", "c_custkey", "c_name", "committee_report"), ("nation", "N", "n_nationkey", "n_name", "meeting"), ("region", "R", "r_regionkey", "r_name", "agenda_item"), ("supplier", "S", "s_suppkey", "s_name", "actor")]
    for name, prefix, key, title, kind in parts:
        docs = docs.unionByName(table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("doc_type"), F.col(title).alias("title"), F.lit(None).cast("date").alias("date")))
    return docs.withColumn("symbol", F.col("id"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    parts = [("orders", "O", "o_orderkey", "C", "o_custkey", "draft_of"), ("customer", "C", "c_custkey", "N", "c_nationkey", "committee_report_for"), ("nation", "N", "n_nationkey", "R", "n_regionkey", "meeting_record_for"), ("supplier", "S", "s_suppkey", "N", "s_nationkey", "agenda_item_for")]
    out = None
    for name, p, key, q, target, kind in parts:
        e = table(spark, d, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("source_id"), F.concat(F.lit(q), F.col(target).cast("string")).alias("target_id"), F.lit(kind).alias("relationship_type"))
        out = e if out is None else out.unionByName(e)
    return out


def utterances(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("meeting_id"), F.col("role").alias("section_id"), F.col("turn").alias("position_in_meeting"), F.col("role").alias("speaker_name"), F.col("role").alias("speaker_affiliation"), "text", F.col("turn").cast("string").alias("agenda_item_number"), "conv_id")


def links(spark: SparkSession, d: str) -> DataFrame:
    """Speeches and the documents of the customer with the conversation's number."""
    kind = F.when(F.col("speaker_name") == "assistant", "voting_on").otherwise("mentioned")
    return utterances(spark, d).join(documents(spark, d).select(F.col("id").alias("document_id"), F.col("custkey").alias("conv_id")), "conv_id").select(F.col("id").alias("utterance_id"), "document_id", kind.alias("reference_type"))


def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("utterance_id", F.concat(F.lit("O"), F.col("document_id").cast("string")).alias("document_id"), "reference_type")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps: t by time within a user, yes/no/abstain from the event's number."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("trajectory_id"), "event_id", "ts", F.col("event_type").alias("stage"), "value", "props", k.alias("yes"), (F.col("event_id") % 7).cast("int").alias("no"), (F.col("event_id") % 3).cast("int").alias("abstain"))


DOCS = """(SELECT o_orderkey AS id, 'A/C.' || CAST(o_custkey % 6 + 1 AS VARCHAR) || '/' || CAST(year(o_orderdate) - 1970 AS VARCHAR) || '/L.' || CAST(o_orderkey AS VARCHAR) AS symbol,
  CASE o_orderstatus WHEN 'F' THEN 'resolution' WHEN 'O' THEN 'draft' ELSE 'meeting' END AS doc_type, CAST(year(o_orderdate) AS INTEGER) AS session, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS date, o_custkey AS custkey FROM orders)"""
ACTORS = "(SELECT s_suppkey AS id, s_name AS name FROM supplier)"
VOTES = """(SELECT l_orderkey AS document_id, l_suppkey AS actor_id, CASE l_returnflag WHEN 'A' THEN 'in_favour' WHEN 'R' THEN 'against' ELSE 'abstaining' END AS vote_type,
  CASE l_linestatus WHEN 'F' THEN 'plenary' ELSE 'committee' END AS vote_context, l_linenumber, l_partkey FROM lineitem)"""
NODES = f"""(SELECT 'O' || CAST(id AS VARCHAR) AS id, doc_type, title, date FROM {DOCS} UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'committee_report', c_name, NULL FROM customer
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'meeting', n_name, NULL FROM nation UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), 'agenda_item', r_name, NULL FROM region
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'actor', s_name, NULL FROM supplier)"""
EDGES = """(SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS source_id, 'C' || CAST(o_custkey AS VARCHAR) AS target_id, 'draft_of' AS relationship_type FROM orders
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'N' || CAST(c_nationkey AS VARCHAR), 'committee_report_for' FROM customer
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 'meeting_record_for' FROM nation
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), 'agenda_item_for' FROM supplier)"""
BOTH = f"(SELECT source_id AS node, target_id AS next, relationship_type FROM {EDGES} UNION ALL SELECT target_id, source_id, relationship_type FROM {EDGES})"
UTTERANCES = "(SELECT conv_id * 100000 + turn AS id, 'C' || CAST(conv_id AS VARCHAR) AS meeting_id, role AS section_id, turn AS position_in_meeting, role AS speaker_name, role AS speaker_affiliation, text, CAST(turn AS VARCHAR) AS agenda_item_number, conv_id FROM conversations)"
LINKS = f"(SELECT u.id AS utterance_id, d.id AS document_id, CASE WHEN u.speaker_name = 'assistant' THEN 'voting_on' ELSE 'mentioned' END AS reference_type FROM {UTTERANCES} u JOIN {DOCS} d ON u.conv_id = d.custkey)"
STEPS = "(SELECT user_id AS trajectory_id, event_id, ts, event_type AS stage, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS yes, CAST(event_id % 7 AS INTEGER) AS no, CAST(event_id % 3 AS INTEGER) AS abstain FROM events)"
