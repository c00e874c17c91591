"""Merges by bucket, and links that are resolved when speeches are loaded again."""

import os

from folkmoot.operators import keyed, tables

DOC = "id long, symbol string, doc_type string, title string, date date, session int, body_text string, doc_metadata string"


def files(path):
    """Data files with their times."""
    base = path.removeprefix("file://")
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_what_it_changes(spark, tmp_path):
    old = spark.createDataFrame([(k, f"A/{k}", "draft", None if k % 3 else f"t{k}", None, 78, None, "{}") for k in range(400)], DOC)
    table = keyed.KeyedTable.create(old, f"file://{tmp_path}/docs", ["symbol"], 32)
    new = spark.createDataFrame([(None, f"A/{k}", "draft", f"new {k}", None, 78, "text", None) for k in (1, 2, 1000)], DOC)
    fill = lambda a, b: tables.merge_documents(a, b, "fill", keep_resolutions=True)
    before = files(table.path)
    changed = table.merge(new, fill)
    after = files(table.path)
    assert 1 <= len(changed) <= 3 and {f.split("bucket=")[1].split("/")[0] for f in set(before.items()) ^ set(after.items()) for f in [f[0]]} == {str(k) for k in changed}
    got = sorted(map(str, table.rows().select(old.columns).collect()))
    assert got == sorted(map(str, fill(old, new).select(old.columns).collect())) and len(got) == 401
    assert table.merge(new, fill) == [] and files(table.path) == after  # the same load again changes no file
    assert table.merge(new.limit(0), fill) == [] and files(table.path) == after
    longer = spark.createDataFrame([("A/1", "a longer text"), ("A/5", "")], "symbol string, body_text string")
    assert len(table.merge(longer, tables.refresh_body)) == 1 and table.rows().filter("symbol = 'A/1'").first().body_text == "a longer text"


def test_reloaded_speeches(spark, tmp_path):
    said = "id long, meeting_id string, position_in_meeting int, text string, documents array<struct<symbol:string,context:string>>, voting_on array<string>"
    first = spark.createDataFrame([(1, "M", 1, "on A/1 and A/2", [("A/1", "c"), ("A/2", None)], ["A/3"]), (2, "M", 2, "none", None, None)], said)
    docs = spark.createDataFrame([(10, "A/1", "resolution"), (30, "A/3", "draft")], "id long, symbol string, doc_type string")
    no_links = spark.createDataFrame([], "utterance_id long, document_id long, reference_type string, context string")
    no_edges = spark.createDataFrame([], "source_id string, target_id long, relationship_type string")
    u, links, edges = tables.reload_utterances(first.drop("documents", "voting_on").limit(0), first, no_links, docs, no_edges)
    assert {(r.utterance_id, r.document_id, r.reference_type) for r in links.collect()} == {(1, 10, "mentioned"), (1, 30, "voting_on")}
    again = spark.createDataFrame([(99, "M", 1, "changed", [("A/1", "other"), ("A/2", None)], ["A/3", "A/1"]), (3, "M", 3, "new, on A/2", [("A/2", "d")], None)], said)
    more = docs.unionByName(spark.createDataFrame([(20, "A/2", "resolution")], docs.schema))
    u2, links2, edges2 = tables.reload_utterances(u, again, links, more, edges)
    assert {(r.id, r.text) for r in u2.collect()} == {(1, "on A/1 and A/2"), (2, "none"), (3, "new, on A/2")}  # a known speech stays
    assert {(r.utterance_id, r.document_id, r.context) for r in links2.collect()} == {(1, 10, "c"), (1, 30, None), (1, 20, None), (3, 20, "d")}  # A/2 can be linked now
    assert {r.target_id for r in edges2.collect()} == {10, 20, 30} and edges2.count() == 3
    third = tables.reload_utterances(u2, again, links2, more, edges2)
    for a, b in zip(third, (u2, links2, edges2)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    table = keyed.KeyedTable.create(u, f"file://{tmp_path}/said", ["meeting_id"], 8)
    assert len(table.merge(again.drop("documents", "voting_on"), tables.upsert_utterances)) == 1 and table.rows().count() == 3
    assert table.merge(again.drop("documents", "voting_on"), tables.upsert_utterances) == []
