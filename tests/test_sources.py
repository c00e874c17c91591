import json

from pyspark.sql import functions as F

from folkmoot.operators.tables import load_stats
from folkmoot.sources import readers, writers
from folkmoot.streaming.incremental import stream_utterances

MARC = """<collection><record><controlfield tag="001">42</controlfield>
<datafield tag="191" ind1=" " ind2=" "><subfield code="a">A/RES/78/1</subfield></datafield>
<datafield tag="245" ind1=" " ind2=" "><subfield code="a">Title</subfield><subfield code="b">part two</subfield></datafield>
<datafield tag="269" ind1=" " ind2=" "><subfield code="a">2023-10-16</subfield></datafield>
<datafield tag="650" ind1=" " ind2=" "><subfield code="a">PEACE</subfield></datafield><datafield tag="650" ind1=" " ind2=" "><subfield code="a">RIGHTS</subfield></datafield>
<datafield tag="856" ind1=" " ind2=" "><subfield code="y">English</subfield><subfield code="s">123</subfield><subfield code="u">http://x/en.pdf</subfield></datafield>
<datafield tag="996" ind1=" " ind2=" "><subfield code="b">91</subfield><subfield code="c">54</subfield><subfield code="d">6</subfield></datafield>
<datafield tag="967" ind1=" " ind2=" "><subfield code="e">ALBANIA</subfield><subfield code="d">Y</subfield></datafield>
<datafield tag="967" ind1=" " ind2=" "><subfield code="e">CHAD</subfield></datafield></record></collection>"""


def test_catalogue_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(MARC)
    r = readers.read_marc_records(spark, str(tmp_path)).first()
    assert r.record_id == "42" and r.symbol == "A/RES/78/1" and r.title == "Title part two" and r.subjects == ["PEACE", "RIGHTS"] and r.files[0].size == 123
    votes = readers.read_marc_votes(spark, str(tmp_path))
    v = votes.first()
    assert v.symbol == "vote_42" and (v.counts.yes, v.counts.no, v.counts.abstain, v.counts.total) == (91, 54, 6, 0)
    assert {(x.country, x.vote) for x in readers.explode_roll_call(votes).collect()} == {("ALBANIA", "Y"), ("CHAD", "X")}


def test_parsed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"symbol": "A/78/L.1"}, "draft_text": "x"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {}, "draft_text": "y"}))
    df = readers.read_parsed(spark, str(tmp_path), "drafts")
    assert {r.status: r.n for r in load_stats(df).collect()} == {"loaded": 1, "errors": 1, "skipped": 1}


def test_pages(spark):
    html = '<title>T</title><a href="/x.pdf">Français</a> <a href="http://y/z-es.pdf">file</a><a href="q">q</a>'
    links = readers.page_links(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"), "https://lib.org/")
    assert [(r.pos, r.url) for r in links.orderBy("pos").collect()] == [(0, "https://lib.org/x.pdf"), (1, "http://y/z-es.pdf"), (2, "https://lib.org/q")]
    assert {(r.language, r.url) for r in readers.file_links(links).collect()} == {("FR", "https://lib.org/x.pdf"), ("ES", "http://y/z-es.pdf")}


def test_tables_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    writers.write_tables({"actors": df}, str(tmp_path))
    assert readers.register_tables(spark, str(tmp_path), ["actors"])["actors"].count() == 2
    assert spark.sql("select count(*) n from actors").first()["n"] == 2
    writers.write_csv(df, str(tmp_path / "csv"), 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    writers.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_mermaid(spark):
    nodes = spark.createDataFrame([("A/78/1", 'a "b"'), ("78/2", None)], "id string, title string")
    edges = spark.createDataFrame([("A/78/1", "78/2", "draft"), ("A/78/1", "gone", "x")], "source string, target string, relation string")
    lines = [r.line for r in writers.graph_mermaid_lines(nodes, edges).orderBy("ord").collect()]
    assert lines == ["graph LR", '    n_78_2["78/2"]', "    A_78_1[\"a 'b'\"]", "    A_78_1 -->|draft| n_78_2"]


def test_stream_upsert(spark, tmp_path):
    schema = spark.createDataFrame([], "meeting_id long, position_in_meeting int, text string").schema
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    for n, rows in enumerate([[(1, 1, "a"), (1, 2, "b")], [(1, 2, "again"), (1, 3, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        stream_utterances(spark, src, schema, out, chk).awaitTermination()
    got = {(r.position_in_meeting, r.text) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "c")}


def test_bodies(spark):
    from folkmoot.functions.columns import body_text

    df = spark.createDataFrame([(("p", "o"), ("",), None, "")], "text_segments struct<preamble:string,operative:string>, raw_text struct<full_text:string>, introduction string, draft_text string").select(F.struct("*").alias("r"))
    assert df.select(body_text(F.col("r"), "resolutions").alias("b")).first()["b"] == "p\n\no"


def test_load_observed_on_the_write(spark, tmp_path):
    from folkmoot.operators.tables import load_observed

    rows = [(None, "A/1", "x"), (None, " ", "y"), (None, None, "z"), ("{", "A/2", None), (None, "A/3", "")]
    df = spark.createDataFrame(rows, "_corrupt string, symbol string, text string")
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    once = df.mapInPandas(counted, df.schema)
    assert load_observed(once, str(tmp_path / "a")) == {"loaded": 2, "skipped": 2, "errors": 1} and reads.value == 5
    got = {(r.status, r.symbol) for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert got == {("loaded", "A/1"), ("loaded", "A/3"), ("skipped", " "), ("skipped", None), ("errors", "A/2")}
    assert load_observed(df.limit(0), str(tmp_path / "b")) == {"loaded": 0, "skipped": 0, "errors": 0}


def test_a_catalogue_takes_no_more_disk_than_its_tables(spark):
    """Plain XML took about twenty times as much as the Parquet files of orders and lines that it is made of."""
    from pathlib import Path

    from folkmoot.plans import registry

    d = "/root/testdata/sf0.001"
    path = registry.write_catalogue(spark, d)
    files = [f for f in Path(path.removeprefix("file://")).iterdir() if f.name.startswith("part-")]
    assert sum(f.stat().st_size for f in files) < sum(Path(d, f"{t}.parquet").stat().st_size for t in ("orders", "lineitem"))
    calls = readers.explode_roll_call(readers.read_marc_votes(spark, path))
    told = {r.vote: r["count"] for r in calls.groupBy("vote").count().collect()}
    lines = {r.l_returnflag: r["count"] for r in spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").count().collect()}
    assert told == {"Y": lines["A"], "N": lines["R"], "X": lines["N"]}
