import pytest
from pyspark.sql import functions as F

from folkmoot.functions import text as x


def first(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first()["r"]


@pytest.fixture(autouse=True)
def value(spark):
    global v
    v = F.col("v")


def test_mentions(spark):
    df = spark.createDataFrame([(1, "see A/78/L.1 and A/78/L.1\nA/C.3/78/L.2  here"), (2, None), (3, "")], "id int, t string")
    rows = {(r.id, r.symbol, r.context) for r in x.mentions(df, "id", "t").collect()}
    assert rows == {(1, "A/78/L.1", "see A/78/L.1 and A/78/L.1"), (1, "A/C.3/78/L.2", "A/C.3/78/L.2 here")}


def test_cited(spark):
    assert first(spark, x.cited_decisions(v), "12. Title (decisions 78/528 A to D)") == ["78/528 A", "78/528 B", "78/528 C", "78/528 D"]
    assert first(spark, x.cited_decisions(v), "(decisions 78/504 A and B, 78/507 and 78/510 C)") == ["78/504 A", "78/504 B", "78/507", "78/510 C"]
    assert first(spark, x.cited_resolutions(v), "x (resolutions 78/1, 78/2 and 78/3)") == ["78/1", "78/2", "78/3"]
    assert first(spark, x.cited_resolutions(v), "none") == []


def test_states(spark):
    assert first(spark, x.split_states(v), "Albania, Micronesia (Federated States of), Iran (Islamic, Republic of), Peru 5/34 A/78/PV.50, Zambia.") == ["Albania", "Micronesia (Federated States of)", "Iran (Islamic, Republic of)", "Peru", "Zambia"]
    assert first(spark, x.split_states(v), "") == []


def test_vote_lists(spark):
    t = "A vote. In favour: Albania, Peru. Against: Chad Abstaining: Fiji, Iran Draft resolution I was adopted by 2 votes to 1."
    got = first(spark, x.vote_lists(v), t)
    assert got["in_favour"] == ["Albania", "Peru"] and got["against"] == ["Chad"] and got["abstaining"] == ["Fiji", "Iran"]
    assert first(spark, x.vote_lists(v), "no lists")["in_favour"] == []


def test_country_lists(spark):
    assert first(spark, x.country_list(v), "Albania, Peru and Fiji.") == ["Albania", "Peru", "Fiji"]
    assert sorted(first(spark, x.country_list(v, "space"), "Albania New Zealand United States of America Peru")) == ["Albania", "New Zealand", "Peru", "United States of America"]


def test_tagging_is_longest_first(spark):
    docs = spark.createDataFrame([(1, "Guinea and Papua New Guinea"), (2, "Papua New Guinea"), (3, None)], "id int, t string")
    names = spark.createDataFrame([("Guinea",), ("Papua New Guinea",)], "name string")
    rows = {(r.id, r.name) for r in x.tag_dictionary(docs, "id", "t", names, "name").collect()}
    assert rows == {(1, "Guinea"), (1, "Papua New Guinea"), (2, "Papua New Guinea")}


def test_segments(spark):
    t = "The General Assembly,\nRecalling its resolution,\nand more of it,\nNoting that,\n 1. Decides to act;\n (a) First;\n (b) Second;\n 2. Requests a report."
    rows = {(r.part, r.ordinal, r.sub): r.text for r in x.segment_text(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").collect()}
    assert rows[("preamble", 2, None)] == "Recalling its resolution, and more of it,"
    assert rows[("preamble", 3, None)] == "Noting that,"
    assert rows[("operative", 1, None)] == "1. Decides to act;"
    assert rows[("sub", 1, "b")] == "(b) Second;"
    assert rows[("operative", 2, None)] == "2. Requests a report."


def test_agenda(spark):
    t = "Plenary meetings\nA. Peace\n12. Question of peace\nand security (decision 78/507)\n(a) Reports\nThird Committee\n13. Rights (resolutions 78/1, 78/2)"
    rows = x.agenda_items(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").orderBy("item_no").collect()
    assert [r.type for r in rows] == ["committee_header", "section", "main", "sub", "committee_header", "main"]
    assert rows[2].text == "Question of peace and security (decision 78/507)" and rows[2].decisions == ["78/507"] and rows[2].committee == "Plenary"
    assert rows[3].item_number == 12 and rows[3].sub_item == "a" and rows[3].section_letter == "A"
    assert rows[5].committee == "Third Committee" and rows[5].resolutions == ["78/1", "78/2"]


def test_agenda_range(spark):
    got = first(spark, x.expand_agenda_range(v), "Agenda items 90 to 106")
    assert got["label"] == "90-106" and len(got["numbers"]) == 17
    assert tuple(first(spark, x.expand_agenda_range(v), "Agenda item 11 (continued)")) == ("11", ["11"])


MEETING = """Official record
The meeting was called to order at 10 a.m.
Agenda item 11 (continued)
The meeting was called to order at 10 a.m.
Question of peace
The President: We begin with A/78/L.5.
It is long.
Mr. Silva (Brazil): I thank you.
Agenda items 12 to 14
The Acting President: Next."""


def test_meetings(spark):
    df = spark.createDataFrame([("A/78/PV.1", MEETING)], "symbol string, t string")
    sections, said = x.parse_meetings(df, "symbol", "t")
    s = {r.section: r for r in sections.collect()}
    assert s[0].section_summary.startswith("Official record") and s[1].section_title == "Question of peace" and s[2].agenda.numbers == ["12", "13", "14"]
    u = {r.id: r for r in said.collect()}
    assert u["A/78/PV.1_section_1_utterance_1"].text == "We begin with A/78/L.5. It is long." and u["A/78/PV.1_section_1_utterance_1"].documents == ["A/78/L.5"]
    assert u["A/78/PV.1_section_1_utterance_2"].speaker.affiliation == "Brazil"
    assert u["A/78/PV.1_section_2_utterance_1"].speaker.role == "The Acting President"


def test_facts(spark):
    got = first(spark, x.utterance_facts(v), "Draft resolution III, entitled “Peace in our time”, was adopted by 91 votes to 54 (resolution 78/225). by a vote of 91 to 54, with 6 abstentions")
    assert got["draft_resolution_identifier"] == "III" and got["resolution_title"] == "Peace in our time" and got["resolution_symbol"] == "A/RES/78/225"
    assert got["adoption_status"] == "adopted" and (got["vote_in_favor"], got["vote_against"], got["vote_abstentions"]) == (91, 54, 6)
    got = first(spark, x.utterance_facts(v), "A vote on the oral amendment to A/78/L.9 is requested")
    assert got["procedural_type"] == "vote_on_oral_amendment" and got["draft_resolution_identifier"] == "A/78/L.9"
    assert first(spark, x.utterance_facts(v), "a motion for division")["procedural_type"] == "motion_for_division"
    assert first(spark, x.utterance_facts(v), "adopted without a vote")["vote_type"] == "without_vote"


def test_report_items(spark):
    t = 'Intro\nA. Draft resolution A/C.3/78/L.39\nIt was submitted by Chile, and entitled "Rights of all". Subsequently, Peru and Fiji joined in sponsoring the draft resolution. adopted by a recorded vote of 80 to 29, with 65 abstentions. In favour: Albania Against: Chad Abstaining: Fiji Before the vote (see para. 33, draft resolution I)\nB. Draft resolution A/C.3/78/L.40/Rev.1\nadopted without a vote'
    a, b = x.report_items(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").orderBy("item_no").collect()
    assert a.draft_symbol == "A/C.3/78/L.39" and (a.in_favor, a.against, a.abstentions) == (80, 29, 65) and a.title == "Rights of all" and (a.paragraph, a.draft_ordinal) == (33, "I")
    assert a.vote_details.abstaining == ["Fiji"]
    assert b.draft_revision == 1 and b.vote_info == "without a vote"
    items = spark.createDataFrame([(a.draft_symbol, a.item_text), (None, "about A/C.3/78/L.77, submitted by Mali.")], "draft_symbol string, item_text string")
    drafts = spark.createDataFrame([("A/C.3/78/L.39",), ("A/C.3/78/L.77",)], "draft_symbol string")
    got = {r.draft_symbol: r.sponsors for r in x.draft_sponsors(items, drafts).collect()}
    assert got["A/C.3/78/L.77"] == ["Mali"] and {"Fiji", "Peru"} <= set(got["A/C.3/78/L.39"])


def test_sponsors_in_headers(spark):
    assert first(spark, x.additional_sponsors(v), "Additional sponsors: Andorra, New Zealand and Palau (A/78/481/Add.3).") == ["Andorra", "New Zealand", "Palau"]
    assert first(spark, x.header_sponsors(v), "Agenda item 1\n\nAlbania, Chile,\nPeru and Fiji: draft resolution\nTitle") == ["Albania", "Chile", "Peru", "Fiji"]


def test_page_noise(spark):
    t = "A/C.3/78/L.41\nbody\n23-21227 (E) 131123\n*2321227*\n2/9 23-21227\n23-18952 3/4\n____________\nplease Recycle\nend"
    df = spark.createDataFrame([(1, 1, t), (1, 2, t)], "id int, page int, t string")
    rows = {r.page: r.text for r in x.strip_page_noise(df, "id", "page", "t").collect()}
    assert rows == {1: "A/C.3/78/L.41\nbody\nend", 2: "body\nend"}


def test_transcript(spark):
    df = spark.createDataFrame([(1, 2, "B", "two", "Peru", "pre"), (1, 1, "A", "one", None, "pre")], "m int, p int, n string, t string, a string, f string")
    got = x.meeting_transcript(df, "m", "p", "n", "t", "a", "f").first()["transcript"]
    assert got == "pre\n\n" + "=" * 80 + "\nA:\n\none\n\n" + "=" * 80 + "\nB (Peru):\n\ntwo"


def test_states_with_several_commas_in_parentheses(spark):
    t = spark.createDataFrame([("Iran (Islamic Republic of), A (b, c, d), Q (open, R.",)], "t string")
    assert t.select(x.split_states(F.col("t")).alias("r")).first()["r"] == ["Iran (Islamic Republic of)", "A (b, c, d)", "Q (open", "R."]


def test_cited_resolutions_keep_their_digits(spark):
    assert first(spark, x.cited_resolutions(F.col("v")), "(resolutions 78/0, 78/11 and 78/222)") == ["78/0", "78/11", "78/222"]


def test_split_states_cleans_each_name_once(spark):
    """In any place of a list, digits at a name's ends stay; white space, page marks, draft tails and the last stop go."""
    from folkmoot.functions.text import split_states

    texts = [" State 10,\n 1 State  11 ,State 2, State 3.", "A 12/16 A/78/PV.50 B, C Draft resolution II x. ,Mr. X.,  D  .", "Iran (Islamic, Republic of), , E", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.s for r in rows.select("id", split_states(F.col("t")).alias("s")).collect()}
    assert got == {0: ["State 10", "1 State 11", "State 2", "State 3"], 1: ["A B", "C", "Mr. X.", "D"], 2: ["Iran (Islamic, Republic of)", "E"], 3: [], 4: None}


def test_votes_of_a_speech_are_counted_once(spark):
    from folkmoot.plans import registry

    plan = registry.QUERIES["c13_utterance_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"by\s+a\s+recorded") <= 4  # whether it was, and three numbers
    assert first(spark, x.vote_lists(v), "In favour: Peru, Chile. Draft resolution II") == first(spark, x.vote_lists(v), "In favor: Peru, Chile. Draft resolution II")
    assert first(spark, x.vote_lists(v), None) == first(spark, x.vote_lists(v), "no list") and not any(first(spark, x.vote_lists(v), "no list"))
    got = first(spark, x.vote_counts(v), "by a recorded vote of 90 to 12")
    assert (got["type"], got["info"], got["yes"], got["no"], got["abstain"]) == ("recorded_vote", "90 to 12", 90, 12, None)
    assert first(spark, x.vote_counts(v), None)["type"] is None
