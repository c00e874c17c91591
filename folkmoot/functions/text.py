"""Row-expanding text operators (inventory 2.C): one row to many, with regular expressions, explode and windows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.functions.columns import bound, collapse_ws, extracted, parse_speaker
from folkmoot.functions.automaton import SHARD_NAMES, tagged_by_shards
from folkmoot.operators.scans import SEGMENT_ROWS, running

# Fixed values of the record format: patterns, markers, starters and names.
SYMBOL = r"\b[A-Z]/[\dA-Z.]+(?:/\s*[A-Za-z0-9.\-]+)+\b"
SUMMARY_RECORD = r"A/C\.\d+/\d+/SR\.\d+"
ORDINAL = r"(?i)draft\s+resolution\s+(I{1,3}|IV|V|VI{0,3}|[1-9]\d*)"
AGENDA_LINE = r"(?i)^\s*Agenda items?\s+(\d+[A-Za-z]*)(?:(?:\s+(?:to|-)\s+|\s*-\s*)(\d+[A-Za-z]*))?\s*(\([^)]+\))?(.*)$"
SPEAKER_LINE = r"(?i)((?:The\s+(?:Acting\s+)?President|The\s+Vice-President|The\s+Secretary-General|Mr\.|Ms\.|Mrs\.|Dr\.|Sir|Madam|Ambassador|H\.E\.)[^\n:]{0,120})\s*:\s*(.*)"
NOT_TITLES = ["the meeting was called to order", "statement by", "letter dated", "in the absence of"]
PREAMBLE_STARTERS = [
    "The General Assembly", "Guided", "Recalling", "Welcoming", "Recognizing", "Noting", "Reaffirming", "Bearing in mind", "Mindful", "Acknowledging",
    "Emphasizing", "Convinced", "Concerned", "Aware", "Deeply concerned", "Gravely concerned", "Alarmed", "Appreciating", "Deploring", "Desirous",
    "Determined", "Expressing", "Having considered", "Having examined", "Observing", "Reiterating", "Stressing", "Taking into account", "Taking note",
    "Underlining", "Affirming", "Believing", "Considering", "Desiring",
]
MULTI_WORD_COUNTRIES = [
    "United Kingdom of Great Britain and Northern Ireland", "United States of America", "Micronesia (Federated States of)", "Netherlands (Kingdom of the)",
    "Bosnia and Herzegovina", "Saint Vincent and the Grenadines", "Sao Tome and Principe", "Trinidad and Tobago", "Republic of Moldova",
    "Dominican Republic", "Democratic Republic of the Congo", "Central African Republic", "Czech Republic", "Republic of Korea",
    "Democratic People's Republic of Korea", "Lao People's Democratic Republic", "United Republic of Tanzania", "United Arab Emirates", "New Zealand",
    "Papua New Guinea", "Sierra Leone", "Sri Lanka", "Costa Rica", "Puerto Rico", "Saudi Arabia", "South Africa", "El Salvador", "Equatorial Guinea",
    "Antigua and Barbuda", "Burkina Faso", "Cape Verde", "North Macedonia", "San Marino",
]
FOOTERS = [r"^\d{2}-\d{5}\s*\([A-Z]\)\s*\d{6}$", r"^\*\d{7}\*$", r"^\d+/\d+\s+\d{2}-\d{5}$", r"^\d{2}-\d{5}\s+\d+/\d+$", r"^_{10,}$", r"(?i)please recycle"]
PAGE_HEADER = r"^A/(?:C\.\d+/)?(?:RES/)?\d+/[A-Z0-9.]+$"
COMMITTEE_LINE = r"(?i)^(Plenary|First Committee|Second Committee|Third Committee|Fourth Committee|Fifth Committee|Sixth Committee|Special Political and Decolonization Committee)(?: meetings)?"
VOTE_MARKS = {"in_favour": ["In favour:", "In favor:"], "against": ["Against:"], "abstaining": ["Abstaining:", "Abstentions:"]}
VOTE_ENDS = {
    "meeting": {
        "in_favour": r"Against:|Abstaining:|Abstentions:|Draft resolution|was adopted",
        "against": r"Abstaining:|Abstentions:|Draft resolution|was adopted",
        "abstaining": r"Draft resolution|was adopted|(?i:by\s+\d+\s+votes|resolution\s+\d+/\d+)",
    },
    "report": {
        "in_favour": r"Against:|Abstaining:|Abstentions:|Before the vote|After the vote|(?i:\d+\.\s+Before|\d+\.\s+After)",
        "against": r"Abstaining:|Abstentions:|Before the vote|After the vote|(?i:\d+\.\s+Before|\d+\.\s+After)",
        "abstaining": r"Before the vote|After the vote|(?i:\d+\.\s+Before|\d+\.\s+After)",
    },
}
ADOPTION = [(r"(?i)was\s+adopted", "adopted"), (r"(?i)was\s+rejected", "rejected"), (r"(?i)was\s+not\s+adopted", "not_adopted"), (r"(?i)is\s+adopted", "adopted"), (r"(?i)adopted\s+without\s+a\s+vote", "adopted")]
REPORT_ITEM = r"(?im)(?=^[A-Z]\.\s+Draft resolution\s)"
REPORT_HEAD = r"(?i)^([A-Z])\.\s+Draft resolution\s+(A/C\.\d+/\d+/L\.\d+(?:/Rev\.\d+)?)"
OUTER_COMMA = r",(?![^()]*\))"
PAGE_MARK, DRAFT_TAIL, INITIAL = r"\s*\d+/\d+\s+A/\d+/[A-Z0-9.]+", r"(?i)\s+Draft\s+resolution.*$", r"\b[A-Z]\.$"
NUMBERED = r"(?i)\(?resolution\s+([1-9]\d{0,2}/\d+)\)?"
DIVISION, AMENDMENT, ORAL = r"(?i)motion\s+(?:for\s+division|to\s+divide)", "(?i)amendment", r"(?i)oral\s+amendment"
WITHOUT_VOTE, BY_VOTE = r"(?i)without\s+a\s+vote", r"(?i)by\s+(?:a\s+)?vote\s+of\s+(\d+)\s+to\s+(\d+)"
BY_RECORDED_VOTE, ABSTENTIONS = r"(?i)by\s+a\s+recorded\s+vote\s+of\s+(\d+)\s+to\s+(\d+)(?:,\s+with\s+(\d+)\s+abstention)?", r"(?i)(\d+)\s+abstention"
SUBMITTED, JOINED = r"submitted by\s+([^.]+)", r"(?:Subsequently|At the same meeting|Also at the same meeting),\s+([^.]+?)\s+joined"
SUBMITTER, PARAGRAPH = r"(?is)submitted by\s+(.+?)(?:\.|,|$)", r"(?i)see\s+para\.\s+(\d+),\s+draft resolution\s+([IVX]+|\d+)"
DRAFT_PARTS = r"(?i)A/C\.(\d+)/(\d+)/L\.(\d+)(?:/Rev\.(\d+))?"
QUOTED_TITLE = r'(?is)entitled\s+["\u201C\u201D](.+?)["\u201C\u201D]'


def mentions(df: DataFrame, id_col: str, text_col: str, pattern: str = SYMBOL) -> DataFrame:
    """(id, pos, symbol, context): each match with its line, once per (symbol, line)."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    found = lines.select(id_col, "line_no", collapse_ws(F.col("line")).alias("context"), F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("at", "symbol"))
    first = F.min(F.struct("line_no", "at"))
    return found.groupBy(id_col, "symbol", "context").agg(first.alias("first")).select(id_col, "symbol", "context", F.col("first.line_no").alias("line_no"), F.col("first.at").alias("pos"))


def first_mentions(c: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def sr_references(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """C2."""
    return df.select(id_col, F.posexplode(first_mentions(F.col(text_col), SUMMARY_RECORD)).alias("pos", "symbol"))


def cited_resolutions(c: Column) -> Column:
    """Resolutions in parentheses, as an array."""
    lists = F.regexp_extract_all(c, F.lit(r"\(resolutions?\s+([\d/,\s]+(?:and\s+[\d/,\s]+)?)\)"), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, r"[,\s]+and\s+|,\s*"), lambda y: F.trim(y))))
    return F.filter(parts, lambda x: x.rlike(r"^\d+/"))


def cited_decisions(c: Column) -> Column:
    """Decisions in parentheses; ``78/528 A to D`` and ``78/504 A and B`` are spelled out."""
    span, pair = r"(\d+/\d+)\s+([A-Z])\s+to\s+([A-Z])", r"(\d+/\d+)\s+([A-Z])\s+and\s+([A-Z])"
    lists = F.regexp_extract_all(c, F.lit(r"\(decisions?\s+([^)]+)\)"), F.lit(1))

    def spelled(x: Column) -> Column:
        letters = lambda m: F.sequence(F.ascii(F.regexp_extract(m, span, 2)), F.ascii(F.regexp_extract(m, span, 3)))
        ranges = F.flatten(F.transform(F.regexp_extract_all(x, F.lit(span), F.lit(0)), lambda m: F.transform(letters(m), lambda n: F.concat_ws(" ", F.regexp_extract(m, span, 1), F.char(n)))))
        left = F.regexp_replace(x, span, "")
        pairs = F.flatten(F.transform(F.regexp_extract_all(left, F.lit(pair), F.lit(0)), lambda m: F.array(*[F.concat_ws(" ", F.regexp_extract(m, pair, 1), F.regexp_extract(m, pair, g)) for g in (2, 3)])))
        single = F.transform(F.split(F.regexp_replace(left, pair, ""), r",\s*|\s+and\s+"), lambda s: F.regexp_replace(F.regexp_extract(F.trim(s), r"^(\d+/\d+(?:\s+[A-Z]\b)?)", 1), r"\s+", " "))
        return F.concat(ranges, pairs, F.filter(single, lambda s: s != ""))

    return F.flatten(F.transform(lists, spelled))


def draft_ordinals(c: Column) -> Column:
    """C4. Alternatives of the pattern are tried in order, so ``IV`` reads ``I`` and ``VI`` reads ``V``."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(ORDINAL), F.lit(1)), F.upper))


def paragraphs(df: DataFrame, id_col: str, text_col: str, starts: str) -> DataFrame:
    """C5, general form: (id, ordinal, text): lines joined into paragraphs, each begun by a line that matches."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("ordinal", F.sum(F.col("line").rlike(starts).cast("int")).over(so_far))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    return numbered.groupBy(id_col, "ordinal").agg(text.alias("text"))


def segment_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, ordinal, sub, text) of a resolution: preamble by starters, operative and lettered paragraphs.

    The operative part begins at the first paragraph numbered 1. A preamble line that begins with no starter continues
    the paragraph before it.
    """
    cut = F.regexp_instr(F.col(text_col), F.lit(r"\n\s*1\.\s+[A-Z]"))
    parts = df.select(id_col, F.when(cut > 0, F.substring(text_col, F.lit(1), cut - 1)).otherwise(F.col(text_col)).alias("preamble"), F.when(cut > 0, F.substring(text_col, cut, F.length(text_col))).alias("operative"))
    opening = "^(" + "|".join(PREAMBLE_STARTERS) + ")"
    before = paragraphs(parts, id_col, "preamble", opening).select(id_col, F.lit("preamble").alias("part"), F.greatest("ordinal", F.lit(1)).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("sub"), "text")
    items = parts.filter("operative is not null").select(id_col, F.explode(F.split("operative", r"(?=\n\s*\d+\.\s+)")).alias("item"))
    items = items.select(id_col, extracted(F.col("item"), r"^\n\s*(\d+)\.\s+").cast("int").alias("ordinal"), F.split("item", r"\n\s*(?=\([a-z]\)\s+)").alias("pieces")).filter("ordinal is not null")
    pieces = items.select(id_col, "ordinal", F.posexplode("pieces").alias("n", "piece"))
    after = pieces.select(id_col, F.when(F.col("n") == 0, "operative").otherwise("sub").alias("part"), "ordinal", F.when(F.col("n") > 0, extracted(F.col("piece"), r"^\(([a-z])\)")).alias("sub"), collapse_ws(F.col("piece")).alias("text"))
    return before.unionByName(after)


def split_states(c: Column) -> Column:
    """Names between commas outside of parentheses, without page marks, draft titles and a last full stop."""

    def unstopped(name: Column) -> Column:
        stop = F.endswith(name, F.lit(".")) & ~name.rlike(INITIAL)
        return F.trim(F.when(stop, F.left(name, F.length(name) - 1)).otherwise(name))

    # White space goes once a list, and each step is a pass of its own: inside of one pass a name would be cleaned anew
    # wherever the step names it.
    names = F.transform(F.split(collapse_ws(c), OUTER_COMMA), lambda n: F.trim(n))
    marked = F.contains(c, F.lit("/")) | F.contains(F.lower(c), F.lit("draft"))
    bare = F.when(marked, F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(n, PAGE_MARK, ""), DRAFT_TAIL, ""))).otherwise(names)
    return F.filter(F.transform(bare, unstopped), lambda x: x != "")


def vote_lists(c: Column, style: str = "meeting") -> Column:
    """struct(in_favour, against, abstaining) of name arrays. A list ends at the nearest end mark."""

    def names(kind: str) -> Column:
        marks = [F.when(F.instr(c, m) > 0, F.substring(c, F.instr(c, m) + len(m), F.length(c))) for m in VOTE_MARKS[kind]]
        body = F.split(F.coalesce(*marks), VOTE_ENDS[style][kind], 2)[0]
        body = F.regexp_replace(body, r"(?s)\d+/\d+\s+\d{2}/\d{2}/\d{4}.*$", "") if style == "meeting" else F.regexp_replace(body, r"A/\d+/\d+(?:/Add\.\d+)?", "")
        none = F.array().cast("array<string>")
        marked = reduce(or_, [F.contains(c, F.lit(m)) for m in VOTE_MARKS[kind]])
        return F.when(marked, F.coalesce(split_states(body), none)).otherwise(none)

    return F.struct(*[names(k).alias(k) for k in VOTE_MARKS])


def extract_vote_lists(df: DataFrame, id_col: str, text_col: str, style: str = "meeting") -> DataFrame:
    """C7 in long form: (id, vote_type, state)."""
    lists = df.select(id_col, vote_lists(F.col(text_col), style).alias("v"))
    pairs = F.array(*[F.struct(F.lit(k).alias("vote_type"), F.col(f"v.{k}").alias("states")) for k in VOTE_MARKS])
    return lists.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.vote_type", F.explode("p.states").alias("state"))


def country_list(c: Column, style: str = "comma", names: list[str] = MULTI_WORD_COUNTRIES) -> Column:
    """Names between commas and "and"; or between spaces, where names of several words are found longest first."""
    if style == "comma":
        return F.filter(F.transform(F.split(F.regexp_replace(c, r"\s+and\s+", ", "), ","), lambda x: F.regexp_replace(F.trim(x), r"\.$", "")), lambda x: x != "")
    known, rest = tagged(c, F.array(*[F.lit(n) for n in sorted(names, key=lambda n: (-len(n), n))]))
    return F.concat(known, F.filter(F.split(F.trim(rest), r"\s+"), lambda x: x != ""))


def tagged(c: Column, names: Column) -> tuple[Column, Column]:
    """(names found, text left): names in the given order, each found name taken out before the next."""
    start = F.struct(c.alias("text"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, n: Column) -> Column:
        hit = F.instr(acc["text"], n) > 0
        return F.struct(F.when(hit, F.replace(acc["text"], n, F.lit(" "))).otherwise(acc["text"]).alias("text"), F.when(hit, F.array_append(acc["found"], n)).otherwise(acc["found"]).alias("found"))

    out = F.aggregate(names, start, step)
    return out["found"], out["text"]


def tag_dictionary(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, names_in_shard: int = SHARD_NAMES) -> DataFrame:
    """(id, name). Names are tried longest first, each found one taken out of the text before the next; what is taken
    out leaves a space, across which a name that comes later may be found. Rows without an id are left out.

    An automaton reads a text once, whatever the number of names. The dictionary is cut into shards of ``names_in_shard``
    in the order in which names are tried; texts go from shard to shard with what is left of them.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    return tagged_by_shards(rows, names.select(F.col(name_col).cast("string").alias("name")), names_in_shard).select(F.col("id").alias(id_col), "name")


def strip_page_noise(df: DataFrame, id_col: str, page_col: str, text_col: str) -> DataFrame:
    """Lines of footers, and of the symbol on top of later pages, taken out."""
    noise = lambda line: [F.trim(line).rlike(p) for p in FOOTERS]

    def keep(line: Column) -> Column:
        bad = F.lit(False)
        for n in noise(line):
            bad = bad | n
        return ~(bad | ((F.col(page_col) > 1) & F.trim(line).rlike(PAGE_HEADER)))

    return df.select(id_col, page_col, F.array_join(F.filter(F.split(text_col, "\n"), keep), "\n").alias("text"))


def agenda_items(df: DataFrame, id_col: str, text_col: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(id, item_no, type, item_number, sub_item, section_letter, committee, title, text, resolutions, decisions)."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    line = F.col("line")
    kind = F.when(line.rlike(COMMITTEE_LINE), "committee_header").when(line.rlike(r"^[A-Z]\.\s+.+$"), "section").when(line.rlike(r"^\d+\.\s+.+$"), "main").when(line.rlike(r"^\([a-z]{1,2}\)\s+.+$"), "sub")
    name = F.when(line.rlike("(?i)^Plenary"), "Plenary").when(line.rlike("(?i)^Special"), "Fourth Committee").otherwise(F.initcap(F.lower(F.regexp_extract(line, COMMITTEE_LINE, 1))))
    lines = lines.withColumn("type", kind)
    last = {
        "committee": F.when(F.col("type") == "committee_header", name), "section_letter": F.when(F.col("type") == "section", F.left("line", F.lit(1))),
        "item_number": F.when(F.col("type") == "main", extracted(line, r"^(\d+)\.").cast("int")),
    }
    marked = running(lines, [id_col], ["pos"], carried=last, summed={"item_no": F.col("type").isNotNull().cast("int")}, segment_rows=segment_rows)
    body = F.regexp_replace(line, r"^(?:\d+\.|[A-Z]\.|\([a-z]{1,2}\))\s+", "")
    first = lambda c: F.min_by(c, "pos")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("type").isNotNull(), body).otherwise(line).alias("t")))), lambda x: x["t"]), " ")
    items = marked.filter("item_no > 0").groupBy(id_col, "item_no").agg(
        first("type").alias("type"), first("item_number").alias("item_number"), first(F.when(F.col("type") == "sub", extracted(line, r"^\(([a-z]{1,2})\)"))).alias("sub_item"),
        first("section_letter").alias("section_letter"), first("committee").alias("committee"), first(body).alias("title"), joined.alias("text"),
    )
    top = F.col("type").isin("main", "sub")
    return items.withColumns({
        "item_number": F.when(top, F.col("item_number")), "section_letter": F.when(F.col("type") != "committee_header", F.col("section_letter")),
        "resolutions": cited_resolutions(F.col("text")), "decisions": cited_decisions(F.col("text")),
    })


def expand_agenda_range(c: Column) -> Column:
    """struct(label, numbers) of an agenda line; one number, or a range from number to number."""
    a, b = extracted(c, AGENDA_LINE, 1), extracted(c, AGENDA_LINE, 2)
    digits = lambda x: F.regexp_replace(x, "[A-Za-z]", "").cast("int")
    upward = digits(b) >= digits(a)
    numbers = F.when(b.isNull(), F.array(a)).when(upward, F.transform(F.sequence(digits(a), digits(b)), lambda n: n.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.concat_ws("-", a, b).alias("label"), numbers.alias("numbers"))


def parse_meetings(df: DataFrame, symbol_col: str, text_col: str, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """C11: (sections, utterances) of transcripts.

    An agenda line opens a section, a speaker line an utterance. Lines before the first section are the preface
    (section 0), lines before the first speaker of a section its preamble, whose first line that is no formula is the
    title. Ids read ``<symbol>_section_<n>_utterance_<k>``.
    """
    lines = df.select(symbol_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", collapse_ws(F.col("line"))).filter("line <> ''")
    line = F.col("line")
    lines = running(lines.withColumn("opens", line.rlike(AGENDA_LINE)), [symbol_col], ["pos"], summed={"section": F.col("opens").cast("int")}, segment_rows=segment_rows)
    speaks = ~F.col("opens") & (F.col("section") > 0) & line.rlike(SPEAKER_LINE)
    lines = running(lines.withColumn("speaks", speaks), [symbol_col, "section"], ["pos"], summed={"turn": F.col("speaks").cast("int")}, segment_rows=segment_rows)
    text_of = lambda cond, t: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", t.alias("t"))))), lambda x: x["t"]), " ")
    preamble = (F.col("turn") == 0) & ~F.col("opens")
    formula = F.lit(False)
    for start in NOT_TITLES:
        formula = formula | F.lower(line).startswith(start)
    title = F.coalesce(F.min_by("line", F.when(preamble & ~formula, F.col("pos"))), F.min_by("line", F.when(preamble, F.col("pos"))))
    agenda = F.max(F.when(F.col("opens"), F.col("line")))
    sections = lines.groupBy(symbol_col, "section").agg(agenda.alias("raw_agenda_line"), title.alias("section_title"), text_of(preamble, line).alias("section_summary"))
    sections = sections.withColumns({"id": F.concat_ws("_section_", symbol_col, F.col("section").cast("string")), "agenda": expand_agenda_range(F.col("raw_agenda_line"))})
    said = F.when(F.col("speaks"), collapse_ws(F.regexp_extract(line, SPEAKER_LINE, 2))).otherwise(line)
    header = F.max(F.when(F.col("speaks"), collapse_ws(F.regexp_extract(line, SPEAKER_LINE, 1))))
    utterances = lines.filter("turn > 0").groupBy(symbol_col, "section", F.col("turn").alias("position_in_section")).agg(header.alias("header"), F.min("pos").alias("line_no"), collapse_ws(text_of(F.lit(True), said)).alias("text"))
    utterances = utterances.withColumns({
        "id": F.concat(F.col(symbol_col), F.lit("_section_"), F.col("section").cast("string"), F.lit("_utterance_"), F.col("position_in_section").cast("string")),
        "speaker": parse_speaker(F.col("header")), "documents": F.regexp_extract_all("text", F.lit(SYMBOL), F.lit(0)),
        "word_count": F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")),
    })
    return sections, utterances


def short_title(quoted: Column) -> Column:
    """A quoted title of bounded length: of a long one the first sentence, if that ends in time."""
    end = F.regexp_instr(F.left(quoted, F.lit(200)), F.lit(r"\.(?:\s|$)"))
    title = collapse_ws(F.when((F.length(quoted) > 200) & (end > 0), F.trim(F.substring(quoted, F.lit(1), end - 1))).otherwise(quoted))
    stop = F.instr(F.left(title, F.lit(301)), ".")
    return F.when((F.length(title) > 300) & (stop > 1), F.trim(F.substring(title, F.lit(1), stop - 1))).otherwise(title)


def vote_counts(c: Column) -> Column:
    """struct(type, info, yes, no, abstain) of how a text says that it was voted; all null where it does not."""
    kind = F.when(c.rlike(WITHOUT_VOTE), "without").when(c.rlike(BY_VOTE), "plain").when(c.rlike(BY_RECORDED_VOTE), "recorded")
    count = lambda pattern, group: bound(F.regexp_extract(c, pattern, group), lambda n: F.when(n != "", n.cast("int")))

    def numbers(k: Column) -> Column:
        counted = lambda plain, recorded: F.when(k == "plain", count(*plain)).when(k == "recorded", count(*recorded))
        return F.struct(counted((BY_VOTE, 1), (BY_RECORDED_VOTE, 1)).alias("yes"), counted((BY_VOTE, 2), (BY_RECORDED_VOTE, 2)).alias("no"), counted((ABSTENTIONS, 1), (BY_RECORDED_VOTE, 3)).alias("abstain"))

    def told(k: Column, n: Column) -> Column:
        both = F.concat_ws(" to ", n["yes"].cast("string"), n["no"].cast("string"))
        extra = F.when(k == "recorded", F.coalesce(F.concat(F.lit(", with "), n["abstain"].cast("string"), F.lit(" abstentions")), F.lit(""))).otherwise("")
        info = F.when(k == "without", "without a vote").when(k.isNotNull(), F.concat(both, extra))
        return F.struct(F.when(k == "without", "without_vote").when(k.isNotNull(), "recorded_vote").alias("type"), info.alias("info"), n["yes"].alias("yes"), n["no"].alias("no"), n["abstain"].alias("abstain"))

    return bound(kind, lambda k: bound(numbers(k), lambda n: told(k, n)))


def utterance_facts(c: Column, votes: Column | None = None) -> Column:
    """Struct of what a speech says on drafts, titles, numbers, adoption, procedure and votes. Over many rows, ``votes`` is
    best a column that holds the ``vote_counts``, as each field that is read would else count them."""
    ordinal, number = F.upper(extracted(c, ORDINAL)), extracted(c, NUMBERED)
    adoption = F.coalesce(*[F.when(c.rlike(pattern), status) for pattern, status in ADOPTION])
    amends = c.rlike(AMENDMENT) & c.rlike("(?i)vote") & number.isNull()
    procedure = F.coalesce(F.when(c.rlike(DIVISION), "motion_for_division"), F.when(amends & c.rlike(ORAL), "vote_on_oral_amendment"), F.when(amends, "vote_on_amendment"))
    lists, votes = vote_lists(c), vote_counts(c) if votes is None else votes
    listed = F.size(F.concat(*[lists[k] for k in VOTE_MARKS])) > 0
    drafts = F.filter(F.regexp_extract_all(c, F.lit(SYMBOL), F.lit(0)), lambda s: s.contains("/L."))
    about = F.coalesce(ordinal, F.when(procedure.isNotNull(), F.try_element_at(drafts, F.lit(1))))
    fields = {
        "draft_resolution_identifier": about, "resolution_title": short_title(F.trim(extracted(c, QUOTED_TITLE))), "resolution_number": number, "resolution_symbol": F.concat(F.lit("A/RES/"), number),
        "adoption_status": adoption, "procedural_type": procedure, "vote_type": F.when(listed, "recorded_vote").otherwise(votes["type"]), "vote_info": votes["info"], "vote_in_favor": votes["yes"],
        "vote_against": votes["no"], "vote_abstentions": votes["abstain"], "vote_details": lists, "draft_mentions": draft_ordinals(c), "related_documents": drafts,
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def item_sponsors(c: Column) -> Column:
    """C14: sponsors named in a report item: who submitted it and who joined later; distinct and sorted."""
    none = F.array().cast("array<string>")
    later = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(JOINED), F.lit(1)), lambda names: country_list(names)))
    return F.array_sort(F.array_union(F.coalesce(country_list(extracted(c, SUBMITTED)), none), F.coalesce(later, none)))


def draft_sponsors(items: DataFrame, drafts: DataFrame) -> DataFrame:
    """C14: (draft_symbol, sponsors). An item belongs to a draft by its symbol, or by the symbol in its text.

    The second way is an equi-join on the symbols found in the text.
    """
    named = items.select("item_text", F.explode(F.array_distinct(F.concat(F.array("draft_symbol"), F.regexp_extract_all("item_text", F.lit(SYMBOL), F.lit(0))))).alias("draft_symbol"))
    hit = drafts.select("draft_symbol").distinct().join(named, "draft_symbol")
    sponsors = hit.select("draft_symbol", F.explode(item_sponsors(F.col("item_text"))).alias("s"))
    return sponsors.groupBy("draft_symbol").agg(F.array_sort(F.collect_set("s")).alias("sponsors"))


def header_sponsors(text: Column) -> Column:
    """The list on the title page, in the lines just before ``: draft resolution`` or ``: draft decision``."""
    head = F.regexp_extract(F.left(text, F.lit(2500)), r"(?is)^(.*?):\s*draft\s+(?:resolution|decision)", 1)
    block = F.regexp_extract(F.right(head, F.lit(400)), r"((?:(?:^|\n)[ \t]*(?:[A-Z]|[^\n]*,)[^\n]*)+)$", 1)
    flat = collapse_ws(block)
    return F.when(flat.contains(",") & flat.rlike(r"(?i)\sand\s"), country_list(flat))


def additional_sponsors(notes: Column) -> Column:
    """C15."""
    return country_list(extracted(notes, r"[Aa]dditional sponsors?:\s*([^(]+?)\s*(?:\(|$)"))


def report_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """C17: one row per item of a committee report, with title, submitter, outcome, counts, lists and text reference."""
    items = df.select(id_col, F.posexplode(F.split(text_col, REPORT_ITEM)).alias("item_no", "item_text")).filter(F.col("item_text").rlike(REPORT_HEAD))
    t = F.col("item_text")
    symbol = extracted(t, REPORT_HEAD, 2)
    adopted = lambda how: t.rlike(r"(?i)adopted\s+" + how.removeprefix("(?i)"))
    without, recorded = adopted(WITHOUT_VOTE), adopted(r"by\s+a\s+recorded\s+vote")
    count = lambda g: F.when(~without & recorded, extracted(t, r"(?i)adopted\s+" + BY_RECORDED_VOTE.removeprefix("(?i)"), g).cast("int"))
    parts = {f"draft_{name}": extracted(symbol, DRAFT_PARTS, g).cast("int") for g, name in enumerate(("committee", "session", "number", "revision"), 1)}
    fields = {
        "section_letter": extracted(t, REPORT_HEAD, 1), "draft_symbol": symbol, **parts, "title": collapse_ws(extracted(t, QUOTED_TITLE)), "submission_info": collapse_ws(extracted(t, SUBMITTER)),
        "adoption_status": F.when(without | recorded | adopted("draft resolution"), "adopted"), "vote_info": F.when(without, "without a vote"),
        "in_favor": count(1), "against": count(2), "abstentions": F.when(count(1).isNotNull(), F.coalesce(count(3), F.lit(0))),
        "paragraph": extracted(t, PARAGRAPH, 1).cast("int"), "draft_ordinal": extracted(t, PARAGRAPH, 2), "vote_details": vote_lists(t, "report"),
    }
    return items.select(id_col, "item_no", *[v.alias(k) for k, v in fields.items()], "item_text")


def meeting_transcript(df: DataFrame, meeting_col: str, position_col: str, name_col: str, text_col: str, affiliation_col: str | None = None, preface_col: str | None = None) -> DataFrame:
    """(meeting, transcript): the preface, then each speech below a rule and ``Name (Affiliation):``."""
    who = F.col(name_col)
    if affiliation_col:
        who = F.concat(who, F.coalesce(F.concat(F.lit(" ("), F.col(affiliation_col), F.lit(")")), F.lit("")))
    head = F.coalesce(F.concat(F.lit("=" * 80 + "\n"), who, F.lit(":\n\n")), F.lit(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(position_col, F.concat(head, F.col(text_col)).alias("t")))), lambda x: x["t"])
    preface = F.first(preface_col, ignorenulls=True) if preface_col else F.lit(None)
    return df.groupBy(meeting_col).agg(F.concat_ws("\n\n", preface, F.array_join(parts, "\n\n")).alias("transcript"))
