"""Readers (inventory 2.A): parsed JSON records, catalogue XML, web pages, and the conformed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folkmoot.functions.columns import extracted

# Shapes of the parsed records, and language codes of files.
REF = "array<struct<text:string,url:string>>"
META = "struct<id:string,symbol:string,record_id:string,title:string,date:string,action_note:string,description:string,notes:string,authors:array<string>,session:string,source_file:string>"
RECORD_SCHEMAS = {
    "resolutions": f"id string, metadata {META}, voting struct<vote_type:string,yes:int,no:int,abstain:int,meeting:string,raw_text:string>, related_documents struct<drafts:{REF},committee_reports:{REF},meeting_records:{REF}>, agenda array<struct<id:string,agenda_symbol:string,item_number:int,sub_item:string,title:string,subjects:string,url:string>>, files array<struct<language:string,filename:string,url:string>>, subjects array<string>",
    "drafts": f"metadata {META}, draft_text string, stats struct<word_count:int,line_count:int,has_annex:boolean>",
    "committee-reports": f"id string, metadata {META}, introduction string, items array<struct<id:string,section_letter:string,draft_symbol:string,title:string,submission_info:string,sponsors:array<string>,adoption_status:string,vote_info:string,vote_details:struct<in_favour:array<string>,against:array<string>,abstaining:array<string>>,item_text:string>>",
    "agenda": f"id string, metadata {META}, items array<struct<id:string,type:string,item_number:int,sub_item:string,section_letter:string,committee:string,title:string,text:string,resolutions:array<string>,decisions:array<string>>>",
    "meetings": f"id string, source_file string, preface string, metadata {META}, sections array<struct<id:string,agenda_item_number:string,agenda_item_numbers:array<string>,section_title:string,section_summary:string,documents:array<struct<symbol:string,context:string>>,utterances:array<struct<id:string,speaker:struct<raw:string,affiliation:string,role:string,honorific:string,name:string>,text:string,word_count:int,documents:array<string>>>>>",
    "texts": f"id string, metadata {META}, text_segments struct<preamble:string,operative:string,preamble_paragraphs:array<string>,operative_paragraphs:array<string>>, raw_text struct<full_text:string,cleaned_text:string>, introduction string, draft_text string",
}
LANGUAGES = {"english": "EN", "français": "FR", "french": "FR", "español": "ES", "spanish": "ES", "العربية": "AR", "arabic": "AR", "русский": "RU", "russian": "RU", "中文": "ZH", "chinese": "ZH"}
TABLES = ["documents", "actors", "vote_events", "votes", "document_relationships", "utterances", "utterance_documents", "subjects", "document_subjects", "sponsorships"]


def read_parsed(spark: SparkSession, path: str, kind: str, one_per_line: bool = False) -> DataFrame:
    """A1: records of one kind, a file or a line each, with ``_corrupt`` set for those that are no JSON, ``path`` and
    ``symbol``."""
    schema = RECORD_SCHEMAS[kind] + ", _corrupt string"
    df = spark.read.schema(schema).option("multiLine", not one_per_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("metadata.symbol").alias("symbol"))


FIELDS = "struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_VALUE:string,_code:string>>>"
MARC_SCHEMA = f"controlfield array<struct<_VALUE:string,_tag:string>>, datafield array<{FIELDS}>"


def read_marc(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(MARC_SCHEMA).load(path)


def fields(tag: str) -> Column:
    return F.filter("datafield", lambda f: f["_tag"] == tag)


def subfields(tag: str, codes: str | None = None) -> Column:
    """Values of a tag's subfields, in order."""
    values = F.flatten(F.transform(fields(tag), lambda f: F.filter(f["subfield"], lambda s: s["_code"].isin(*codes)) if codes else f["subfield"]))
    return F.filter(F.transform(values, lambda s: F.trim(s["_VALUE"])), lambda v: v != "")


def first_value(tag: str, code: str) -> Column:
    return F.try_element_at(subfields(tag, code), F.lit(1))


def value_of(field: Column, code: str) -> Column:
    return F.try_element_at(F.transform(F.filter(field["subfield"], lambda s: s["_code"] == code), lambda s: F.trim(s["_VALUE"])), F.lit(1))


def marc_id() -> Column:
    return F.try_element_at(F.transform(F.filter("controlfield", lambda c: c["_tag"] == "001"), lambda c: c["_VALUE"]), F.lit(1))


def read_marc_records(spark: SparkSession, path: str) -> DataFrame:
    """A3: (record_id, symbol, title, date, subjects, authors, files)."""
    files = F.transform(fields("856"), lambda f: F.struct(value_of(f, "y").alias("language"), value_of(f, "s").cast("long").alias("size"), value_of(f, "u").alias("url")))
    return read_marc(spark, path).select(
        marc_id().alias("record_id"), F.coalesce(first_value("191", "a"), first_value("791", "a")).alias("symbol"), F.array_join(subfields("245"), " ").alias("title"), first_value("269", "a").alias("date"),
        subfields("650", "a").alias("subjects"), subfields("710", "a").alias("authors"), F.filter(files, lambda f: f["url"].isNotNull()).alias("files"),
    )


def read_marc_votes(spark: SparkSession, path: str) -> DataFrame:
    """A4: (record_id, symbol, title, date, counts, votes)."""
    count = lambda code: F.coalesce(first_value("996", code).cast("int"), F.lit(0))
    votes = F.transform(fields("967"), lambda f: F.struct(value_of(f, "e").alias("country"), F.coalesce(value_of(f, "d"), F.lit("X")).alias("vote")))
    return read_marc(spark, path).select(
        marc_id().alias("record_id"), F.coalesce(first_value("791", "a"), F.concat(F.lit("vote_"), marc_id())).alias("symbol"), F.array_join(subfields("245", "abc"), " ").alias("title"), first_value("269", "a").alias("date"),
        F.struct(*[count(code).alias(name) for code, name in zip("bcdef", ("yes", "no", "abstain", "non_voting", "total"))]).alias("counts"), F.filter(votes, lambda v: v["country"].isNotNull()).alias("votes"),
    )


def explode_roll_call(df: DataFrame) -> DataFrame:
    """A4: (symbol, country, vote)."""
    return df.select("symbol", F.explode("votes").alias("v")).select("symbol", "v.country", "v.vote")


def absolute_url(href: Column, base: str) -> Column:
    root = base.rstrip("/")
    return F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(root + "/"), href))


# How a link is written; its address in either quote or in none, its text with any tags inside.
ANCHOR = r"""(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a>"""


def page_links(pages: DataFrame, base_url: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A5: (page_id, pos, text, url) of every link, in page order, with absolute addresses."""
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(0))).alias("pos", "a"))
    href = F.regexp_replace(F.regexp_extract("a", ANCHOR, 1), "^[\"']|[\"']$", "")
    return rows.select(id_col, "pos", F.trim(F.regexp_replace(F.regexp_extract("a", ANCHOR, 2), "<[^>]*>", "")).alias("text"), absolute_url(href, base_url).alias("url"))


def page_metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A5: (page_id, title, rows): the title, and label/value rows where the page has them."""
    row = r'(?s)<div class="metadata-row">\s*<span class="title[^"]*">(.*?)</span>\s*<span class="value[^"]*">(.*?)</span>'
    rows = F.transform(F.regexp_extract_all(html_col, F.lit(row), F.lit(0)), lambda m: F.struct(F.trim(F.regexp_extract(m, row, 1)).alias("label"), F.trim(F.regexp_replace(F.regexp_extract(m, row, 2), "<[^>]*>", " ")).alias("value")))
    return pages.select(id_col, extracted(F.col(html_col), "(?s)<title>(.*?)</title>").alias("title"), rows.alias("rows"))


def file_links(links: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A5: (page_id, language, url) of document files, the first of each address; English where no language is named."""
    code = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    pdf = links.filter(F.lower("url").rlike(r"\.pdf($|\?)"))
    first = pdf.groupBy(id_col, "url").agg(F.min_by("text", "pos").alias("text"))
    suffix = F.upper(extracted(F.col("url"), r"(?i)-(en|fr|es|ar|ru|zh)\.pdf"))
    return first.select(id_col, F.coalesce(code[F.lower(F.trim("text"))], suffix, F.lit("EN")).alias("language"), "url")


def register_tables(spark: SparkSession, directory: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The ten tables as views."""
    out = {}
    for name in names or TABLES:
        out[name] = spark.read.parquet(f"{directory.rstrip('/')}/{name}")
        out[name].createOrReplaceTempView(name)
    return out
