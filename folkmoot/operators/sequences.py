"""Ordered-sequence operators (inventory 2.D), as segmented scans and windows over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.operators.scans import SEGMENT_ROWS, row_number, running


def with_positions(utterances: DataFrame, meeting: str, section: str, position: str, text: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """1-based positions in the meeting and in the section, counted before speeches without text are dropped."""
    rows = row_number(utterances, [meeting], [section, position], "position_in_meeting", segment_rows)
    rows = row_number(rows, [meeting, section], [position], "position_in_section", segment_rows)
    return rows.filter(F.coalesce(F.trim(text), F.lit("")) != "")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The latest value so far that is not null, the row's own included."""
    return running(df, keys, order, carried={name: value}, segment_rows=segment_rows)


def carry_active_draft(utterances: DataFrame, keys: list[str], order: list[str], documents: str = "documents", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """active_draft: the first draft of the latest speech so far in the section that names one."""
    draft = F.try_element_at(F.filter(F.col(documents), lambda d: d.contains("/L.")), F.lit(1))
    return carry_forward(utterances, keys, order, draft, "active_draft", segment_rows)


# What a chair says to open and close the contexts below.
EOV_BEFORE = r"(?i)(?:give|giving).*floor.*explanation of (?:vote|position).*before"
EOV_AFTER = r"(?i)(?:give|giving).*floor.*explanation of (?:vote|position).*after"
EOV_CLOSE = r"(?i)(?:heard|hear).*last speaker.*explanation of (?:vote|position)"
EOV_OWN = r"(?i)\bexplanation of (?:vote|position)\b"
SEVERAL = r"(?i)(\d+|several|multiple|a number of)\s+draft\s+resolutions?"
DECIDES = r"(?i)we will now take a decision|we turn (first|now) to|draft resolution [IVX]+ is entitled"


def tag_contexts(utterances: DataFrame, keys: list[str], order: list[str], speaker: str = "speaker_raw", text: str = "text", mentions: str = "draft_mentions", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Tags of explanations of vote and of debates on several drafts.

    A chair's speech that announces several drafts is read no further: it neither opens, closes nor decides anything
    else. The closing speech of explanations is still inside its context, the rows after it are not.
    """
    chair, t = F.lower(F.coalesce(F.col(speaker), F.lit(""))).contains("president"), F.col(text)
    announces = chair & t.rlike(SEVERAL)
    acts = chair & ~announces
    eov = F.when(acts & t.rlike(EOV_BEFORE), "before_vote").when(acts & t.rlike(EOV_AFTER), "after_vote").when(acts & t.rlike(EOV_CLOSE), "CLOSE")
    several = F.when(announces, True).when(acts & t.rlike(DECIDES), False)
    rows = utterances.withColumns({"eov_mark": eov, "several_mark": several, "announces": announces, "chair": chair})
    rows = running(rows, keys, order, carried={"eov_now": F.col("eov_mark"), "several_now": F.col("several_mark")}, segment_rows=segment_rows)
    rows = rows.withColumn("several_now", F.coalesce("several_now", F.lit(False)))
    open_ = F.when(F.col("eov_now") != "CLOSE", F.col("eov_now"))
    own = ~F.col("chair") & t.rlike(EOV_OWN)
    own_timing = F.when(own & open_.isNull() & t.rlike(r"(?i)explanation.*before"), "before_vote").when(own & open_.isNull() & t.rlike(r"(?i)explanation.*after"), "after_vote")
    timing = F.coalesce(F.when(~F.col("chair"), open_), own_timing)
    inside = F.col("several_now") & ~F.col("announces") & (F.coalesce(F.size(mentions), F.lit(0)) > 0)
    return rows.withColumns({
        "eov_section_announcement": F.when(F.col("eov_mark") != "CLOSE", F.col("eov_mark")), "eov_section_closed": F.coalesce(F.col("eov_mark") == "CLOSE", F.lit(False)),
        "speech_timing": timing, "is_explanation_of_vote": timing.isNotNull(), "self_declared_explanation": own, "mentioned_resolutions": F.when(inside, F.col(mentions)),
    }).drop("eov_mark", "several_mark", "announces", "chair", "eov_now", "several_now")


def number_timesteps(steps: DataFrame, key: str, *order: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """T from 0 in the order of stages, then of the source; dates play no part."""
    return row_number(steps, [key], list(order), "t", segment_rows).withColumn("t", F.col("t") - 1)


def first_of_stage(steps: DataFrame, key: str, stage: str, value: str, t: str = "t") -> DataFrame:
    """(key, stage, value) of the first step of each stage."""
    return steps.groupBy(key, stage).agg(F.min_by(value, t).alias(value))


def last_of_stage(steps: DataFrame, key: str, stage: str, value: str, t: str = "t") -> DataFrame:
    return steps.groupBy(key, stage).agg(F.max_by(value, t).alias(value))


def transitions(steps: DataFrame, key: str, state: list[str], order: list[str]) -> DataFrame:
    """Each step with the next one's state; the last step of an episode has none and is left out."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = steps.withColumns({f"next_{c}": F.lead(c).over(w) for c in state} | {"has_next": F.lead(F.lit(True)).over(w)})
    return rows.filter("has_next").drop("has_next")


def timeline(stages: DataFrame, date: Column, *then: str) -> DataFrame:
    """By parsed date, unknown dates last, then stage order; numbered from 1 within each trajectory."""
    rows = stages.withColumn("parsed_date", date)
    w = Window.partitionBy("trajectory_id").orderBy(F.asc_nulls_last("parsed_date"), *then)
    return rows.withColumn("place", F.row_number().over(w))


def preview_sample(df: DataFrame, order: list, group: list[str]) -> DataFrame:
    """Per group, all rows up to 50, else the first 10, the middle 5 and the last 5."""
    w = Window.partitionBy(*group)
    rows = df.withColumns({"place": F.row_number().over(w.orderBy(*order)), "of": F.count(F.lit(1)).over(w)})
    middle = F.floor(F.col("of") / 2)
    return rows.filter((F.col("of") <= 50) | (F.col("place") <= 10) | (F.col("place") > F.col("of") - 5) | F.col("place").between(middle - 1, middle + 3))
