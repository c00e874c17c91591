"""Chat formatting from an event log.

``fold_events`` rebuilds messages: the log is keyed by (conversation, message) and ordered by sequence; a ``message``,
``edit`` or ``regenerate`` event replaces what the message said so far, a ``delta`` event adds to it, and a ``delete``
event empties it out. Keys hold the message too, so a conversation with a third of all rows still spreads out.
``render`` turns each message into marked, escaped text with the span under the loss mask, ``parse`` reads it back and
``digests`` streams every conversation in order through one hash, batch by batch.

Null texts are empty, a null role reads ``""``, null conversation ids form one conversation, rows of equal sequence
are ordered by role and text, and an empty log gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template: marks that open and close a turn. The role stands between the first two.
TURN_OPEN, ROLE_END, TURN_CLOSE = "<s>[INST] ", " [/INST] ", "</s>\n"
#: Strings that steer a model and so must not occur inside a text.
CONTROL = r"(<|\[)(/?(?:s>|INST\]|<SYS>>|/?SYS>>|\|))"
STARTS_OVER = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Final messages (conv_id, message, role, text) of events (conv_id, message, seq, kind, role, text).

    The role is that of the first event that has one. Events of an unknown kind count as deltas.
    """
    e = events.select(
        "conv_id", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    key = ["conv_id", "message"]
    # One order for all: sequence, role, text; a missing one comes first.
    place = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), "text")
    e = e.withColumn("place", place)
    after = Window.partitionBy(*key).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("kind").isin(*STARTS_OVER)
    first_role = F.min_by("role", F.when(F.col("role").isNotNull(), F.col("place"))).over(Window.partitionBy(*key))
    live = (
        e.withColumn("replaced", F.coalesce(F.max(starts).over(after), F.lit(False)))
        .withColumn("role", F.coalesce(first_role, F.lit("")))
        .filter(~F.col("replaced"))
    )
    said = F.array_sort(F.collect_list("place"))
    out = live.groupBy(*key, "role").agg(F.array_join(F.transform(said, lambda x: x["text"]), "").alias("text"), F.max(F.col("kind") == "delete").alias("deleted"))
    return (out if keep_deleted else out.filter(~F.col("deleted") | (F.col("text") != ""))).drop("deleted")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that led to them.

    Half of a text comes with the message, the other half as a delta behind it. An assistant's first half is written
    twice: as a message that was broken off, and again as its regeneration.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumns({"message": F.struct("turn", F.row_number().over(order).alias("copy")), "half": (F.length("text") / 2).cast("int")})
    first, rest = F.col("text").substr(F.lit(1), F.col("half")), F.col("text").substr(F.col("half") + 1, F.length("text"))
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    nobody = F.lit(None).cast("string")
    plain = F.array(event(0, "message", F.col("role"), first), event(3, "delta", nobody, rest))
    again = F.array(event(0, "message", F.col("role"), first), event(1, "delta", nobody, F.lit("...")), event(2, "regenerate", nobody, first), event(3, "delta", nobody, rest))
    log = t.select("conv_id", "message", F.explode(F.when(F.col("role") == "assistant", again).otherwise(plain)).alias("e"))
    return log.select("conv_id", "message", "e.seq", "e.kind", "e.role", "e.text")


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per message: its formatted text, and the code points [loss_from, loss_to) of it that are learned."""
    head = F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    learned = F.col("role").isin(*loss_roles)
    return messages.select(
        "conv_id",
        "message",
        F.concat(head, body, F.lit(TURN_CLOSE)).alias("formatted"),
        F.when(learned, F.length(head)).cast("long").alias("loss_from"),
        F.when(learned, F.length(head) + F.length(body)).cast("long").alias("loss_to"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Role, text and learned text of each formatted message, from ``formatted`` and its loss span alone."""
    inner = F.col("formatted").substr(F.lit(len(TURN_OPEN) + 1), F.length("formatted") - len(TURN_OPEN) - len(TURN_CLOSE))
    at = F.instr(F.col("inner"), ROLE_END)
    learned = F.col("formatted").substr((F.col("loss_from") + 1).cast("int"), (F.col("loss_to") - F.col("loss_from")).cast("int"))
    return formatted.withColumn("inner", inner).select(
        "conv_id",
        "message",
        unescape(F.expr(f"substring(inner, 1, instr(inner, '{ROLE_END}') - 1)")).alias("role"),
        unescape(F.col("inner").substr(at + len(ROLE_END), F.length("inner"))).alias("text"),
        F.coalesce(unescape(learned), F.lit("")).alias("learned"),
        F.length("formatted").cast("long").alias("n_formatted"),
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list = []  # the conversation at hand: id, turns, hash of turns, learned characters, their hash, formatted characters

    def done() -> pa.RecordBatch:
        conv, n, turns, n_loss, loss, size = now
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([n_loss], pa.int64()), pa.array([loss.hexdigest()]), pa.array([size], pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    for batch in batches:
        for conv, role, text, learned, size in zip(*(c.to_pylist() for c in batch.columns)):
            if not now or now[0] != conv:
                if now:
                    yield done()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[3] += len(learned)
            now[4].update(learned.encode())
            now[5] += size
    if now:
        yield done()


def digests(parsed: DataFrame) -> DataFrame:
    """Per conversation: counts and hashes over its messages in order; a task holds one batch of messages."""
    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "message").select("conv_id", "role", "text", "learned", "n_formatted")
    return ordered.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
