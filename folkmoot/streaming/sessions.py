"""Conversations by event time: their sessions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def closed_sessions(turns: DataFrame, key: list[str], conv: str, ts: str, hours: float, delay: str) -> DataFrame:
    """(conv, first, last, turns) of sessions, each once, when the watermark says that nothing can join it any more.

    Same sessions as ``aggregates.conversation_sessions`` of the turns that came in time, with no turn twice: a turn is told
    by ``key``, and may come again for as long as it is not late. Turns that come more than ``delay`` behind the newest one
    are left out (``late_rows`` counts them), turns without a time as well. State holds the keys of the last ``delay`` and
    the sessions still open, and nothing else, however long the stream runs.
    """
    timed = turns.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    once = timed.dropDuplicatesWithinWatermark(key)
    each = once.groupBy(F.session_window(ts, f"{round(hours * 3600)} seconds"), conv).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("turns"))
    return each.select(conv, "first", "last", "turns")


def stream_sessions(turns: DataFrame, key: list[str], conv: str, ts: str, hours: float, delay: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends closed sessions to Parquet files; what has arrived is read to its end, and a later start goes on from there."""
    closed = closed_sessions(turns, key, conv, ts, hours, delay)
    return closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def late_rows(stream: StreamingQuery) -> int:
    """Rows that came too late, in the batches whose progress the session still holds (the newest 100, unless set otherwise)."""
    batches = {p["batchId"]: p for p in stream.recentProgress}
    return sum(o["numRowsDroppedByWatermark"] for p in batches.values() for o in p["stateOperators"])


def state_rows(stream: StreamingQuery) -> int:
    """Rows that the state holds after the last batch."""
    return sum(o["numRowsTotal"] for o in stream.lastProgress["stateOperators"]) if stream.lastProgress else 0
