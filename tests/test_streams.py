"""Streams against the batch operators: late and repeated rows, restarts, and what the state holds."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folkmoot.operators import aggregates
from folkmoot.streaming import sessions
from folkmoot.streaming.incremental import stream_utterances

START = datetime(2024, 1, 1)
TURN = "turn_id long, conv long, ts timestamp"


def at(hours):
    return START + timedelta(hours=hours)


def sorted_rows(df):
    return sorted(map(str, df.select("conv", "first", "last", "turns").collect()))


def test_sessions_of_a_batch(spark):
    turns = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(2)), (3, 1, at(4.5)), (4, 1, at(4.5)), (5, 2, at(-3)), (6, 2, None), (7, None, at(1))], TURN)
    got = {(r.conv, r["first"], r["last"], r.turns) for r in aggregates.conversation_sessions(turns, "conv", "ts", 2).collect()}
    # A pause of just two hours ends no session.
    assert got == {(1, at(0), at(2), 2), (1, at(4.5), at(4.5), 2), (2, at(-3), at(-3), 1), (None, at(1), at(1), 1)}
    assert aggregates.conversation_sessions(turns.limit(0), "conv", "ts", 2).count() == 0
    windows = turns.groupBy(F.session_window("ts", "2 hours"), "conv").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("turns"))
    assert sorted_rows(windows) == sorted_rows(aggregates.conversation_sessions(turns, "conv", "ts", 2))
    hot = spark.range(20_000).select(F.col("id").alias("turn_id"), F.lit(1).alias("conv"), (F.lit(START) + F.make_dt_interval(mins=(F.col("id") % 3000).cast("int"))).alias("ts"))
    assert [r.turns for r in aggregates.conversation_sessions(hot, "conv", "ts", 2).collect()] == [20_000]


def test_sessions_of_a_stream(spark, tmp_path):
    src, sink, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    step = lambda n, hour, convs: [(1000 * n + c, c, at(hour + c / 60)) for c in convs]
    loads = [
        step(1, 0, range(20)) + step(1, 0, range(5)),  # some turns twice in one file
        step(2, 1, range(10)) + step(1, 0, range(3)),  # and some again in the next, still in time
        step(3, 9, range(20, 30)),
        step(4, 0, range(7)) + step(5, 10, range(20, 25)),  # seven turns come far too late
        step(6, 40, [99]),
        [],
    ]
    late, held = 0, []
    for n, rows in enumerate(loads):
        spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").json(src)
        turns = spark.readStream.schema(TURN).json(src)
        stream = sessions.stream_sessions(turns, ["turn_id"], "conv", "ts", 3, "2 hours", sink, chk)  # a restart each time
        stream.awaitTermination()
        late += sessions.late_rows(stream)
        held.append(sessions.state_rows(stream))
    in_time = [r for n, rows in enumerate(loads) for r in rows if not (n == 3 and r[0] < 5000)]
    batch = aggregates.conversation_sessions(spark.createDataFrame(in_time, TURN).dropDuplicates(["turn_id"]), "conv", "ts", 3)
    assert sorted_rows(spark.read.parquet(sink)) == sorted_rows(batch.filter(F.col("conv") != 99))  # 99 may still go on
    assert late == 7 and held[-1] <= 2, (late, held)  # the last turn and its session
    assert spark.read.parquet(sink).count() == 30


def test_speeches_of_a_stream_touch_their_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], "meeting_id long, position_in_meeting int, text string").schema
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))

    def load(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        stream_utterances(spark, src, schema, out, chk, buckets=32).awaitTermination()
        return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(out) for f in names if f.endswith(".parquet")}

    many = [(m, p, f"{m} {p}") for m in range(40) for p in range(5)]
    first = load(many)
    assert load(many) == first  # the same speeches again, in a new file
    second = load([(3, 1, "changed"), (3, 77, "new"), (3, 77, "new"), (None, 1, "of no meeting")])
    changed = {f.split("bucket=")[1].split("/")[0] for f, _ in set(first.items()) ^ set(second.items())}
    assert 1 <= len(changed) <= 2
    got = {(r.meeting_id, r.position_in_meeting, r.text) for r in spark.read.schema(schema).parquet(out).collect()}
    assert got == {*many, (3, 77, "new"), (None, 1, "of no meeting")}
