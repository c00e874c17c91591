"""Incremental loading: new files of speeches are merged into a table in small batches (E14 as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folkmoot.operators.keyed import KeyedTable
from folkmoot.operators.tables import upsert_utterances

KEY = ["meeting_id", "position_in_meeting"]


def stream_utterances(spark: SparkSession, source: str, schema: StructType, table_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Adds speeches from new files whose (meeting_id, position_in_meeting) the table lacks.

    The table lies in buckets of that key, and a batch reads and writes the buckets of its own speeches only. A merge gives
    the same when it is repeated, so a batch that a restart runs again adds nothing twice. A speech is never too late.
    """
    table = KeyedTable.open(spark, table_path, schema, KEY, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, upsert_utterances)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
