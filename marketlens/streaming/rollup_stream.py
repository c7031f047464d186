"""Streaming maintenance of the channel-month roll-up.

Each micro-batch of new order-event files is aggregated to partial states as
it arrives (``foreachBatch``), written to a folder of its own and published by
one log entry that adds the folder with the batch's number. ``foreachBatch`` is
at-least-once; a batch that is replayed finds its number in the log and changes
nothing, so the states never double count. When ``compact_every`` folders have
gathered, the batch that finds them merges them into one; readers and other
writers go on meanwhile. There is no event-time bound in this roll-up, so no
watermark: every order counts whenever it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from marketlens.operators.rollup import STATES, compact, merge_states, partial_states, read_load
from marketlens.sources import manifest
from marketlens.sources.staging import ORDER_EVENTS

EVENT_FILES = StructType(ORDER_EVENTS.fields + [StructField("yyyymm", IntegerType(), True)])


def publish_batch_states(root: str, stream: str, compact_every: int | None = 16):
    """The ``foreachBatch`` sink: partial states of one batch, published once."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if manifest.known(manifest.current(spark, root), stream, batch_id):
            return
        path = manifest.new_folder(root, STATES)
        partial_states(batch).write.parquet(path)
        manifest.commit(spark, root, lambda now: now.folders | {STATES: [*now.folders.get(STATES, []), path]},
                        load=(stream, batch_id))
        if compact_every and len(manifest.current(spark, root).folders[STATES]) >= compact_every:
            compact(spark, root)
    return sink


def start_rollup_stream(spark: SparkSession, events_path: str, root: str, checkpoint_path: str, stream: str,
                        max_files_per_trigger: int | None = None, available_now: bool = True,
                        compact_every: int | None = 16) -> StreamingQuery:
    """Start the roll-up stream over a (month-partitioned) events folder; ``stream`` names its batches in the log."""
    reader = spark.readStream.schema(EVENT_FILES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    source = reader.parquet(events_path)
    writer = (source.writeStream.foreachBatch(publish_batch_states(root, stream, compact_every))
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    """R4 over the streamed states."""
    return merge_states(read_load(spark, root)[1])
