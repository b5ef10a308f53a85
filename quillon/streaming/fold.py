"""Structured Streaming twins of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events


def read_log(spark: SparkSession, path: str, schema: str = events.SCHEMA) -> DataFrame:
    """A stream of an append-only JSON log; records that were torn are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def fold_stream(stream: DataFrame, name: str, checkpoint: str, by: str = "tool", ok=None) -> DataFrame:
    """Everything there is, folded in micro-batches; equal to the batch fold.

    Each batch replaces the table beside the checkpoint, so groups stay with the
    executors. A stream without a batch gives an empty table.
    """
    folded, path = events.fold(stream, by, ok), f"{checkpoint}-{name}"

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    folded.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(folded.schema).option("ignoreMissingFiles", "true").parquet(path)


def windowed(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def first_of_session(stream: DataFrame, ts: str, late: str, key: str = "session") -> DataFrame:
    """One row a session within the watermark, so that state is bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def maintain(stream: DataFrame, apply, checkpoint: str) -> None:
    """Runs a change-set update on each micro-batch until all is read."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
