"""Streams: yearly metrics, quality states and generation over arriving files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from kumihimo.operators.quality import Constraint, cell_states, load_states


def arriving(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_events(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their summed value by window and type; a window closes after ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def append_states(stream: DataFrame, load_column: str, constraints: Sequence[Constraint], prepare: Callable[[DataFrame], DataFrame], states_path: str, checkpoint: str) -> None:
    """Quality states of every micro-batch, a folder per batch, so a repeated batch replaces its own.

    Reading the folder and merging gives the state of all that has arrived.
    """

    def write(batch: DataFrame, number: int) -> None:
        load_states(cell_states(prepare(batch), None, load_column, constraints)).write.mode("overwrite").parquet(f"{states_path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
