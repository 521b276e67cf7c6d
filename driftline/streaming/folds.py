"""Moments of a stream: each batch is reduced to one state, and states are added up.

Training in several calls, as batches come. A batch's state is written under
its number, so a batch that is run again replaces its own; differences across
batches are lost unless the last rows of a batch come again in the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.moments import Moments, merge


def fold(stream: DataFrame, states: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Starts folding a stream of samples; states: a training mode bound to its options. The states' table is at path."""

    def batch(rows: DataFrame, number: int) -> None:
        states(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str, size: int) -> Moments:
    """The moments of all batches so far."""
    return merge(spark.read.schema("state array<double>, batch int").parquet(path).select("state"), size)


def windowed_deltas(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, user_id, n, mean, spread) of values in event time; for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
