"""Multiset digests of streams.

Two ways to keep the state. :func:`stream_multiset` is a streaming aggregation
with the state in Spark's checkpointed store. :func:`stream_state_log` keeps
none: every micro-batch adds its partial state to a log, and the digest at any
time is the merge of the log. A replayed batch overwrites its own entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.multiset import STATE, merge_states, multiset_state


def stream_multiset(stream: DataFrame, cols: Sequence[str], idx: str | None = None, by: Sequence[str] = (),
                    sign: Column | None = None) -> DataFrame:
    """Streaming state per group, for the ``complete`` and ``update`` modes."""
    return multiset_state(stream, cols, idx, by, sign)


def stream_state_log(stream: DataFrame, path: str, checkpoint: str, cols: Sequence[str], idx: str | None = None,
                     by: Sequence[str] = (), trigger: dict | None = None):
    """Start the query that logs one partial state per group and micro-batch."""

    def add(batch: DataFrame, batch_id: int) -> None:
        multiset_state(batch, cols, idx, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_state_log(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """State per group over all batches logged so far."""
    return merge_states(spark.read.parquet(path).select(*by, *STATE), by)


def stream_latest(states: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start the query that keeps the newest complete states as a table.

    Every micro-batch replaces its own folder; :func:`read_latest` takes the
    last one.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (states.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch").alias("batch")).scalar()
    return rows.where(F.col("batch") == newest).drop("batch")
