"""Idempotent skip over an unbounded ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def first_successes(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first success of each (item, step); later ones within ``delay`` of it are dropped and its state then freed."""
    return (
        ledger.withColumn("ts", F.col("ts").cast("timestamp"))
        .filter("success")
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["item_id", "step_key"])
    )


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all that is available to a parquet table and stop."""
    return (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
