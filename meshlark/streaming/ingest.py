"""Incremental ingest: each file or row is handled once, in chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.glb", batch_size: int = 1) -> DataFrame:
    """New model files below ``folder``, ``batch_size`` per micro-batch."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", batch_size)
        .load(folder)
    )


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, batch_size: int = 1) -> DataFrame:
    """New parquet files of the table ``name`` in ``folder``, ``batch_size`` per micro-batch; the table is a file or a folder of part files.

    The last letter stands as a pattern of itself: Spark streams what a pattern names, of either kind, while a plain
    path has to be a folder.
    """
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_size).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    )


def run_ingest(source: DataFrame, report: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Report on everything new and stop; what the checkpoint has seen is not done again.

    A batch owns the folder of its number and overwrites it, so a batch run
    twice after a failure leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
