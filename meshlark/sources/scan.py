"""Finding asset files and reading their bytes or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _dotted(ext: str) -> str:
    return ext if ext.startswith(".") else f".{ext}"


def asset_scan(spark: SparkSession, folder: str, ext: str = ".glb", limit: int | None = None, recursive: bool = False) -> DataFrame:
    """path, length of the files in ``folder`` (or below it) with the extension, by path; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{_dotted(ext)}")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path", "length")
    )
    return files if limit is None else files.orderBy("path").limit(limit)


def asset_contents(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, content of model files."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path", "length", "content")
    )


def asset_lines(spark: SparkSession, folder: str, glob: str = "*.obj") -> DataFrame:
    """path, block, seq, value of text models.

    Files are split like any text input, so one huge model is read by many
    tasks: (block, seq) is a line's place, block the byte offset of its split
    and seq a number rising within it.
    """
    return (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"), "value",
        )
    )
