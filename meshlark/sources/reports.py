"""Report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshlark.sources.places import read_files, write_files


def report_path(path: Column) -> Column:
    """A path without the .json suffix is a folder and gets report.json inside it."""
    return F.when(F.endswith(path, F.lit(".json")), path).otherwise(F.concat(F.rtrim(path, F.lit("/")), F.lit("/report.json")))


def write_reports(reports: DataFrame, folder: str, key: str = "stem") -> None:
    """One JSON document per asset under ``folder/stem=.../``; the commit protocol makes each appear whole.

    Assets are spread by key first, so a task writes few folders at a time.
    """
    reports.repartition(key).write.mode("overwrite").partitionBy(key).json(folder)


def read_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def write_report_files(reports: DataFrame, path: Column, folder: str) -> None:
    """One JSON file per row at exactly ``report_path(path)``, below ``folder`` where that is relative.

    A report appears whole or not at all; rows of one path replace each other.
    """
    write_files(reports.select(report_path(path).alias("path"), F.encode(F.to_json(F.struct("*")), "UTF-8").alias("content")), folder)


def read_reports_at(paths: DataFrame, folder: str, schema: str) -> DataFrame:
    """path and the columns of ``schema`` of the reports that ``write_report_files`` wrote at ``report_path`` of ``path``."""
    found = read_files(paths.select(report_path(F.col("path")).alias("path")), folder)
    return found.select("path", F.from_json(F.decode("content", "UTF-8"), schema).alias("_report")).select("path", "_report.*")


def read_report_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every report below ``folder``. The driver lists them: for millions whose paths are known take ``read_reports_at``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(folder)
