"""From raw documents to token ids: language ID, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of ``docs``. Between
stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import bpe, decontam, langid, linededup, neardup
from meshlark.session import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the profiles tell; those without letters, or far from every profile, go."""
    profiles = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, profiles)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that many sources share; n_chars follows the text."""
    cleaned = linededup.drop_widespread(docs)
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return cleaned.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and their decoding, by their figures."""
    files = bpe.Files(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digest(docs, files)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode),
]

#: Profiles, signatures and merges are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
