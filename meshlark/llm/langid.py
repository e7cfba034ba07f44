"""Language ID by rank-order profiles: out-of-place distance between a text's n-grams and each language's."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions.worker import once, ship

ship(__name__)
TOP = 300
ORDERS = 3
UNKNOWN = "und"
_PLACES = 1 << 40
_BITS, _EDGE = 21, 1  # a code point takes 21 bits; code 1, never a letter, stands for a word's edge


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three letters in the lower-cased text; word edges count as a letter of longer ones."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    letter = once("letters", _letters)[c]
    c = np.where(letter, c, np.uint64(_EDGE))
    c = np.concatenate(([np.uint64(_EDGE)], c, [np.uint64(_EDGE)]))
    c = c[np.concatenate(([True], (c[1:] != _EDGE) | (c[:-1] != _EDGE)))]
    if len(c) < 3:
        return np.empty(0, np.uint64)
    b = np.uint64(_BITS)
    pairs = c[:-1] << b | c[1:]
    triples = (pairs[:-1] << b | c[2:])[c[1:-1] != _EDGE]
    return np.concatenate((c[c != _EDGE], pairs, triples))


def top_grams(text: str) -> np.ndarray:
    """The most frequent n-grams first, ties in the order of their codes."""
    g, n = np.unique(grams(text), return_counts=True)
    return g[np.argsort(-n, kind="stable")[:TOP]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text))
        for lang, found in by.items():
            g, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """At most ``per_lang`` labelled (lang, text) rows of each language, those of the smallest hash of doc_id.

    Languages are counted first, so that the scan itself drops all rows but about twice as many as are wanted.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
    near = F.lit(False)
    for row in labelled.groupBy("lang").count().collect():
        most = min(_PLACES, _PLACES * 2 * per_lang // row["count"] + 1)
        near = near | ((F.col("lang") == row.lang) & (place < most))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return labelled.filter(near).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_lang).select("lang", "text")


def train(docs: DataFrame, per_lang: int = 1000) -> dict[str, list[int]]:
    """Each language's profile: its ``TOP`` most frequent n-grams, learned from (doc_id, text, lang).

    The training texts are a bounded sample (``per_lang`` whole texts a language); rows without lang or text
    teach nothing. Counting and ranking run in Spark; what reaches the driver is TOP numbers a language.
    """
    counted = sample(docs, per_lang).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP)
    found: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "place").collect():
        found.setdefault(row.lang, []).append(row.gram)
    return found


class Distances:
    """Out-of-place distances to a set of profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.uint64)), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name on ties), and 1 less the distance's share of the largest possible."""
        top = top_grams(text) if text else ()
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != top] = len(self.grams)
        theirs = self.ranks[at]
        out = np.where(theirs < 0, TOP, np.abs(theirs - np.arange(len(top))[:, None])).sum(axis=0)
        k = int(out.argmin())
        return self.langs[k], 1.0 - float(out[k]) / (TOP * len(top))


def predictor(spark, profiles: dict[str, list[int]]):
    """A function of a text column to a struct (lang, score). Null text, or text without a letter: ``und``, 0."""
    shared = spark.sparkContext.broadcast(profiles)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Distances(shared.value)
        for part in texts:
            yield pa.array([dict(zip(("lang", "score"), model.predict(x.as_py()), strict=True)) for x in part], kind)

    return predict


def held_out(doc_id: Column) -> Column:
    """A quarter of all documents, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, from its whole text alone; other columns are dropped."""
    guess = predictor(docs.sparkSession, profiles)(F.col("text"))
    return docs.select("doc_id", guess.alias("_guess")).select(
        "doc_id", F.col("_guess.lang").alias("lang_pred"), F.col("_guess.score").alias("score"))


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], least: float = 0.2) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least the score ``least``."""
    guess = predictor(docs.sparkSession, profiles)(F.col("text"))
    return docs.select(F.struct("*").alias("_doc"), guess.alias("_guess")).filter(
        (F.col("_guess.lang") != UNKNOWN) & (F.col("_guess.score") >= least)).select("_doc.*")
