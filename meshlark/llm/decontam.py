"""Benchmark decontamination by spaced seeds: masked hashes find where, aligned words decide whether."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions.worker import once, ship
from meshlark.llm.held import Held
from meshlark.session import cut

ship(__name__)
#: Places of a seed that count; the others may be anything. Of any eight places of twelve or fewer, five are the counted
#: places of one of these masks, so every stretch that the alignment accepts has a seed (a test tries all of them).
MASKS = [
    "111011", "11001011", "110100011", "1100010011", "101111", "1110000101", "11010101", "1001100011", "1010010011", "100101011", "10010111",
]
SPAN = 12
ENOUGH = 8  # equal words of SPAN that make a stretch
LONG = 13  # words of one stretch that are a leak, whatever their share of the item
LEAST_WORDS = 8  # shorter benchmark items say too little to be looked for
PROBES = 4
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
HELD = 200_000
_WORDS = re.compile(r"[^\W_]+")


def _hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "replace"))


def word_hashes(text: str) -> np.ndarray:
    words = _WORDS.findall(text.lower())
    hashes = once("word-hashes", lambda: Held(_hash, HELD))
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all of ``x``."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the counted places of every window."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2) * 2654435761 + len(mask), dtype=np.uint64)
    for k, counts in enumerate(mask):
        if counts == "1":
            out = (out + words[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(out)


def _bit(found: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Places of hashes in a Bloom filter of 2 ** size bits, independent for each probe."""
    return mixed(found * _FACTORS[probe]) >> np.uint64(64 - size)


def test_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, place): every masked hash of every benchmark item of enough words, with the item's words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words = word_hashes(text or "")
                if len(words) < LEAST_WORDS:
                    continue
                for mask in MASKS:
                    found = seeds(words, mask)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(found.astype(np.int64)), pa.array([item] * len(found), pa.int64()), pa.array(np.arange(len(found))),
                        pa.array([len(words)] * len(found), pa.int64())], ["seed", "item", "place", "n_words"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(make, "seed long, item long, place long, n_words long")


def bloom(found: DataFrame, most_bits: int = 28) -> tuple[np.ndarray, int]:
    """A Bloom filter of the test seeds: 64 bits a seed, 2 ** 28 (32 MB) at most. It spares work; joins decide."""
    n = found.count()
    size = min(most_bits, max(16, (64 * n - 1).bit_length() if n else 16))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for probe in range(PROBES):
                at = _bit(batch.column(0).to_numpy().astype(np.uint64), probe, size)
                words, where = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(words), np.uint64)
                np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.astype(np.int64))], ["word", "bits"])

    rows = found.select("seed").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << size - 6, np.uint64)
    for word, bits in rows.toLocalIterator():
        out[word] = np.uint64(bits % 2**64)
    return out, size


def _hits(shared: Broadcast):
    """Documents with a place that may be a test seed: their words and those places."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = shared.value
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                texts = [word_hashes(x or "") for x in part.column(2).to_pylist()]
                ends = np.cumsum([len(x) for x in texts])
                words = np.concatenate(texts)
                left = np.repeat(ends, [len(x) for x in texts]) - np.arange(len(words))  # words of the text from here on
                hits: dict[int, list] = {}
                for mask in MASKS:
                    found = seeds(words, mask)
                    at = np.flatnonzero(left[:len(found)] >= len(mask))
                    found = found[at]
                    for probe in range(PROBES):
                        bit = _bit(found, probe, size)
                        ok = (held[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                        found, at = found[ok], at[ok]
                    for k, seed, place in zip(np.searchsorted(ends, at, side="right").tolist(), found.astype(np.int64).tolist(), at.tolist(), strict=True):
                        hits.setdefault(k, []).append({"seed": seed, "at": place - int(ends[k]) + len(texts[k])})
                out = [{
                    "key": part.column(0)[k].as_py(), "doc": part.column(1)[k].as_py(), "words": texts[k].astype("<u8").tobytes(), "hits": found,
                } for k, found in hits.items()]
                if out:
                    yield pa.RecordBatch.from_pylist(out, _HITS)

    return search


_HITS = pa.schema([
    ("key", pa.binary()), ("doc", pa.int64()), ("words", pa.binary()),
    ("hits", pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())])))])


def matched(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int]:
    """Words of the item that stand in the document in a stretch (ENOUGH equal of SPAN) at one of the shifts: all, and most of one stretch."""
    held = np.zeros(len(item), bool)
    longest = 0
    span = min(SPAN, len(item))
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        if hi - lo < span:
            continue
        equal = np.zeros(len(item), bool)
        equal[lo:hi] = item[lo:hi] == doc[lo + shift:hi + shift]
        before = np.concatenate(([0], np.cumsum(equal)))
        good = before[span:] - before[:-span] >= min(ENOUGH, span)  # by the window's start
        near = np.zeros(len(item) + 1, np.int64)
        np.add.at(near, np.flatnonzero(good), 1)
        np.add.at(near, np.flatnonzero(good) + span, -1)
        inside = np.cumsum(near)[:-1] > 0
        held |= equal & inside
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        if len(starts):
            longest = max(longest, int(np.add.reduceat((equal & inside).astype(np.int64), starts).max()))
    return int(held.sum()), longest


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for words, item_words, shifts in zip(*(batch.column(x).to_pylist() for x in ("words", "item_words", "shifts")), strict=True):
            n.append(matched(np.frombuffer(words, "<u8"), np.frombuffer(item_words, "<u8"), shifts))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ("key", "doc", "item", "n_words")), *(pa.array([x[k] for x in n], pa.int64()) for k in range(2))],
            ["key", "doc_id", "item_id", "item_words", "matched", "longest"])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [word_hashes(x or "").astype("<u8").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["item", "item_words"])


def _row_key(docs: DataFrame) -> Column:
    """What tells rows of documents apart: the hash of doc_id and text. Rows without a text have none."""
    doc_id = F.coalesce(F.hex(docs["doc_id"].cast("long")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(doc_id, F.lit("/"), docs["text"]), 256))


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, item_words, matched, overlap): the documents that hold ``share`` of an item's words or more,
    or LONG words of it in one stretch.

    A word is lower-cased letters and digits. Every window of items and of whole documents is hashed under masks that
    count five places and ignore others, so a hit survives substituted words; windows meet by a join on the hash. Each
    pair found is then aligned at the shifts of its hits: words count that are equal in place and in a stretch of
    twelve (or all of a shorter item) with eight equal ones. The masks hit every such stretch, wherever its unequal
    words are. Items of under eight words are not looked for. An item_id of several rows stands for all of its texts;
    repeated documents give one row.

    A Bloom filter of the test seeds, of 32 MB at most, keeps documents without any hit from being moved. Null
    texts hold nothing; other columns are dropped.
    """
    best = _leaks(docs, items, share)
    return best.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "matched", "item_words")).alias("b")).select(
        "doc_id", "item_id", "b.item_words", "b.matched", "b.overlap")


def _leaks(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """(key, doc_id, item_id, item_words, matched, longest, overlap) of the leaks of each distinct row of documents."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull()).distinct()
    found = cut(test_seeds(items), "test-seeds")
    shared = spark.sparkContext.broadcast(bloom(found))
    rows = docs.filter(F.col("text").isNotNull()).select(_row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit_docs = cut(rows.mapInArrow(
        _hits(shared), "key binary, doc long, words binary, hits array<struct<seed:long,at:long>>"), "hit-documents")
    shared.unpersist()
    hits = hit_docs.select("key", F.explode("hits").alias("hit")).select("key", F.col("hit.seed").alias("seed"), F.col("hit.at").alias("at"))
    pairs = hits.join(found, "seed").groupBy("key", "item", "n_words").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    words = items.mapInArrow(_items, "item long, item_words binary").withColumn("n_words", (F.octet_length("item_words") / 8).cast("long"))
    whole = pairs.join(hit_docs.select("key", "doc", "words").dropDuplicates(["key"]), "key").join(words, ["item", "n_words"])
    checked = whole.select("key", "doc", "item", "n_words", "words", "item_words", "shifts").mapInArrow(
        _verify, "key binary, doc_id long, item_id long, item_words long, matched long, longest long")
    return checked.withColumn("overlap", F.col("matched") / F.col("item_words")).filter((F.col("overlap") >= share) | (F.col("longest") >= LONG))


def drop_leaks(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose own text holds a benchmark item.

    Other rows of the same doc_id, or of a null one, stay.
    """
    leaks = cut(_leaks(docs, items, share).select(F.col("key").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, _row_key(docs) == leaks["_leak"], "left_anti")
