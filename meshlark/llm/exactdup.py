"""Exact dedup by block naming: sorted blocks become integers, pairs of neighbours become integers again, until a text is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.session import cut

SPACES = " \t\n\u000b\f\r"
BLOCK = 2048  # bytes


def _blocks(text: Column, block: int) -> Column:
    """The text's UTF-8 bytes in blocks of a fixed size, the last one shorter; none of an empty text."""
    n = F.octet_length(text)
    places = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    raw = text.cast("binary")
    return F.transform(places, lambda k: F.substring(raw, k * block + 1, block))


def _named(cells: DataFrame, *content: str) -> DataFrame:
    """(content, name): every different content once, with an integer that no other has.

    Equal contents meet in one task by their hash and are combined before; there the different ones are sorted, and
    their task and rank are the name. The table is written, so the names stay what they are if an executor is lost.
    """
    distinct = cells.select(*content).distinct().sortWithinPartitions(*content)
    return cut(distinct.select(*content, F.monotonically_increasing_id().alias("name")), "names")


def _named_blocks(cells: DataFrame) -> DataFrame:
    """(row, n, place, name) of (row, n, place, hash, block): names as by ``_named``, with each block's bytes moved only once.

    The different blocks of each hash are gathered, sorted and named. Where a hash has a single block it stands for it
    in the join that brings the names back; the blocks of other hashes are compared themselves.
    """
    gathered = cells.groupBy("hash").agg(F.collect_set("block").alias("blocks"))
    each = gathered.select("hash", (F.size("blocks") > 1).alias("clash"), F.explode("blocks").alias("block")).sortWithinPartitions("block")
    names = cut(each.select("hash", F.when(F.col("clash"), F.col("block")).alias("block"), F.monotonically_increasing_id().alias("name")), "names")
    named = cells.select("row", "n", "place", "hash").join(names.filter("block IS NULL").select("hash", "name"), "hash").select("row", "n", "place", "name")
    clashes = cut(names.filter("block IS NOT NULL"), "clashes")
    if not clashes.isEmpty():
        named = named.unionByName(cells.join(clashes, ["hash", "block"]).select("row", "n", "place", "name"))
    return cut(named, "cells")


def identities(rows: DataFrame, hashed: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(row, level, name) of (row, blocks): two rows have the same level and name if and only if their blocks are equal.

    Blocks are named first; then, level by level, each pair of neighbouring names, a last one without neighbour being
    a pair of its own kind. A row whose names have become one is done. Levels are as many as the logarithm of the
    longest row's blocks. Rows without blocks have level -1. Names hold for this run alone. ``hashed`` only brings
    equal blocks together; how many others share a hash makes no difference to the result.
    """
    done = rows.filter(F.size("blocks") == 0).select("row", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))
    cells = rows.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("place", "block")).withColumn("hash", hashed("block"))
    cells, level = _named_blocks(cells), 0
    while True:
        done = done.union(cells.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        more = cells.filter("n > 1")
        if more.isEmpty():
            return done
        of_side = lambda k: F.max(F.when(F.col("place") % 2 == k, F.col("name")))
        pairs = more.groupBy("row", "n", F.floor(F.col("place") / 2).alias("place")).agg(
            of_side(0).alias("left"), F.coalesce(of_side(1), F.lit(-1).cast("long")).alias("right"))
        names = _named(pairs, "left", "right")
        cells = cut(pairs.join(names, ["left", "right"]).select(
            "row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "place", "name"), "cells")
        level += 1


def _judged(docs: DataFrame, block: int, *carried: Column) -> DataFrame:
    """``exact_duplicates`` with the carried columns of each row."""
    text = F.coalesce("text", F.lit(""))
    bare = docs.select("doc_id", F.length(text).cast("long").alias("size"), F.translate(text, SPACES, "").alias("bare"), *carried)
    rows = cut(bare.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "size", F.sha2("bare", 256).alias("text_sha256"),
        _blocks(F.col("bare"), block).alias("blocks"), *bare.columns[3:]), "blocks")
    known = cut(identities(rows.select("row", "blocks")).join(rows.select("row", "doc_id", "size"), "row"), "identities")
    best = F.min(F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = cut(known.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    placed = known.join(groups, ["level", "name"]).select(
        "row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"))
    return placed.join(rows.drop("size", "blocks"), "row").drop("row")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of (doc_id, text).

    Texts are equal if they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Of equal texts the row
    stays whose original text has the most code points, then the smallest doc_id; a null doc_id comes last, and of
    rows that are alike in both one stays. ``keep_id`` is that row's doc_id, ``text_sha256`` the digest of the
    normalised text. Equality is decided by comparing blocks and names, never by the digest.

    A null text counts as empty; empty and blank texts are one group. Texts of any length are cut into blocks, which
    many tasks name. An empty table gives no rows. Columns other than doc_id and text are dropped.
    """
    return _judged(docs.select("doc_id", "text"), block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_duplicates`` keeps: one of each group."""
    return _judged(docs, block, F.struct("*").alias("_doc")).filter("kept").select("_doc.*")
