"""Line dedup by distinct-site spread: which lines many sites share, and documents without them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.session import cut

BLANKS = " \t\r\u000b\f"
LG_K = 12


def _key(*parts) -> list[Column]:
    """Two 64-bit hashes: one key of 128 bits."""
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that is not blank: its document's key and id, its place, its own key (blanks at its ends don't count), the site."""
    split = docs.select(
        F.struct(*_key("doc_id", "text")).alias("doc"), "doc_id", F.col(site).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("place", "line"))
    bare = F.btrim("line", F.lit(BLANKS))
    return split.filter(bare != "").select("doc", "doc_id", "site", "place", F.struct(*_key(bare)).alias("line"))


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first_doc) of the lines on at least ``min_sites`` sites.

    HyperLogLog sketches of each line's sites merge by aggregation, so a line that a third of all rows hold is
    combined before the shuffle. Where the estimate is within three standard errors of the threshold (one site at
    least) the sites are counted exactly; only the others rest on the estimate.
    """
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first_doc"))
    margin = max(1, math.ceil(3 * 1.04 / math.sqrt(2**LG_K) * min_sites))
    estimated = cut(sketched.select("line", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).filter(
        F.col("sites") >= min_sites - margin), "line-sites")
    near = estimated.filter(F.col("sites") <= min_sites + margin)
    exact = lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(
        F.count("site").alias("exact")).filter(F.col("exact") >= min_sites)
    sure = estimated.filter(F.col("sites") > min_sites + margin).select("line", "first_doc")
    return cut(sure.union(near.join(exact, "line").select("line", "first_doc")), "widespread-lines")


def drop_widespread(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """Every row of ``docs`` as struct ``doc``, with its text without the lines that ``min_sites`` sites or more share.

    Adds ``clean`` (the new text), ``n_lines`` (lines that are not blank) and ``n_removed``. The document of the
    smallest id that has a widespread line keeps it, so that no line leaves the corpus. Blank lines stay. Null text
    stays null; a null site counts for no line; rows that are alike are treated alike; columns of other names stay
    in ``doc``. No text is shuffled but to meet the numbers of its removed lines.
    """
    bare = docs.select("doc_id", "text", F.col(site).alias("site"))
    lines = lines_of(bare, "site")
    flagged = widespread(lines, min_sites).select("line", F.col("first_doc"))
    removed = lines.join(flagged, "line").filter(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy("doc").agg(
        F.collect_set("place").alias("removed"))
    whole = docs.select(F.struct("*").alias("row"), F.struct(*_key("doc_id", "text")).alias("doc"))
    joined = whole.join(removed, "doc", "left")
    parts = F.split(F.col("row.text"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    joined = joined.select("row", "removed", F.when(F.col("removed").isNotNull(), parts).alias("parts"), F.when(
        F.col("removed").isNotNull(), kept).alias("kept"))
    clean = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get("parts", i)), "\n"))
    lines_in = F.size(F.filter(F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return joined.select(
        F.col("row").alias("doc"), clean.alias("clean"), lines_in.cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"))
