"""Near-duplicate documents by DartMinHash of weighted five-word shingles, banded joins and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions.worker import ship
from meshlark.llm.decontam import mixed, seeds, word_hashes
from meshlark.session import cut

ship(__name__)
WORDS = 5
COORDS = 256  # of a signature
ROWS, BANDS = 4, 24  # the first ROWS * BANDS coordinates make the bands
#: Darts thrown before the first look whether every coordinate has one: k ln k + 2 k.
DARTS = int(COORDS * np.log(COORDS) + 2 * COORDS)
#: Of 256 coordinates' last four bits, two texts of similarity 0.8 differ in 48 on average, with a standard deviation
#: of 6.2; more differences than this, five deviations off, are taken for a similarity below 0.8.
MOST_DIFFERENT = 80
BLOCK = 1024  # rows of a band that a task compares with as many others
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def units(text: str) -> np.ndarray:
    """The text's weighted shingles as a sorted set of hashes: a shingle of weight w is w units.

    The weighted Jaccard similarity of two texts is the plain one of their units. A text of one to four words is a
    single shingle; one without words has none.
    """
    words = word_hashes(text)
    if len(words) == 0:
        return np.empty(0, np.uint64)
    found = np.sort(seeds(words, "1" * min(WORDS, len(words))))
    fresh = np.concatenate(([True], found[1:] != found[:-1]))
    if fresh.all():
        return found
    starts = np.flatnonzero(fresh)
    nth = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    return np.sort(np.where(nth == 0, found, mixed(found + nth.astype(np.uint64) * _A)))


def _unit_interval(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signature(u: np.ndarray) -> np.ndarray:
    """For each coordinate the earliest dart that hit the set's region: equal with the probability of the similarity.

    The region of a unit is a strip along time. Darts fall on it as a Poisson process that the hash of (unit, cell
    of time) alone decides, one a cell on average, and each dart belongs to one coordinate by its hash. Cells are
    looked at in order of time until every coordinate has a dart: about DARTS darts, or one for each unit of a
    longer text, whatever the number of coordinates.
    """
    best = np.zeros(COORDS, np.uint64)
    done = np.zeros(COORDS, bool)
    first, cells = 0, max(1, -(-DARTS // len(u)))
    while not done.all():
        times = np.arange(first, first + cells, dtype=np.uint64)
        cell = mixed(u[None, :] + (times[:, None] + np.uint64(1)) * _B)
        n = np.searchsorted(_POISSON, _unit_interval(mixed(cell)), side="right")
        at, where = np.nonzero(n)
        n = n[at, where]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        darts = mixed(np.repeat(cell[at, where], n) + (nth.astype(np.uint64) + np.uint64(1)) * _C)
        time = np.repeat(at, n) + _unit_interval(mixed(darts + _A))
        coord = (darts % np.uint64(COORDS)).astype(np.int64)
        late_first = np.argsort(-time, kind="stable")
        new = np.zeros(COORDS, np.uint64)
        hit = np.zeros(COORDS, bool)
        new[coord[late_first]] = darts[late_first]
        hit[coord] = True
        take = hit & ~done
        best[take] = new[take]
        done |= hit
        first, cells = first + cells, cells
    return best


_SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.binary()), ("n", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
SIGNED = "doc_id long, th long, node binary, n long, bands array<long>, sketch array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    for batch in batches:
        for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            nodes, ns, bands, sketches = [], [], [], []
            for text in part.column(2).to_pylist():
                u = units(text or "")
                ns.append(len(u))
                nodes.append(np.array([mixed(u).sum(), mixed(u ^ _C).sum()], dtype="<u8").tobytes())
                if len(u) == 0:
                    bands.append([])
                    sketches.append([])
                    continue
                sig = signature(u)
                rows = mixed(sig[:ROWS * BANDS]).reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    key = mixed(key * _B + rows[:, k])
                bands.append(key.astype(np.int64))
                low = (mixed(sig) & np.uint64(15)).reshape(16, 16)
                sketches.append((low << shifts).sum(axis=1, dtype=np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(ns, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], schema=_SIGNED)


def _different(a: str, b: str) -> Column:
    """In how many coordinates two sketches differ."""
    out = F.lit(0)
    for k in range(16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def _plausible(least: float) -> Column:
    """Whether rows with n_a, n_b, sketch_a, sketch_b may be as similar as ``least``: sizes (exactly), then sketches."""
    return (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")) & (_different("sketch_a", "sketch_b") <= MOST_DIFFERENT)


def _marked(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}_{side}") for c in columns))


def _star(keyed: DataFrame) -> DataFrame:
    """(key, node) to (node_a, node_b): each node of a key with the key's smallest one."""
    firsts = keyed.groupBy("key").agg(F.min("node").alias("node_b"), F.max("node").alias("last")).filter("node_b != last").drop("last")
    return keyed.join(firsts, "key").filter(F.col("node") != F.col("node_b")).select(F.col("node").alias("node_a"), "node_b")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _parted_links(least: float):
    """Links between the rows of two blocks that join different labels, the nearest pairs by sketch tried first.

    A pair whose labels a link of these rows has joined already is not compared, nor one that shares an earlier band.
    """

    def compare(rows: pa.Table) -> pa.Table:
        numbers = {c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(rows), -1) for c in ("sketch", "bands")}
        sketch, bands = numbers["sketch"].view(np.uint64), numbers["bands"]
        n, block = rows.column("n").to_numpy(), rows.column("block").to_numpy()
        _, label = np.unique(np.array([x.hex() for x in rows.column("label").to_pylist()]), return_inverse=True)
        key, lo, hi = (rows.column(c)[0].as_py() for c in ("key", "lo", "hi"))
        ours, theirs = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = []
        for k, i in enumerate(ours):
            js = theirs[k + 1:] if lo == hi else theirs
            js = js[(label[js] != label[i]) & (np.minimum(n[js], n[i]) >= least * np.maximum(n[js], n[i]))]
            x = sketch[js] ^ sketch[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            different = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
            ok = (different <= MOST_DIFFERENT) & (bands[i][(bands[js] == bands[i]).argmax(axis=1)] == key)
            found += [(d, int(i), int(j)) for d, j in zip(different[ok].tolist(), js[ok], strict=True)]
        joined = list(range(label.max() + 1))
        held: dict[int, np.ndarray] = {}

        def root(k: int) -> int:
            while joined[k] != k:
                joined[k] = k = joined[joined[k]]
            return k

        out = []
        for _, i, j in sorted(found):
            a, b = root(label[i]), root(label[j])
            if a != b:
                for k in (i, j):
                    if k not in held:
                        held[k] = units(rows.column("text")[k].as_py())
                if _alike(held[i], held[j], least):
                    joined[a] = b
                    out.append({"node_a": rows.column("node")[i].as_py(), "node_b": rows.column("node")[j].as_py()})
        return pa.Table.from_pylist(out, pa.schema([("node_a", pa.binary()), ("node_b", pa.binary())]))

    return compare


def parted_links(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node_a, node_b), verified, for rows of (key, node, label, n, sketch, bands): what joins labels that meet in a key.

    A key's rows are dealt into blocks of about BLOCK by the node's hash, and every two blocks of a key are compared
    in a task of their own, which holds no more than those.
    """
    blocks = F.ceil(F.col("rows") / BLOCK)
    dealt = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key").join(texts, "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = dealt.select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label", "n", "sketch", "bands", "text")
    return met.groupBy("key", "lo", "hi").applyInArrow(_parted_links(least), "node_a binary, node_b binary")


def _similar(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                keep = []
                for node, a, b in zip(part.column("node_b").to_pylist(), part.column("text_a"), part.column("text_b"), strict=True):
                    if node != last:
                        last, held = node, units(b.as_py())
                    u = units(a.as_py())
                    keep.append(_alike(u, held, least))
                yield part.select(["node_a", "node_b"]).filter(pa.array(keep, pa.bool_()))

    return compare


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (node_a, node_b) pairs whose (node, text) are as similar as ``least``, compared exactly."""
    met = pairs.select("node_a", "node_b").join(_marked(texts, "a", "node", "text"), "node_a").join(_marked(texts, "b", "node", "text"), "node_b")
    return met.select("node_a", "node_b", "text_a", "text_b").mapInArrow(_similar(least), "node_a binary, node_b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each linked component. Nodes without a link are left out.

    Each round takes the smallest label among a node and its neighbours, then that label's own label; rounds go on
    until nothing changes, and are as many as the logarithm of a chain's length. Each is a table in the shared folder.
    """
    both = cut(links.select(F.col("node_a").alias("node"), F.col("node_b").alias("other")).union(
        links.select("node_b", "node_a")).distinct(), "links")
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        own = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = cut(lower.join(own, "next").select("node", "label", F.least("next", "jump").alias("next")), "labels")
        labels = step.select("node", F.col("next").alias("label"))
        if step.filter("label != next").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, th, class_id, component) for every row of (doc_id, text): rows of one class are linked by near-duplicate texts.

    Texts are alike if the weighted Jaccard similarity of their five-word shingles is ``least`` or more; a class is
    a component of that relation, named by its smallest doc_id. ``th`` is the hash of the row's text, ``component`` tells classes apart where
    doc_ids are null or repeated.

    Rows with the same shingles are one node from the start, so exact copies, however many, are never paired.
    Nodes that share a band of the signature meet by joins on the band's hash: first each with the smallest node of
    the band, and of two bands together; then, once components are known, those nodes of a band that are still in
    different components, block by block, where sizes and sketches allow ``least``. Every link is verified on the texts.
    Two texts of similarity 0.8 share none of 24 bands once in 300,000 times, and are held for less alike by their
    sketches once in three million; the more alike, the rarer. What is left to compare after the first links grows
    with the square of the texts that share a band without belonging together.

    Null and empty texts, or texts without words, are classes of their own, each row by its doc_id; a null doc_id
    counts as the smallest of a class only if there is no other. Other columns are dropped.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = cut(texts.mapInArrow(_sign, SIGNED), "signatures")
    nodes = cut(signed.filter("n > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("home"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")).select("node", "n", "bands", "sketch", "home.doc_id", "home.th"), "texts")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first != last").select("key")
    keyed = cut(keyed.join(shared, "key"), "shared-bands")
    crowd = cut(nodes.join(keyed.select("node").distinct(), "node"), "crowd")
    home = crowd.select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    held = cut(texts.join(home, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("node", "text").dropDuplicates(
        ["node"]), "crowd-texts")
    doubled = crowd.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(
        k, F.get("bands", k), F.get("bands", (k + 1) % BANDS)))).alias("key"))
    pairs = _star(keyed).union(_star(doubled)).distinct()
    sized = crowd.select("node", "n", "sketch")
    stars = pairs.join(_marked(sized, "a", *sized.columns), "node_a").join(_marked(sized, "b", *sized.columns), "node_b").filter(_plausible(least))
    links = cut(verified(stars, held, least), "near-links")
    labels = components(links)
    placed = keyed.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parted = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    rows = cut(placed.join(parted, "key").join(crowd.select("node", "n", "sketch", "bands"), "node"), "parted-bands")
    more = cut(parted_links(rows, held, least), "near-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    of_node = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    named = of_node.join(of_node.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("node", "class_id", F.col("label").alias("component"))
    worded = signed.filter("n > 0").select("doc_id", "th", "node").join(named, "node").select("doc_id", "th", "class_id", "component")
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("/"), F.col("th").cast("string")).cast("binary")
    return worded.union(signed.filter("n = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), own))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one row of each class: the first by doc_id, a null one last, then by text hash.

    Rows without words are kept, but a repeated row only once.
    """
    classes = cut(near_duplicates(docs.select("doc_id", "text"), least), "classes")
    kept = cut(classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th")), "kept")
    repeated = classes.groupBy("doc_id", "th").count().filter("count > 1")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text")).join(
        kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_th")), "left_semi")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["_doc", "_text"])
    return rows.select("_row.*")
