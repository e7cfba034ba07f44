"""Byte-level BPE by a rank file: overlapping chunks of long texts are pre-tokenised apart and stitched, then encoded."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.functions.worker import once, ship
from meshlark.llm.held import Settled

ship(__name__)
CHUNK = 1 << 15  # code points of a chunk
OVERLAP = 1 << 10  # code points that a chunk reads of the next one
AHEAD = 3  # code points from its start that decide between the pattern's short forms ('re)
HELD = 200_000  # pre-tokens whose ids a worker keeps


class Coder:
    """Encoder and decoder of one rank file, with the ids of recent pre-tokens.

    A text with a character on which character tables differ is split by the library itself.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.split = regex.compile(pattern).findall
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.held: dict[str, bytes] = {}
        self.settled = Settled()
        self.bytes_of = {i: b for b, i in ranks.items()}

    def _learn(self, piece: str) -> bytes:
        if len(self.held) >= HELD:
            self.held.clear()
        ids = self.held[piece] = np.array(self._encode._encode_single_piece(piece), dtype="<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if not self.settled.all_of(text):
            return np.array(self._encode.encode_ordinary(text), dtype="<u4").tobytes()
        get, learn = self.held.get, self._learn
        return b"".join([get(piece) or learn(piece) for piece in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Files:
    """What tasks need of a rank file: its bytes, read on the driver (some 50,000 lines), and the splitting pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            content = f.read()
        self._shared, self.pattern = spark.sparkContext.broadcast(content), pattern
        self._key = hashlib.sha256(content + pattern.encode()).hexdigest()

    def coder(self) -> Coder:
        return once(("bpe", self._key), lambda: Coder(self._shared.value, self.pattern))


SLICE = 64  # rows whose results a task holds


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE))


def _encode(files: Files):
    """The last column, text, becomes ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = files.coder()
        for part in _rows(batches):
            ids = pa.array([coder.encode(x) for x in part.columns[-1].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"])

    return encode


def _decode(files: Files):
    """Adds the bytes of the last column, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = files.coder()
        for part in _rows(batches):
            out = pa.array([None if x is None else coder.decode(x) for x in part.columns[-1].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return decode


def _digest(files: Files, of_text: bool):
    """The last column, text or ids, becomes the figures of its round trip."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = files.coder()
        for part in _rows(batches):
            n, ids_sha, decoded_sha = [], [], []
            for x in part.columns[-1].to_pylist():
                ids = coder.encode(x) if of_text else x
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                [*part.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _typed(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


_CHUNK_ROWS = pa.schema([
    ("key", pa.binary()), ("part", pa.int64()), ("last", pa.bool_()), ("open", pa.bool_()), ("chunk", pa.string())])


def _chunks(chunk: int, overlap: int):
    """Long texts to chunks, each with the first ``overlap`` code points of the next."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                n = -(-len(text) // chunk)
                for part in range(n):
                    yield pa.RecordBatch.from_pylist([{
                        "key": key, "part": part, "last": part == n - 1, "open": (part + 1) * chunk + overlap < len(text),
                        "chunk": text[part * chunk:(part + 1) * chunk + overlap],
                    }], _CHUNK_ROWS)

    return cut_up


def _boundaries(files: Files, chunk: int, overlap: int):
    """Adds to each chunk its pre-token boundaries in its first code points and in its part of the next chunk.

    Boundaries count from the start of the chunk that owns them. Those at the very end of what the chunk reads are
    left out while the text goes on: what follows could move them. So are those behind white space, which would
    be split otherwise at the end of a piece, and those beside a pre-token with a character on which tables differ.
    """
    places = pa.list_(pa.int32())
    kind = _CHUNK_ROWS.append(pa.field("head", places)).append(pa.field("tail", places))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = files.coder()
        for batch in batches:
            heads, tails = [], []
            for text, is_open in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = coder.split(text)
                ends = np.cumsum([len(x) for x in found])
                sure = [True] * (len(found) + 1) if coder.settled.all_of(text) else [*map(coder.settled.all_of, found), True]
                ends = ends[[not x[-1].isspace() and (end <= len(text) - AHEAD or not is_open) and sure[k] and sure[k + 1]
                             for k, (x, end) in enumerate(zip(found, ends, strict=True))]]
                heads.append(ends[ends < overlap].astype(np.int32))
                tails.append((ends[ends >= chunk] - chunk).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, places), pa.array(tails, places)], schema=kind)

    return split


def stitched_pieces(docs: DataFrame, files: Files, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, text) to (key, piece, text): runs of whole pre-tokens which in order make up the text.

    Chunks are pre-tokenised independently. Starting amid a pre-token, a chunk may at first split otherwise than
    the whole text would, but from the first boundary that it shares with the chunk before it on both agree, as the
    pattern never looks back: there the pieces are cut. A text of which two chunks share no boundary (a single run
    of over ``overlap`` characters) stays one piece.
    """
    kinds = "key binary, part long, last boolean, open boolean, chunk string"
    parts = docs.select("key", "text").mapInArrow(_chunks(chunk, overlap), kinds)
    seen = parts.repartition("key", "part").mapInArrow(_boundaries(files, chunk, overlap), f"{kinds}, head array<int>, tail array<int>")
    by_part = Window.partitionBy("key").orderBy("part")
    synced = seen.withColumn("sync", F.when(F.col("part") == 0, 0).otherwise(
        F.array_min(F.array_intersect(F.lag("tail").over(by_part), "head"))))
    synced = synced.withColumns({
        "next": F.lead("sync").over(by_part), "whole": F.max(F.col("sync").isNull()).over(Window.partitionBy("key"))})
    end = F.when(F.col("last"), F.length("chunk")).otherwise(F.lit(chunk) + F.col("next"))
    own = F.when(F.col("whole"), F.substring("chunk", 1, chunk)).otherwise(
        F.substr("chunk", F.col("sync") + 1, end - F.col("sync")))
    pieces = synced.select("key", F.when(F.col("whole"), 0).otherwise(F.col("part")).alias("piece"), "part", own.alias("text"))
    return pieces.groupBy("key", "piece").agg(F.expr("listagg(text) WITHIN GROUP (ORDER BY part)").alias("text"))


def _bare(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _long_ids(bare: DataFrame, files: Files, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of the texts of more than one chunk."""
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.hex(F.col("doc_id").cast("long")), F.lit("-")), F.lit("/"), F.col("text")), 256))
    long = bare.filter(F.length("text") > chunk).groupBy(key.alias("key")).agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    pieces = stitched_pieces(long, files, chunk, overlap).repartition("key", "piece").select("key", "piece", "text")
    whole = pieces.mapInArrow(_encode(files), f"{_typed(pieces, 'key', 'piece')}, ids binary").groupBy("key").agg(
        F.expr("listagg(ids) WITHIN GROUP (ORDER BY piece)").alias("ids"))
    named = whole.join(long.select("key", "doc_id", "copies"), "key")
    return named.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("doc_id", "ids")


def encode(docs: DataFrame, files: Files, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``: ids as little-endian unsigned 32-bit integers, without special tokens.

    Texts of one chunk are encoded where they are. Longer ones are cut into chunks that are dealt out over the
    cluster, stitched and encoded by pieces; their ids meet again in order. Rows of one long text and id are
    encoded once and multiplied. Null text counts as empty; columns other than doc_id and text are dropped.
    """
    bare = _bare(docs)
    short = bare.filter(F.length("text") <= chunk).mapInArrow(_encode(files), f"{_typed(bare, 'doc_id')}, ids binary")
    return short.unionByName(_long_ids(bare, files, chunk, overlap))


def decode(encoded: DataFrame, files: Files) -> DataFrame:
    """(doc_id, ids, decoded) from (doc_id, ids): the bytes of the ids, one after another."""
    bare = encoded.select("doc_id", "ids")
    return bare.mapInArrow(_decode(files), f"{_typed(bare, 'doc_id', 'ids')}, decoded binary")


def digest(docs: DataFrame, files: Files, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode every row as ``encode`` does, decode the ids, and keep what identifies the ids and the decoded bytes.

    The figures are made where the ids are, so that neither ids nor decoded bytes of short texts leave their task.
    """
    bare = _bare(docs)
    kind = f"{_typed(bare, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = bare.filter(F.length("text") <= chunk).mapInArrow(_digest(files, True), kind)
    return short.unionByName(_long_ids(bare, files, chunk, overlap).mapInArrow(_digest(files, False), kind))
