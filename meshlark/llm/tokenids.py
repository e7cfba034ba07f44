"""Token ids in files of directly addressable codes: any token is found by position, without decoding a block.

A file is a row of segments of 2 ** 18 tokens (the last may be shorter) and a footer. A segment splits its ids into
bytes, lowest first: level 0 holds the lowest byte of every id, level k the next byte of those ids that go on. Each
level has a bitmap of which codes go on and a directory of how many do so before each 512 codes, so the place of an
id's next byte is one rank query.

    file     magic, segments, footer, footer's place (8 bytes), magic
    segment  counts of codes of the four levels (4 x uint32), then per level: codes, bitmap, directory (uint32s)
    footer   numbers of segments and documents, segments' places, documents' ids, null flags, first tokens (uint64s)

All numbers are little-endian. A manifest, an ordinary table, names the files and how many tokens come before each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.functions.worker import once, ship
from meshlark.llm.counts import byte_letters
from meshlark.llm.held import Held, Settled
from meshlark.session import cut, fresh_dir

ship(__name__)
MAGIC = b"MLIDS001"
SEGMENT = 1 << 18
BLOCK = 512
LEVELS = 4
HELD = 400_000


#: Fixed value: how plain byte-level tokenizer files of the library split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Unsettled(Exception):
    """A pre-token has a character on which character tables differ; the library then splits the text itself."""


class Tokenizer:
    """A tokenizer file of the tokenizers library.

    Where the file says that pre-tokens are the plain byte-level ones, the library's model encodes each distinct
    pre-token once as long as it is held. Otherwise, and where a text has a special token's string or an unsettled character, the library
    encodes the text as a whole.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        import regex
        from tokenizers import Tokenizer as Library

        says = json.loads(content)
        before = says.get("pre_tokenizer") or {}
        self.plain = says.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        specials = [x["content"] for x in says.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, specials))).search if specials else lambda text: None
        self.library = Library.from_buffer(content)
        self.model, self.split = self.library.model, regex.compile(PATTERN).findall
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.pieces, self.settled = Held(self._piece, HELD), Settled()

    def _piece(self, piece: str) -> bytes:
        if not self.settled.all_of(piece):
            raise Unsettled
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return array("I", [x.id for x in found]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.plain and not self.special(text):
            try:
                return b"".join(map(self.pieces.__getitem__, self.split(text)))
            except Unsettled:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pack(ids: np.ndarray) -> bytes:
    """One segment."""
    counts, parts, left = [], [], ids.astype(np.uint32)
    for _ in range(LEVELS):
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
        padded[:len(more)] = more
        per = padded.reshape(-1, BLOCK).sum(1)
        counts.append(len(left))
        parts += [(left & 255).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(per) - per).astype("<u4").tobytes()]
        left = left[more] >> 8
    return struct.pack(f"<{LEVELS}I", *counts) + b"".join(parts)


class Segment:
    """Reads tokens of one segment by position."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        at, self.levels = 4 * LEVELS, []
        for n in struct.unpack_from(f"<{LEVELS}I", content):
            bits, ranks = at + n, at + n + -(-n // 8)
            self.levels.append((at, bits, ranks))
            at = ranks + 4 * -(-n // BLOCK)

    def _rank(self, level: int, at: int) -> int:
        """How many of the level's codes before ``at`` go on."""
        _, bits, ranks = self.levels[level]
        block = at // BLOCK
        if at % BLOCK == 0 and at:  # may be the level's end, which has no directory entry of its own
            block -= 1
        before = struct.unpack_from("<I", self.content, ranks + 4 * block)[0]
        first = block * BLOCK // 8
        span = int.from_bytes(self.content[bits + first:bits + -(-at // 8)], "little")
        return before + (span & ((1 << (at - block * BLOCK)) - 1)).bit_count()

    def token(self, at: int) -> int:
        """The id at position ``at``: at most one byte, one bit and one rank query a level."""
        value = 0
        for level, (codes, bits, _) in enumerate(self.levels):
            value |= self.content[codes + at] << 8 * level
            if not self.content[bits + at // 8] >> at % 8 & 1:
                break
            at = self._rank(level, at)
        return value

    def tokens(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Ids of the positions from ``start`` to before ``end``."""
        if start >= end:
            return np.empty(0, np.uint32)
        codes, bits, _ = self.levels[level]
        values = np.frombuffer(self.content[codes + start:codes + end], np.uint8).astype(np.uint32)
        held = np.frombuffer(self.content[bits + start // 8:bits + -(-end // 8)], np.uint8)
        more = np.unpackbits(held, bitorder="little")[start % 8:start % 8 + end - start].astype(bool)
        if more.any():
            next_start = self._rank(level, start)
            values[more] |= self.tokens(next_start, next_start + int(more.sum()), level + 1) << 8
        return values


def _open(path: str):
    """(file system, path) of a local path or an URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path)) if ":" in path else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file: documents in order, their ids in segments."""

    def __init__(self, path: str):
        system, at = _open(path)
        system.create_dir(os.path.dirname(at), recursive=True)
        self.out = system.open_output_stream(at)
        self.out.write(MAGIC)
        self.place, self.segments, self.docs, self.nulls, self.starts = len(MAGIC), [], [], [], []
        self.tokens, self.open_ids, self.n_open = 0, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.tokens)
        self.tokens += len(ids)
        self.open_ids.append(ids)
        self.n_open += len(ids)
        if self.n_open >= SEGMENT:
            self._flush(SEGMENT)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.open_ids) if self.open_ids else np.empty(0, np.uint32)
        while len(ids) >= least and len(ids):
            content = pack(ids[:SEGMENT])
            self.segments.append(self.place)
            self.out.write(content)
            self.place += len(content)
            ids = ids[SEGMENT:]
        self.open_ids, self.n_open = [ids], len(ids)

    def close(self) -> None:
        self._flush(1)
        numbers = [len(self.segments), len(self.docs), *self.segments, *(x % 2**64 for x in self.docs), *map(int, self.nulls), *self.starts, self.tokens]
        self.out.write(np.array(numbers, dtype="<u8").tobytes() + struct.pack("<Q", self.place) + MAGIC)
        self.out.close()


class Reader:
    """One file, by document or by position."""

    def __init__(self, path: str):
        system, at = _open(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        place, mark = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if mark != MAGIC:
            raise ValueError(f"{path} is not a whole file of token ids")
        numbers = np.frombuffer(self.file.read_at(size - 16 - place, place), "<u8")
        s, d = int(numbers[0]), int(numbers[1])
        self.segments = [*map(int, numbers[2:2 + s]), place]
        docs, nulls, self.starts = np.split(numbers[2 + s:], [d, 2 * d])
        self.docs = [None if null else int(x) for x, null in zip(docs.astype(np.int64), nulls, strict=True)]
        self.held: tuple[int, Segment | None] = (-1, None)

    def segment(self, k: int) -> Segment:
        if self.held[0] != k:
            self.held = (k, Segment(self.file.read_at(self.segments[k + 1] - self.segments[k], self.segments[k])))
        return self.held[1]

    def token(self, at: int) -> int:
        return self.segment(at // SEGMENT).token(at % SEGMENT)

    def document(self, k: int) -> Iterator[np.ndarray]:
        """Ids of the file's k-th document, a part from each segment that it reaches into."""
        at, end = int(self.starts[k]), int(self.starts[k + 1])
        while at < end:
            seg, stop = at // SEGMENT, min(end, (at // SEGMENT + 1) * SEGMENT)
            yield self.segment(seg).tokens(at - seg * SEGMENT, stop - seg * SEGMENT)
            at = stop


MANIFEST = "file string, first_doc long, first_hash long, n_docs long, n_tokens long"


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> DataFrame:
    """Tokenise (doc_id, text) and write the ids to files below ``path``; returns the manifest, with ``start`` of each file.

    Documents are dealt out by ranges of doc_id and sorted (a null id first, rows of one id by their text's hash),
    then each task writes one file as it reads on: it holds one segment, one batch of texts and the places of its
    documents. Null text counts as empty; every document ends with ``end_id``. A file's name is used by one attempt
    of one task alone, and only what the manifest names counts, so a lost executor's file does no harm.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    shared, mark = spark.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = once(("tokenizer", mark), lambda: Tokenizer(shared.value))
        out = None
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                ids, hashes, texts = (x.to_pylist() for x in part.columns)
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.ids"
                    out, first = Writer(name), (ids[0], hashes[0])
                for doc_id, found in zip(ids, map(tokenizer.encode, texts), strict=True):
                    out.add(doc_id, np.concatenate((np.frombuffer(found, "<u4"), end)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{
                "file": name, "first_doc": first[0], "first_hash": first[1], "n_docs": len(out.docs), "n_tokens": out.tokens}],
                pa.schema([("file", pa.string()), *((x, pa.int64()) for x in ("first_doc", "first_hash", "n_docs", "n_tokens"))]))

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    files = cut(ordered.mapInArrow(save, MANIFEST), "ids-manifest")
    before = Window.orderBy("first_doc", "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; each file is read by one task."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = Reader(row["file"])
                crcs = []
                for k in range(len(held.docs)):
                    crc = 0
                    for ids in held.document(k):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    crcs.append(crc)
                starts = held.starts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(held.docs, pa.int64()), pa.array(starts[:-1] + row["start"]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a file is much work behind a short row: adaptive execution must not gather such rows in few tasks
    return manifest.select("file", "start").repartition(max(1, manifest.count())).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) for rows of ``position`` in the whole sequence; rows beyond its end have no token and are left out."""
    bucket = lambda at: F.floor(at / F.lit(SEGMENT)).alias("bucket")
    end = F.col("start") + F.col("n_tokens")
    spans = manifest.filter("n_tokens > 0").select("file", "start", end.alias("end"), F.explode(
        F.sequence(bucket(F.col("start")), bucket(end - 1))).alias("bucket"))
    asked = positions.select(F.col("position").cast("long").alias("position"), bucket(F.col("position")))
    met = asked.join(spans, "bucket").filter((F.col("position") >= F.col("start")) & (F.col("position") < F.col("end")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, None
        for batch in batches:
            tokens = []
            for name, start, position in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if name != file:
                    file, held = name, Reader(name)
                tokens.append(held.token(position - start))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(tokens, pa.int64())], ["position", "token"])

    return met.select("file", "start", "position").repartition("file").sortWithinPartitions("file", "position").mapInArrow(
        find, "position long, token long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    return read(write(docs, tokenizer_path, end_id, fresh_dir(spark, "token-ids")))
