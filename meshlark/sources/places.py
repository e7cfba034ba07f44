"""Opening files by byte ranges inside tasks, and writing whole files at exact paths."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from meshlark.functions.worker import ship
from meshlark.session import spread

ship(__name__)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes them (``file:/a b``, ``s3a://...``), and the path in it."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]$", "s3", scheme) + ":" + quote(rest, safe="/:@?=&"))


# -- writing ----------------------------------------------------------------


class Count(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Count:
        """Every row to a temporary file; once all of the task's rows are written, each gets its name by a move.

        An attempt that fails removes what it wrote, and nobody sees a part of a file. A new attempt, or a second
        run, replaces the files by the same ones.
        """
        mine, written, made = uuid.uuid4().hex, [], set()
        try:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    whole = path if ":" in path or path.startswith("/") else f"{self.folder}/{path}"
                    system, name = located(whole)
                    within = whole.rpartition("/")[0]
                    if within not in made:
                        system.create_dir(name.rpartition("/")[0], recursive=True)
                        made.add(within)
                    written.append((system, name))
                    with system.open_output_stream(f"{name}.{mine}.part", compression=None) as out:
                        out.write(content.as_buffer())
            for system, name in written:
                system.move(f"{name}.{mine}.part", name)
        except BaseException:
            for system, name in written:
                part = f"{name}.{mine}.part"
                if system.get_file_info(part).type != fs.FileType.NotFound:
                    system.delete_file(part)
            raise
        return Count(len(written))


class Files(DataSource):
    """Sink of (path, content) rows: one file a row."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write each row of (path, content) as one file at exactly that path, below ``folder`` if the path is relative."""
    files.sparkSession.dataSource.register(Files)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("whole_files").mode("append").save(folder)


# -- reading ----------------------------------------------------------------

_FILE = pa.schema([("path", pa.string()), ("content", pa.binary())])
MOST, ROWS = 16 << 20, 1000  # bytes and files of a batch


def _contents(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, size = [], [], 0
            for path in batch.column(0).to_pylist():
                system, name = located(path if ":" in path or path.startswith("/") else f"{folder}/{path}")
                with system.open_input_file(name) as file:
                    contents.append(file.read())
                paths.append(path)
                size += len(contents[-1])
                if size >= MOST or len(paths) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=_FILE)
                    paths, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=_FILE)

    return read


def read_files(paths: DataFrame, folder: str) -> DataFrame:
    """path, content of the files of ``path`` that ``write_files`` wrote, each once; one that is not there ends the job.

    Tasks open the files by name: no folder is listed, so millions of files cost the driver nothing.
    """
    return spread(paths.select("path"), "path").distinct().mapInArrow(_contents(folder.rstrip("/")), "path string, content binary")
