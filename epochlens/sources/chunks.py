"""Files as byte ranges: a data source whose partitions hold pieces of files of any size.

``spark.read.format("filechunks")`` gives (file_path, chunk, start, size, bytes, file_size). A chunk owns ``size`` bytes
from ``start``; ``bytes`` holds up to ``halo`` more, the start of the next chunk, for readers that look ahead over the
edge. A large file lies in many partitions, small files share one, and a task never holds more than one chunk. Paths
with a scheme are opened by Arrow's file systems, others as local files that every executor sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from epochlens.functions.paths import nt_path

SCHEMA = "file_path string, chunk bigint, start bigint, size bigint, bytes binary, file_size bigint"
ARROW = pa.schema([("file_path", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()), ("size", pa.int64()),
                   ("bytes", pa.binary()), ("file_size", pa.int64())])
CHUNK = 16 << 20
SPLIT = 128 << 20
PIECE = 1 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, recursive: bool) -> Iterator[tuple[str, int]]:
    """(name, size) of a file, or of the files of a directory."""
    store, at = open_fs(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=recursive))
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    for one in sorted(found, key=lambda i: i.path):
        if one.type == fs.FileType.File:
            yield prefix + one.path, one.size


def chunks_of(name: str, real: str, size: int, first: int, stop: int, chunk: int, halo: int) -> Iterator[pa.RecordBatch]:
    """Chunks ``first`` to ``stop`` (exclusive) of a file, each a batch of its own. An empty file has one empty chunk."""
    store, at = open_fs(real)
    with store.open_input_file(at) as source:
        for no in range(first, stop):
            start = no * chunk
            own = max(0, min(chunk, size - start))
            held = source.read_at(min(own + halo, max(0, size - start)), start) if own else b""
            yield pa.RecordBatch.from_pydict({"file_path": [name], "chunk": [no], "start": [start], "size": [own],
                                              "bytes": [held], "file_size": [size]}, schema=ARROW)


@dataclass
class Pieces(InputPartition):
    """(name, size, first chunk, stop chunk) of the chunks that one task reads."""
    parts: list

    def __init__(self, parts: list):
        super().__init__(0)
        self.parts = parts


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.chunk, self.halo = int(options.get("chunk", CHUNK)), int(options.get("halo", 0))
        self.split = int(options.get("split", SPLIT))
        if self.chunk <= 0 or self.halo < 0:
            raise ValueError("chunk must be positive and halo must not be negative")

    def partitions(self) -> list[Pieces]:
        per_task = max(1, self.split // self.chunk)
        out, held, room = [], [], per_task
        for name, size in listed(self.path, self.recursive):
            first, last = 0, max(1, -(-size // self.chunk))
            while first < last:
                stop = min(last, first + room)
                held.append((name, size, first, stop))
                room -= stop - first
                first = stop
                if not room:
                    out.append(Pieces(held))
                    held, room = [], per_task
        return [*out, Pieces(held)] if held or not out else out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for name, size, first, stop in partition.parts:
            yield from chunks_of(name, name, size, first, stop, self.chunk, self.halo)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filechunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def read_chunks(spark: SparkSession, path: str, *, chunk: int = CHUNK, halo: int = 0, recursive: bool = False) -> DataFrame:
    """All chunks of a file or directory."""
    spark.dataSource.register(ChunkSource)
    return spark.read.format("filechunks").option("chunk", chunk).option("halo", halo).option(
        "recursive", str(recursive).lower()).load(path)


def _real(mount_root: str):
    return F.concat(F.lit(mount_root.rstrip("/")), nt_path(F.col("file_path")))


def mounted_chunks(wanted: DataFrame, mount_root: str, *, chunk: int = CHUNK, halo: int = 0) -> DataFrame:
    """The stated (file_path, chunk) of files under a mount; only these byte ranges are read. Files that cannot be
    read give no rows."""

    def load(batches):
        for batch in batches:
            for name, real, no in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    size = fs.LocalFileSystem().get_file_info(real).size
                    if size is not None:
                        yield from chunks_of(name, real, size, no, no + 1, chunk, halo)
                except OSError:
                    continue

    return wanted.select("file_path", _real(mount_root).alias("real"), "chunk").mapInArrow(load, SCHEMA)


FACTS = "file_path string, sha256 string, size_bytes bigint, magic binary"


def mounted_facts(paths: DataFrame, mount_root: str) -> DataFrame:
    """(file_path, sha256, size_bytes, magic) of files under a mount, read once from end to end in pieces of 1 MiB;
    ``magic`` are the first eight bytes. Files that cannot be read are left out."""

    def measure(batches):
        for batch in batches:
            rows = []
            for name, real in zip(*(c.to_pylist() for c in batch.columns)):
                digest, size, magic = hashlib.sha256(), 0, b""
                try:
                    with open(real, "rb") as source:
                        while part := source.read(PIECE):
                            digest.update(part)
                            magic, size = magic or part[:8], size + len(part)
                except OSError:
                    continue
                rows.append((name, digest.hexdigest(), size, magic))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary()))],
                                             ["file_path", "sha256", "size_bytes", "magic"])

    return paths.select("file_path").distinct().select("file_path", _real(mount_root).alias("real")).mapInArrow(measure, FACTS)
