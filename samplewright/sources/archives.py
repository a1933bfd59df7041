"""Zip archives as a data source: their directories are read from the end of each file, whatever its size.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive_members").option("path", "…").load()

Partitions are planned over the archives below the path, listed page by page. A task seeks to the end of an archive, finds the
directory there, and streams it block by block: no archive, and no directory, is held as a whole, and rows leave in bounded batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from samplewright.sources.files import file_system, folder_pages, resolved

BLOCK = 1 << 18
BATCH = 10_000
PER_PARTITION = 64
SCHEMA = "path string, zip_name string, member string, filename string, length bigint"
_ARROW = pa.schema([("path", pa.string()), ("zip_name", pa.string()), ("member", pa.string()), ("filename", pa.string()), ("length", pa.int64())])

# Fixed values of the zip format: the end record, its 64-bit forms, and an entry of the directory.
_END, _END64, _LOCATOR, _ENTRY = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2"
_END_SIZE, _END64_SIZE, _LOCATOR_SIZE, _ENTRY_SIZE, _MOST_COMMENT = 22, 56, 20, 46, 1 << 16
_FULL32, _UTF8 = 0xFFFFFFFF, 0x800


class NotAnArchive(ValueError):
    pass


def _directory(file, size: int) -> tuple[int, int]:
    """Where an archive's directory begins and how long it is. Counted back from its end, so bytes before the archive do not matter."""
    at = max(0, size - _END_SIZE - _MOST_COMMENT)
    file.seek(at)
    tail = file.read(size - at)
    end = tail.rfind(_END)
    if end < 0 or len(tail) - end < _END_SIZE:
        raise NotAnArchive("no end record")
    length, = struct.unpack_from("<L", tail, end + 12)
    stop = at + end
    wide_at = stop - _LOCATOR_SIZE - _END64_SIZE
    if wide_at >= 0:
        file.seek(wide_at)
        wide = file.read(_END64_SIZE + _LOCATOR_SIZE)
        if wide[:4] == _END64 and wide[_END64_SIZE:_END64_SIZE + 4] == _LOCATOR:
            length, = struct.unpack_from("<Q", wide, 40)
            stop = wide_at
    if length > stop:
        raise NotAnArchive("directory longer than the file")
    return stop - length, length


def entries(file, size: int) -> Iterator[tuple[str, int]]:
    """Name and unpacked length of every member of an open archive, in directory order."""
    start, left = _directory(file, size)
    file.seek(start)
    held, at = b"", 0

    def need(n: int) -> bool:
        nonlocal held, at, left
        while len(held) - at < n and left:
            block = file.read(min(left, max(BLOCK, n)))
            if not block:
                return False
            held, at, left = held[at:] + block, 0, left - len(block)
        return len(held) - at >= n

    while need(_ENTRY_SIZE) and held[at:at + 4] == _ENTRY:
        flags, = struct.unpack_from("<H", held, at + 8)
        length, name_size, extra_size, comment_size = struct.unpack_from("<LHHH", held, at + 24)
        if not need(_ENTRY_SIZE + name_size + extra_size + comment_size):
            raise NotAnArchive("cut-off directory")
        name = held[at + _ENTRY_SIZE:at + _ENTRY_SIZE + name_size].decode("utf-8" if flags & _UTF8 else "cp437", "replace")
        if length == _FULL32:
            length = _wide_length(held[at + _ENTRY_SIZE + name_size:at + _ENTRY_SIZE + name_size + extra_size], length)
        yield name, length
        at += _ENTRY_SIZE + name_size + extra_size + comment_size


def _wide_length(extra: bytes, length: int) -> int:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1 and size >= 8:
            return struct.unpack_from("<Q", extra, at + 4)[0]
        at += 4 + size
    return length


def open_file(system: fs.FileSystem, path: str):
    return system.open_input_file(path)


@dataclass
class Archives(InputPartition):
    paths: list[tuple[str, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Archives]:
        system, base = file_system(self.root)
        parts, some, folders = [], [], [base.rstrip("/")]
        while folders:
            for page in folder_pages(system, folders.pop()):
                for path, is_dir, size, _ in page:
                    if is_dir:
                        folders.append(path)
                    elif path.endswith(".zip"):
                        some.append((path, size))
                        if len(some) == PER_PARTITION:
                            parts.append(Archives(some))
                            some = []
        return [*parts, Archives(some)]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.root)
        rows: list[tuple] = []
        for path, size in partition.paths:
            short, zip_name = path[len(base.rstrip("/")) + 1:], path.rsplit("/", 1)[-1]
            with open_file(system, path) as file:
                for member, length in entries(file, size):
                    if not member.endswith("/"):
                        rows.append((short, zip_name, member, member.rsplit("/", 1)[-1], length))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """(path below `root`, zip_name, member, filename, length) of the members of all zip files below a folder, folders left out."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).option("path", resolved(spark, root)).load()
