"""Listings of files, archives and upload sheets."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import paths as p
from samplewright.session import cut, spread

_MEMBERS = pa.schema([("zip_name", pa.string()), ("member", pa.string()), ("filename", pa.string())])
_ENTRIES = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])
_DIGESTS = pa.schema([("path", pa.string()), ("md5", pa.string())])
_EDGES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("edge", pa.string()), ("bytes_read", pa.int64())])
_BLOCK = 1 << 20
PAGE = 10_000
EDGE = 1 << 16


def resolved(spark: SparkSession, root: str) -> str:
    """A root without scheme lies on the default file system, as for Spark's own readers."""
    if ":/" in root:
        return root
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return root if default.startswith("file:") else default.rstrip("/") + "/" + root.lstrip("/")


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


def folder_pages(system: fs.FileSystem, folder: str, size: int = PAGE) -> Iterator[list[tuple]]:
    """(path, is_dir, length, mtime) of what a folder holds, at most `size` entries at a time. A local folder is read as it is
    listed; other file systems hand over a folder as a whole, which is then passed on in pages."""
    if isinstance(system, fs.LocalFileSystem):
        page = []
        with os.scandir(folder) as found:
            for entry in found:
                info = entry.stat()
                is_dir = entry.is_dir()
                page.append((f"{folder}/{entry.name}", is_dir, None if is_dir else info.st_size, datetime.fromtimestamp(info.st_mtime, UTC)))
                if len(page) == size:
                    yield page
                    page = []
        yield page
        return
    infos = system.get_file_info(fs.FileSelector(folder))
    for i in range(0, max(len(infos), 1), size):
        yield [(x.path, x.type == fs.FileType.Directory, x.size, x.mtime) for x in infos[i:i + size]]


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path relative to `root`, length, mtime) of all files below a folder, empty ones included.

    Folders are listed by tasks, level by level and in pages, so neither the driver nor one task holds the whole tree. (A scan
    with the built-in file reader would leave out empty files.)
    """
    root = resolved(spark, root)

    def read(batches):
        system, base = file_system(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for page in folder_pages(system, f"{base}/{folder}" if folder else base):
                    rows = [(path[len(base) + 1:], *rest) for path, *rest in page]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, _ENTRIES)], schema=_ENTRIES)

    level = spark.range(1).select(F.lit("").alias("path"))
    found = []
    while True:
        entries = cut(spread(level).mapInArrow(read, "path string, is_dir boolean, length bigint, mtime timestamp"))
        found.append(entries.where("NOT is_dir").drop("is_dir"))
        level = entries.where("is_dir").select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.union, found)
    if glob:
        pattern = "^" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
        files = files.where(p.base_name("path").rlike(pattern))
    return files


def _dealt(wanted: DataFrame) -> DataFrame:
    return wanted.repartition(wanted.sparkSession.sparkContext.defaultParallelism * 4)


def _hashed(spark: SparkSession, root: str, wanted: DataFrame, compression: str | None) -> DataFrame:
    root = resolved(spark, root)

    def read(batches):
        system, base = file_system(root)
        for batch in batches:
            texts = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.md5()
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}", compression=compression) as stream:
                        while block := stream.read(_BLOCK):
                            digest.update(block)
                    texts.append(digest.hexdigest())
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), pa.array(texts, pa.string())], schema=_DIGESTS)

    return _dealt(wanted.select("path")).mapInArrow(read, "path string, md5 string")


def file_digests(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, md5) of the files `wanted(path)` below `root`, null where a file cannot be read.

    Only these files are read, block by block, so their size does not matter. Paths are dealt out evenly.
    """
    return _hashed(spark, root, wanted, None)


def unpacked_digests(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, md5) of what gzip files `wanted(path)` below `root` hold, all members in a row; null where one cannot be read."""
    return _hashed(spark, root, wanted, "gzip")


def staged_digests(spark: SparkSession, root: str, listing: DataFrame, edge: int = EDGE) -> DataFrame:
    """(path, length, md5, bytes_read) of `listing(path, length)`: the digests that tell copies apart, with as little reading as
    that takes.

    A file whose length no other file has is not read. Of the others, the first and the last `edge` bytes are read; only files
    that agree in length and in these are read whole. Files of up to twice `edge` bytes are whole after the second step. `md5` is
    the digest of the whole file, and null for files that have no copy (or cannot be read, with bytes_read null).
    """
    root = resolved(spark, root)

    def edges(batches):
        system, base = file_system(root)
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                try:
                    with system.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                        first = file.read(2 * edge if length <= 2 * edge else edge)
                        if length > 2 * edge:
                            file.seek(length - edge)
                            first += file.read(edge)
                    row = (path, length, hashlib.md5(first).hexdigest(), len(first))
                except OSError:
                    row = (path, length, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _EDGES)], schema=_EDGES)

    slim = listing.select("path", "length")
    lengths = slim.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("length")
    alike = slim.join(lengths, "length", "left_semi")
    seen = cut(_dealt(alike).mapInArrow(edges, "path string, length bigint, edge string, bytes_read bigint"))
    several = seen.where("edge IS NOT NULL").groupBy("length", "edge").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("length", "edge")
    left = seen.join(several, ["length", "edge"], "left_semi")
    small = F.col("length") <= 2 * edge
    whole = file_digests(spark, root, left.where(~small).select("path"))
    long = left.where(~small).join(whole, "path").select("path", "length", "md5", (F.col("bytes_read") + F.col("length")).alias("bytes_read"))
    short = left.where(small).select("path", "length", F.col("edge").alias("md5"), "bytes_read")
    none = F.lit(None).cast("string").alias("md5")
    apart = seen.join(several, ["length", "edge"], "left_anti").select("path", "length", none, "bytes_read")
    unread = slim.join(lengths, "length", "left_anti").select("path", "length", none, F.lit(0).cast("bigint").alias("bytes_read"))
    return long.union(short).union(apart).union(unread)


def archive_members(files: DataFrame) -> DataFrame:
    """Members of the zip files `files(path, content)`, folders left out: (zip_name, member, filename)."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                zip_name = path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([zip_name] * len(names), pa.string()), pa.array(names, pa.string()),
                     pa.array([n.rsplit("/", 1)[-1] for n in names], pa.string())], schema=_MEMBERS)

    return files.select("path", "content").mapInArrow(read, "zip_name string, member string, filename string")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    return archive_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root))


def _sheet_name(path: str = "path"):
    return F.regexp_replace(p.base_name(path), r"\.xlsx$", "")


def _workbooks(files: DataFrame) -> DataFrame:
    name = p.base_name("path")
    return files.where(F.endswith("path", F.lit(".xlsx")) & ~F.startswith(name, F.lit("~")))


def preferred_files(files: DataFrame) -> DataFrame:
    """One upload sheet per base: `X-upload-new` beats `X-upload`."""
    name = _sheet_name()
    uploads = _workbooks(files).where(F.contains(name, F.lit("-upload"))).withColumns({
        "base": F.regexp_replace(name, "-upload(-new)?", ""),
        "is_new": F.contains(name, F.lit("-upload-new")).cast("int"),
    })
    return uploads.groupBy("base").agg(F.max_by("path", F.struct("is_new", "path")).alias("path"))


def grouped_uploads(files: DataFrame) -> DataFrame:
    """All upload sheets of a type, one per row: (sampletype, path)."""
    name = _sheet_name()
    kind = F.split_part(name, F.lit("-upload"), F.lit(1))
    return _workbooks(files).where(F.contains(name, F.lit("-upload")) & (kind != "")).select(kind.alias("sampletype"), "path")


def template_files(files: DataFrame, all_in_one: str | None = None) -> DataFrame:
    """Template workbooks with their arm: the text before the first `_`, or one name for all."""
    name = p.base_name("path")
    arm = F.lit(all_in_one) if all_in_one else F.split_part(name, F.lit("_"), F.lit(1))
    return _workbooks(files).where(F.contains(name, F.lit("_"))).select(arm.alias("arm"), "path")
