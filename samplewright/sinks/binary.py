"""Data-source writers for bytes: files as they are, and sources merged into gzip files.

Tasks write under `_temporary/<job>` below the root and report what they wrote; the commit gives each file its name, an abort takes
the temporary folder away. A task that is run again writes under a new name, and only the names that were reported are committed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from samplewright.session import cut
from samplewright.sources.files import file_system, resolved

BLOCK = 1 << 20
PART = 64 << 20
RUN = 256


@dataclass
class Written(WriterCommitMessage):
    """(temporary name, final name) of a task's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, base = file_system(self.root)
        return system, base.rstrip("/")

    def _temporary(self) -> str:
        return f"_temporary/{self.job}"

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._place()
        made: set[str] = set()
        for message in messages:
            for temporary, final in message.files if message else []:
                folder = f"{base}/{final}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                system.move(f"{base}/{temporary}", f"{base}/{final}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = self._place()
        if system.get_file_info(f"{base}/{self._temporary()}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self._temporary()}")


class _FileWriter(_Writer, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Contents go from the batch they came in to the file: one batch is held and nothing is copied."""
        system, base = self._place()
        system.create_dir(f"{base}/{self._temporary()}", recursive=True)
        out = Written()
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name = f"{self._temporary()}/{uuid.uuid4().hex}"
                with system.open_output_stream(f"{base}/{name}") as file:
                    file.write(content.as_buffer())
                out.files.append((name, path))
        return out


class FileSink(DataSource):
    """Rows (path, content) become files below `path`."""

    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["path"])


def write_files(files: DataFrame, root: str) -> str:
    """Files `(path below root, content)`, one each."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    files.select("path", "content").write.format(FileSink.name()).mode("append").save(resolved(spark, root))
    return root


class _MemberWriter(_Writer):
    def __init__(self, root: str, sources: str):
        super().__init__(root)
        self.sources = sources

    def write(self, rows: Iterator) -> Written:
        system, base = self._place()
        away, top = file_system(self.sources)
        system.create_dir(f"{base}/{self._temporary()}", recursive=True)
        out = Written()
        file = packer = following = None
        try:
            for row in rows:
                # A run goes on with the very next source of its output only, so nothing else belongs between two of its sources.
                if row["run"] is None or (row["output"], row["run"], row["source_no"]) != following:
                    if file:
                        file.write(packer.flush())
                        file.close()
                    name = f"{self._temporary()}/{uuid.uuid4().hex}"
                    file = system.open_output_stream(f"{base}/{name}")
                    packer = zlib.compressobj(wbits=31)  # a whole gzip member
                    out.files.append((name, f"{row['output']}{_PARTS}/{row['source_no']:010d}-{row['part_no']:010d}"))
                following = row["output"], row["run"], row["source_no"] + 1
                with away.open_input_file(f"{top.rstrip('/')}/{row['path']}") as source:
                    source.seek(row["start"])
                    left = row["length"]
                    while left:
                        block = source.read(min(BLOCK, left))
                        if not block:
                            raise OSError(f"{row['path']} is shorter than planned")
                        left -= len(block)
                        file.write(packer.compress(block))
            if file:
                file.write(packer.flush())
        finally:
            if file:
                file.close()
        return out


_PARTS = ".parts"


class MemberSink(DataSource):
    """Rows (output, source_no, part_no, path, start, length, run) become gzip members `output.parts/<source>-<part>` below `path`.

    Sources that follow each other in a run, a number or null, make one member, named by the first of them.
    """

    @classmethod
    def name(cls) -> str:
        return "gzip_members"

    def writer(self, schema, overwrite: bool) -> _MemberWriter:
        return _MemberWriter(self.options["path"], self.options["sources"])


def merge_sources(sources: DataFrame, source_root: str, root: str, part: int = PART) -> DataFrame:
    """Merge files into gzip files, byte for byte: `sources(output, source_no, path, size)` below `source_root` become `output`
    below `root`, in the order of `source_no`. Returns (output, n_sources, src_bytes, gzip_bytes).

    Every range of `part` bytes is packed by whichever task gets it, so one large source is spread; small sources are packed in runs
    of up to `RUN`, at most `part` bytes, so there are far fewer members than sources. Members are then put one after another, which makes a gzip file of them, by one task per output that copies packed bytes. What is already merged under
    its name is not touched.
    """
    spark = sources.sparkSession
    spark.dataSource.register(MemberSink)
    root, source_root = resolved(spark, root), resolved(spark, source_root)
    last = F.greatest(F.ceil(F.col("size") / part).cast("bigint") - 1, F.lit(0).cast("bigint"))
    ranges = sources.select("output", F.col("source_no").cast("bigint").alias("source_no"), "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part_no"))
    ranges = ranges.select("output", "source_no", "part_no", "path", (F.col("part_no") * part).alias("start"),
                           F.least(F.lit(part).cast("bigint"), F.col("size") - F.col("part_no") * part).alias("length"),
                           F.when(F.col("size") <= part // RUN, F.expr(f"source_no div {RUN}")).alias("run"))
    dealt = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "output", F.coalesce("run", -1 - F.col("source_no")), "part_no")
    dealt = dealt.sortWithinPartitions("output", "source_no", "part_no")
    dealt.write.format(MemberSink.name()).mode("append").option("sources", source_root).save(root)
    outputs = sources.groupBy("output").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("size").cast("bigint").alias("src_bytes"))
    done = outputs.repartition(spark.sparkContext.defaultParallelism * 4, "output").select("output").mapInArrow(
        _composed(root), "output string, gzip_bytes bigint")
    return outputs.join(cut(done), "output")


def _composed(root: str):
    schema = pa.schema([("output", pa.string()), ("gzip_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        base = base.rstrip("/")
        for batch in batches:
            for output in batch.column("output").to_pylist():
                folder, size = f"{base}/{output}{_PARTS}", 0
                found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                if not found:  # put together by an earlier attempt
                    size = system.get_file_info(f"{base}/{output}").size
                else:
                    half = f"{base}/{output}.{uuid.uuid4().hex}"
                    with system.open_output_stream(half) as file:
                        for info in sorted(found, key=lambda i: i.base_name):
                            with system.open_input_stream(info.path) as member:
                                while block := member.read(BLOCK):
                                    file.write(block)
                                    size += len(block)
                    system.move(half, f"{base}/{output}")
                    # Out of the way in one step: an attempt after this one finds all members or none.
                    system.move(folder, f"{half}.gone")
                    system.delete_dir(f"{half}.gone")
                yield pa.RecordBatch.from_arrays([pa.array([output]), pa.array([size], pa.int64())], schema=schema)
    return run
