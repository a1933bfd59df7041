"""Token-id files: segments of concatenated ids with Elias-Fano coded document boundaries.

A segment is one binary value of the layout below; segments are rows of a Parquet table, which gives the writing its commit
protocol and the reading its splits. Rows of the table: bucket, seq, `at` (ids of the same bucket in earlier segments), docs,
tokens, data. All numbers in `data` are little-endian:

    4 bytes   b"SWT1"
    4 x u64   bytes per id (2 or 4), number of documents, number of documents without a doc_id (they come first), number of ids
    i64       smallest doc_id
    u64, …    length of the next part, then the Elias-Fano code of the doc_ids less the smallest
    u64, …    length of the next part, then the Elias-Fano code of the documents' ends in the id array
    …         the ids

Elias-Fano keeps a rising list of n values below u in about 2 + log2(u / n) bits each: the low bits in a packed array, the high
parts in unary. The place of every 256th set bit is kept as well, so `select` reads a few words, from a memory map if need be.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm import words
from samplewright.llm.common import bucket_count, bucket_of, cut_points, texts
from samplewright.session import scratch_path

MAGIC = b"SWT1"
SEGMENT_IDS = 1 << 18
SAMPLE = 256


class EliasFano:
    """A rising (not strictly) list of non-negative numbers. `bytes()` and `of` are inverse; `of` copies nothing."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if len(v) > 1 and (v[1:] < v[:-1]).any():
            raise ValueError("values must rise")
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high_at = (v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(int(high_at[-1]) + 1 if n else 0, np.uint8)
        bits[high_at.astype(np.int64)] = 1
        low = np.empty(0, np.uint8)
        if low_bits:
            planes = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), high_at[::SAMPLE].astype("<u4"))

    def bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        return head.tobytes() + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def of(cls, data) -> EliasFano:
        n, low_bits, n_low, n_high = (int(x) for x in np.frombuffer(data, "<u8", 4))
        n_samples = -(-n // SAMPLE)
        at = 32 + 4 * n_samples
        samples = np.frombuffer(data, "<u4", n_samples, 32)
        return cls(n, low_bits, np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low), samples)

    def select(self, i: int) -> int:
        """The i-th value, counted from 0: the i-th set bit from the nearest sample on, and the packed low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, ahead = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        ahead += int(np.bitwise_count(self.high[byte] & np.uint8((1 << (at % 8)) - 1)))
        while True:
            part = self.high[byte:byte + 64]
            counts = np.bitwise_count(part)
            seen = int(counts.sum())
            if seen > ahead:
                ones = np.flatnonzero(np.unpackbits(part, bitorder="little"))
                high = byte * 8 + int(ones[ahead]) - i
                break
            ahead -= seen
            byte += 64
        first = i * self.low_bits
        end = first + self.low_bits
        word = int.from_bytes(self.low[first // 8:-(-end // 8)].tobytes(), "little")
        return high << self.low_bits | (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        v = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            planes = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            v |= (planes.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return v

    def some(self, block: int) -> np.ndarray:
        """The values of one block: up to `SAMPLE` of them, read from its sampled place on."""
        first = block * SAMPLE
        count = min(SAMPLE, self.n - first)
        at = int(self.samples[block])
        end = int(self.samples[block + 1]) // 8 + 1 if block + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8:end], bitorder="little"))
        ones = ones[ones >= at % 8][:count] + at // 8 * 8
        v = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = self.low[first * self.low_bits // 8:]  # a block begins at a whole byte
            planes = np.unpackbits(low[:-(-count * self.low_bits // 8)], count=count * self.low_bits, bitorder="little").reshape(count, self.low_bits)
            v |= (planes.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return v

    def each(self) -> Iterator[int]:
        """Every value in turn; one block is held."""
        for block in range(-(-self.n // SAMPLE)):
            yield from self.some(block).tolist()

    def find(self, x: int) -> int:
        """How many values are at most `x`: for ends, the number of the document that holds position `x`."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.select(mid) <= x else (low, mid)
        return low


def pack(doc_ids: list[int | None], parts: list[np.ndarray], width: int) -> bytes:
    """One segment. `doc_ids` rise, nulls first; `parts` are the documents' ids."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    ends = np.cumsum([len(p) for p in parts], dtype=np.uint64)
    names = EliasFano.encode(np.array([d - first for d in known], np.uint64)).bytes()
    bounds = EliasFano.encode(ends).bytes()
    ids = np.concatenate(parts).astype(f"<u{width}") if parts else np.empty(0, f"<u{width}")
    head = np.array([width, len(parts), len(parts) - len(known), len(ids)], "<u8").tobytes() + np.array([first], "<i8").tobytes()
    size = lambda b: np.array([len(b)], "<u8").tobytes()
    return b"".join([MAGIC, head, size(names), names, size(bounds), bounds, ids.tobytes()])


class Segment:
    """A segment for reading, from bytes or a memory map."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a segment")
        width, self.docs, self.nameless, self.tokens = (int(x) for x in np.frombuffer(view, "<u8", 4, 4))
        self.first = int(np.frombuffer(view, "<i8", 1, 36)[0])
        at = 44
        coded = []
        for _ in range(2):
            n = int(np.frombuffer(view, "<u8", 1, at)[0])
            coded.append(EliasFano.of(view[at + 8:at + 8 + n]))
            at += 8 + n
        self.names, self.ends = coded
        self.ids = np.frombuffer(view, f"<u{width}", self.tokens, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nameless else self.first + self.names.select(i - self.nameless)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document; two selects, no table of offsets."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [doc_id for doc_id, _, _ in self.documents()]

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, begin, end) of every document in turn, read block by block from the coded lists."""
        names = chain(repeat(None, self.nameless), (self.first + v for v in self.names.each()))
        begin = 0
        for doc_id, end in zip(names, self.ends.each(), strict=True):
            yield doc_id, begin, end
            begin = end


def _encoded(path: str, end: int, width: int):
    """(bucket, doc_id, text) to (bucket, doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words.encoder(path)
        for batch in words.portions(batches, "text"):
            ids, bounds = encoder.encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end).astype(f"<u{width}")
            bounds = bounds + np.arange(len(bounds))
            offsets = pa.py_buffer((bounds * width).astype(np.int32))
            binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("doc_id"), binary], ["bucket", "doc_id", "ids"])
    return run


_SEGMENTS = "bucket int, seq int, at bigint, docs bigint, tokens bigint, data binary"


def _segments(width: int, size: int):
    """Sorted (bucket, doc_id, ids) to segments of about `size` ids; a longer document is a segment by itself."""
    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("at", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seq, at, held, names, parts = None, 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            row = {"bucket": bucket, "seq": seq, "at": at, "docs": len(parts), "tokens": held, "data": pack(names, parts, width)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for b, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if parts and (b != bucket or held >= size):
                    yield close()
                    seq, at, held, names, parts = seq + 1, at + held, 0, [], []
                if b != bucket:
                    bucket, seq, at = b, 0, 0
                part = np.frombuffer(ids, f"<u{width}")
                names.append(doc_id)
                parts.append(part)
                held += len(part)
        if parts:
            yield close()
    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int, width: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, add the id `end` to each, and write segments in ascending doc_id order to `path`.

    Ordered id buckets (bounds from the id column alone) are shuffled once, as ids of `width` bytes; a bucket is one task and
    its segments are cut as they fill, so memory holds one segment. Null ids come first; equal ids are ordered by their ids'
    bytes. Width 2 holds vocabularies of up to 65,536 ids.
    """
    docs = texts(docs)
    buckets = bucket_count(docs)
    cuts = cut_points(docs, "doc_id", buckets)
    placed = docs.select(bucket_of(F.col("doc_id"), cuts).alias("bucket"), "doc_id", "text")
    coded = placed.mapInArrow(_encoded(tokenizer, end, width), "bucket int, doc_id bigint, ids binary")
    laid = coded.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    laid.mapInArrow(_segments(width, segment_ids), _SEGMENTS).write.parquet(path)


def starts(segments: DataFrame) -> Column:
    """Where a segment begins in the whole id array. The totals of buckets, at most one per cut point, pass through the driver."""
    totals = {r["bucket"]: r["n"] for r in segments.groupBy("bucket").agg(F.sum("tokens").alias("n")).collect()}
    before, run = [], 0
    for b in range(max(totals, default=-1) + 1):
        before.append(run)
        run += totals.get(b, 0)
    return F.get(F.lit(before or [0]).cast("array<bigint>"), F.col("bucket")) + F.col("at")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for base, data in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
            segment = Segment(data.as_buffer())
            rows = []
            for doc_id, begin, end in segment.documents():
                rows.append((doc_id, base + begin, end - begin, zlib.crc32(segment.ids[begin:end].astype("<u4"))))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read(spark, path: str) -> DataFrame:
    """One row per document of the written segments: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)
    placed = segments.select(starts(segments).alias("base"), "data")
    return placed.mapInArrow(_decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def written_and_read(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
