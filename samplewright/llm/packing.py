"""Packing of documents into windows of bounded length by Karmarkar-Karp multiway differencing.

A document longer than the window is cut into full windows, each a sequence of its own, and a rest. Rests (short documents are
rests too) are dealt by hash into groups of bounded size, and each group is split into near-equal windows: every rest starts as
a partition of the group into k windows, all but one empty; the two partial partitions with the largest spread between their
fullest and emptiest window are merged, fullest on emptiest, until one is left. Only windows that are not empty are kept. k starts
at the least number that could hold the group. What hangs over the capacity is cut off and fills emptier windows, if cuts are allowed
(`grain`); what cannot be placed so raises k. Without cuts k rises by one as long as the fullest window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm import words
from samplewright.llm.common import texts
from samplewright.session import cut

WINDOW = 4096
GROUP = 2048
GRAIN = 32


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of every item and the windows' sums, by multiway differencing into k windows."""
    n = len(sizes)
    # A node is an item or two nodes that share a window; a partial partition has the sums and nodes of its windows in ascending order.
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    made = n
    heap: list = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size if k > 1 else 0, i, np.array([size]), np.array([i])))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        # The fullest meets the emptiest: what is beyond k windows in both together shares one.
        many = max(0, len(sums) + len(other) - k)
        shared = nodes[:many]
        if many:
            fresh = np.arange(made, made + many)
            left[fresh], right[fresh] = shared, others[:many][::-1]
            made += many
            shared = fresh
        merged = np.concatenate((others[many:][::-1], shared, nodes[many:]))
        sums = np.concatenate((other[many:][::-1], sums[:many] + other[:many][::-1], sums[many:]))
        by = np.argsort(sums, kind="stable")
        sums, merged = sums[by], merged[by]
        least = sums[0] if len(sums) == k else 0
        heapq.heappush(heap, (int(least - sums[-1]), order, sums, merged))
        order += 1
    window = np.full(2 * n, -1)
    if heap:
        top = heap[0][3]
        window[top] = np.arange(k - len(top), k)
        for node in range(made - 1, n - 1, -1):  # later nodes hold earlier ones
            window[left[node]] = window[right[node]] = window[node]
    return window[:n], np.bincount(window[:n], weights=sizes, minlength=k).astype(np.int64)


def windows(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """The window of every item; no window exceeds the capacity. Each size is at most the capacity."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return np.empty(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("an item is larger than a window")
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return window
        k += 1


def _order(window: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """The items of every window."""
    return np.split(np.argsort(window, kind="stable"), np.searchsorted(np.sort(window), np.arange(1, len(sums))))


def _shed(sizes: np.ndarray, window: np.ndarray, sums: np.ndarray, capacity: int, grain: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces (item, at, length, window) with what hangs over cut off and put into the emptiest windows, and the length that
    found no room. Cuts are at multiples of `grain` from an item's start."""
    kept, loose = [], []
    for x, items in enumerate(_order(window, sums)):
        over = int(sums[x]) - capacity
        for i in sorted(items.tolist(), key=lambda i: -sizes[i]):
            size = int(sizes[i])
            stay = size if over <= 0 else max(0, (size - over) // grain * grain)
            over -= size - stay
            if stay:
                kept.append((i, 0, stay, x))
            if stay < size:
                loose.append((i, stay, size - stay))
    room = np.full(len(sums), capacity, np.int64)
    for _, _, length, x in kept:
        room[x] -= length
    free = [(-int(r), x) for x, r in enumerate(room) if r]
    heapq.heapify(free)
    lost = 0
    for i, at, length in sorted(loose, key=lambda piece: -piece[2]):
        while length:
            if not free:
                lost += length
                break
            most, x = heapq.heappop(free)
            taken = length if length <= -most else -most // grain * grain
            if not taken:  # no window has room for a grain
                lost += length
                break
            kept.append((i, at, taken, x))
            at, length = at + taken, length - taken
            if -most > taken:
                heapq.heappush(free, (most + taken, x))
    return kept, lost


def filled(sizes: np.ndarray, capacity: int = WINDOW, grain: int = GRAIN) -> tuple[np.ndarray, int]:
    """Rows (item, at, length, window) of near-full windows, and how often differencing ran.

    Near-equal windows of the least number are made by differencing; what hangs over the capacity is cut off and put into windows
    that have room. If that is not enough, because cuts lie at multiples of `grain`, the number rises by what is left over.
    """
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("an item is larger than a window")
    k, runs = max(1, -(-int(sizes.sum()) // capacity)), 0
    while True:
        window, sums = differencing(sizes, k)
        runs += 1
        rows, lost = _shed(sizes, window, sums, capacity, grain)
        if not lost:
            return np.array(rows, np.int64).reshape(-1, 4), runs
        k += -(-lost // capacity)


#: The reversed polynomial of CRC-32, a fixed value.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, the highest bit being the power zero."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(4096)
def _zeros(length: int) -> int:
    """x^(8 length): what a checksum is multiplied by when so many bytes follow."""
    out, power = 1 << 31, 1 << 23
    while length:
        if length & 1:
            out = _times(out, power)
        power, length = _times(power, power), length >> 1
    return out


def crc_between(before: int, through: int, length: int) -> int:
    """CRC-32 of a run of bytes, from those of everything before it and of everything through its end."""
    return through ^ _times(before, _zeros(length))


def _pieces(path: str, end: int, capacity: int, grain: int | None):
    def marked(ids: memoryview, a: int, b: int) -> tuple[int, bytes]:
        """The checksum of ids a to b, and those of its beginnings, one per `grain` ids."""
        crc, marks = 0, []
        for at in range(a, b, grain):
            crc = zlib.crc32(ids[4 * at:4 * min(at + grain, b)], crc)
            marks.append(crc)
        return crc, np.array(marks[:-1], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words.encoder(path)
        for batch in words.portions(batches, "text"):
            ids, bounds = encoder.encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end).astype("<u4")
            sizes = np.diff(bounds) + 1
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = (bounds[:-1] + np.arange(len(sizes)))[doc] + start
            if grain:
                raw = memoryview(ids).cast("B")
                both = [marked(raw, a, b) if b - a < capacity else (zlib.crc32(raw[4 * a:4 * b]), b"") for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            else:
                both = [(zlib.crc32(ids[a:b]), b"") for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([c for c, _ in both], pa.int64()),
                 pa.array(sizes[doc]), pa.array([m for _, m in both], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks"])
    return run


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_PLACED = _PIECES + ", sequence_id bigint, offset bigint"


def _rows(lengths: np.ndarray, capacity: int, grain: int | None) -> np.ndarray:
    """(item, at, length, window) of a group's pieces."""
    if grain:
        return filled(lengths, capacity, grain)[0]
    return np.column_stack([np.arange(len(lengths)), np.zeros_like(lengths), lengths, windows(lengths, capacity)])


def _checksum(crc: int, marks: bytes, at: int, length: int, whole: int, grain: int | None) -> int:
    if length == whole:
        return crc
    known = np.frombuffer(marks, "<u4")
    upto = lambda n: 0 if n == 0 else crc if n == whole else int(known[n // grain - 1])
    return crc_between(upto(at), upto(at + length), 4 * length)


def _packed(capacity: int, grain: int | None):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("piece", "ascending")])
        lengths = group.column("length").to_numpy()
        item, at, length, window = _rows(lengths, capacity, grain).T
        order = np.argsort(window, kind="stable")
        sums = np.cumsum(length[order]) - length[order]
        offset = np.empty(len(length), np.int64)
        offset[order] = sums - sums[np.searchsorted(window[order], window[order])]
        crcs, marks = group.column("ids_crc32").to_pylist(), group.column("marks").to_pylist()
        crc = [_checksum(crcs[i], marks[i], a, n, int(lengths[i]), grain) for i, a, n in zip(item.tolist(), at.tolist(), length.tolist(), strict=True)]
        of = pa.array(item)
        number = group.column("part")[0].as_py() * (2 << 20) + window * 2 + 1
        return pa.table({
            "doc_id": group.column("doc_id").take(of), "start": pa.array(group.column("start").to_numpy()[item] + at), "length": pa.array(length),
            "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": group.column("doc_tokens").take(of), "sequence_id": pa.array(number),
            "offset": pa.array(offset)})
    return run


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = WINDOW, group: int = GROUP, grain: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with the id `end`, so an empty or null text is one piece of length 1. Sequences of full windows have
    even numbers and packed ones odd numbers. Only piece descriptions are shuffled, never ids. Rows that repeat a document are
    dealt out by their own row, so a hot id does not gather in one group. With `grain`, a rest that hangs over its window may be cut
    at a multiple of so many ids; the checksums of its beginnings travel with it, so no id is read again.
    """
    coded = texts(docs).mapInArrow(_pieces(tokenizer, end, capacity, grain), _PIECES + ", marks binary")
    pieces = cut(coded.withColumn("piece", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).select(
        *_PIECES.replace(" bigint", "").split(", "), (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)).cast("bigint"))
    return full.unionAll(dealt.groupBy("part").applyInArrow(_packed(capacity, grain), _PLACED))
