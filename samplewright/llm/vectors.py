"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosines.

Unit vectors with cosine c are sqrt(2 - 2c) apart. A hash is a random projection, shifted and cut into cells of equal width; a
table's key is `k` such cells, and vectors are compared where they share the key of any of the tables. `plan` gives the number
of hashes and tables, by the distances that a bounded sample of the vectors shows: enough tables that a pair right at the threshold
is found with the wanted probability (closer pairs are found more surely), at the least cost for this number of rows.

A pair that shares several keys is counted in the first table only. Pairs are compared in blocks and never become rows: a task
passes on, per vector, the number of links and one tie that keeps its links connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.components import components
from samplewright.session import cut

THRESHOLD = 0.9
RECALL = 0.97
BLOCK = 2048
#: Vectors that the plan looks at, at most.
SAMPLE = 1000
# Microseconds, about: a table's entry of a row, a copy of a row in a shared key, a dot product.
_ENTRY, _COPY, _PAIR = 3.0, 8.0, 0.4


def same_cell(distance: float, width: float) -> float:
    """Probability that two points at a distance fall into one cell of a random projection."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(
    rows: int, threshold: float = THRESHOLD, recall: float = RECALL, law: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[float, int, int]:
    """Cell width, hashes per table and tables. Recall at the threshold is the same for every choice; of these the one is taken that
    costs least at this number of rows: an entry per row and table, a copy of every row that shares its key, and a dot product
    per pair that does. `law` has distances of unrelated vectors and their shares; without it they are at right angles."""
    apart = math.sqrt(2 - 2 * threshold)
    distances, shares = law if law is not None and len(law[0]) else (np.array([math.sqrt(2)]), np.array([1.0]))
    best = None
    for times in (2, 3, 4, 5, 6, 8):
        width = times * apart
        near, far = same_cell(apart, width), np.array([same_cell(d, width) for d in distances])
        for k in range(4, 80):
            if near**k < 1e-5:
                break
            tables = math.ceil(math.log(1 - recall) / math.log(1 - near**k))
            met = rows * float((shares * far**k).sum())
            cost = tables * rows * (_ENTRY + _COPY * (1 - math.exp(-met)) + _PAIR * met / 2)
            if best is None or cost < best[0]:
                best = cost, width, k, tables
    return best[1:]


def distance_law(classes: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Distances of unrelated unit vectors, and their shares, among at most `sample` vectors: those with the smallest hashes. Only
    the plan depends on them, so no link does. Vectors nearer than the threshold are related and left out, as is all but the
    most common length."""
    drawn = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).collect()
    if len(drawn) < 2:
        return np.zeros(0), np.zeros(0)
    sizes = [len(r["embedding"]) for r in drawn]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    x = units([np.array(r["embedding"], np.float64).tobytes() for r in drawn if len(r["embedding"]) == dim], dim, "<f8")
    cosine = (x @ x.T)[np.triu_indices(len(x), 1)]
    count, edges = np.histogram(np.sqrt(2 - 2 * np.clip(cosine[cosine < threshold], -1, 1)), 200, (0, 2))
    middle = (edges[1:] + edges[:-1]) / 2
    return (middle[count > 0], count[count > 0] / count.sum()) if count.sum() else (np.zeros(0), np.zeros(0))


def units(rows: list[bytes] | bytes, dim: int, dtype: str) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so no square runs over."""
    x = np.frombuffer(b"".join(rows) if isinstance(rows, list) else rows, dtype).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_size(raws: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(bytes of a vector, its rows, their bytes in a row) for every length in a binary column."""
    sizes = pc.binary_length(raws).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        some = raws.take(pa.array(rows)).cast(pa.large_binary())
        yield size, rows, some.buffers()[2]


def _keys(width: float, k: int, tables: int, dtype: str, seed: int = 5):
    """(rep, n, raw) to the same with `keys`, one 32-bit key per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = np.dtype(dtype).itemsize
        made: dict[int, tuple] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = np.zeros((batch.num_rows, tables), np.int32)
                for size, members, raw in _by_size(batch.column("raw")):
                    dim = size // item
                    if dim not in made:
                        rng = np.random.default_rng([seed, dim])
                        made[dim] = (rng.standard_normal((dim, tables * k)), rng.random(tables * k) * width, rng.integers(1, 1 << 62, (tables, k)) | 1)
                    directions, shift, mixers = made[dim]
                    x = units(raw, dim, dtype)
                    cells = np.floor((x @ directions + shift) / width).astype(np.int64).reshape(len(members), tables, k)
                    mixed = (cells * mixers[None]).sum(2) + dim
                    mixed ^= mixed >> 29
                    mixed *= 0x2545F4914F6CDD1D
                    keys[members] = (mixed >> 32).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("raw"), lists], ["rep", "n", "raw", "keys"])
    return run


def _tie(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the label trees of every pair; a label is the smallest index of its tree."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _found(rows: dict[str, np.ndarray], x: np.ndarray, earlier: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links per row (copies counted) and a label per row, for rows sorted so that equal groups follow one another."""
    group, n, block, low, high, table = (rows[c] for c in ("group", "n", "block", "low", "high", "table"))
    count, label = np.zeros(len(group), np.int64), np.arange(len(group))
    at = np.arange(len(group))
    step = 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return count, label
        for part in np.array_split(at, max(1, len(at) // 4096)):
            a, b = part, part + step
            meet = (np.minimum(block[a], block[b]) == low[a]) & (np.maximum(block[a], block[b]) == high[a])
            a, b = a[meet], b[meet]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[near], b[near]
            if len(a):
                seen = ((earlier[a] == earlier[b]) & (np.arange(earlier.shape[1]) < table[a][:, None])).any(1)
                a, b = a[~seen], b[~seen]
                np.add.at(count, a, n[b])
                np.add.at(count, b, n[a])
                label = _tie(label, a, b)
        step += 1


def _compared(dtype: str, threshold: float, tables: int):
    """Sorted rows of buckets to (rep, links, root): one row per vector and bucket in which it found a link."""
    item = np.dtype(dtype).itemsize

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        """Whether a row begins a bucket."""
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for name in ("table", "key", "low", "high"):
            values = batch.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return new

    def answer(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(changes(rows))
        names = ("rep", "n", "block", "low", "high", "table")
        cols = {name: rows.column(name).to_numpy().astype(np.int64) for name in names} | {"group": group}
        lists = rows.column("keys")
        keys = lists.flatten().to_numpy().reshape(-1, tables)
        for size, members, raw in _by_size(rows.column("raw")):
            some = {name: values[members] for name, values in cols.items()}
            count, label = _found(some, units(raw, size // item, dtype), keys[members], threshold)
            hit = np.flatnonzero(count)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some["rep"][hit]), pa.array(count[hit]), pa.array(some["rep"][label[hit]])], ["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                joined = pa.concat_batches([*held, whole.slice(at, 4000)])
                last = int(np.flatnonzero(changes(joined))[-1])
                if last:
                    yield from answer(joined.slice(0, last))
                held = [joined.slice(last)]  # the last bucket may go on in the next batch
        if held:
            yield from answer(held[0])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing and are kept. Equal vectors are
    one class from the start: its copies are linked to each other and count one by one in n_links, but only the class is hashed
    and compared. Vectors of different length never link. A bucket with more than `block` classes is compared in pairs of
    blocks, so a hot bucket spreads over many tasks and none holds more than two blocks. Rows with a null vec_id are kept, count
    as links of others, and have a null component_id unless linked to a row that has an id.
    """
    kind = dict(vectors.dtypes)["embedding"]
    dtype, cast = ("<f4", "array<float>") if kind == "array<float>" else ("<f8", "array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(cast).alias("embedding"))
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce((F.size("embedding") > 0) & sound & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
    held = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    width, k, tables = plan(held.count(), threshold, recall, distance_law(held, threshold))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.diff(lists.offsets.to_numpy()).cumsum()
            raw = [v.tobytes() for v in np.split(values, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(raw, pa.binary())], ["rep", "n", "raw"])

    raw = held.select("rep", "n", "embedding").mapInArrow(packed, "rep bigint, n bigint, raw binary")
    keyed = cut(raw.mapInArrow(_keys(width, k, tables, dtype), "rep bigint, n bigint, raw binary, keys array<int>"))
    entries = keyed.select("rep", F.posexplode("keys").alias("table", "key"))
    sizes = entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    shared = entries.join(sizes, ["table", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(j, F.col("block")).alias("low"), F.greatest(j, F.col("block")).alias("high")))
    dealt = shared.select("rep", "table", "key", "block", F.inline(pairs)).join(keyed, "rep")
    laid = dealt.repartition("table", "key", "low", "high").sortWithinPartitions("table", "key", "low", "high", "rep")
    laid = laid.select("table", "key", "low", "high", "block", "rep", "n", "raw", "keys")
    found = cut(laid.mapInArrow(_compared(dtype, threshold, tables), "rep bigint, links bigint, root bigint"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    rooted = held.join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = rooted.join(least, "root").join(counts, "rep", "left").select(
        "embedding", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
