"""Embedding whitening on leading components, found by spectrum slicing of an exactly summed covariance.

Every entry c becomes the integer floor(1024 c) + 100000. Three passes over the vectors, all of them sums per task that meet in a
small aggregate: sums per dimension, products of entries centred at the rounded means, and the covariance of the whitened rows. The
first two are exact integers, so the covariance is exact until its one division. What reaches the driver is one number per pair of
dimensions, whatever the number of rows; so is what the tasks get back.

Defined cases: rows whose vector is null, or holds a null or non-finite entry or one of 2^52 or more (its integer would not fit), are
dropped. An empty vector has no component and so no row. Vectors of different lengths cannot share a covariance: each length is a fit
list of its own, with its own n, components and identity_error. Fewer than eight dimensions give as many components. Where a component
has no variance (its eigenvalue is below 1e-11 of the trace), explained is 0 and whitened null; identity_error then tells about the
others, and is null if there are none. A deviation that does not fit a long is null. Repeated rows and repeated or null vec_ids are rows
like any other; other columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.spectrum import leading

COMPONENTS = 8
STEPS_PER_UNIT = 1024
SHIFT = 100_000
LARGEST = float(1 << 52)
NO_VARIANCE = 1e-11
_SAFE = float(1 << 62)
_EXACT = float(1 << 53)


@dataclass
class Fit:
    """What the tasks need of one length: rows, sums, rounded means, components (columns), their eigenvalues and the trace."""

    n: int
    sums: list[int]
    centre: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows on the components with variance, each divided by its standard deviation."""
        rest = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.centre, strict=True)], object) / self.n
        z = ((x - self.centre).astype(np.float64) - rest.astype(np.float64)) @ self.vectors[:, self.live]
        return z / np.sqrt(self.values[self.live])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row."""
        most = self.n * (float(np.abs(x - self.centre).max()) + 1)
        kind = np.int64 if most * most * len(self.sums) < _SAFE and self.n * float(np.abs(x).max()) < _SAFE else object
        apart = self.n * x.astype(kind) - np.array(self.sums, kind)
        total = [int(t) for t in (apart * apart).sum(1)]
        return [t if t < 1 << 63 else None for t in total]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that are not dropped."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(sound, F.lit(False)))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of a batch, one length after the other."""
    lists = batch.column("embedding")
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        taken = values[ends[rows][:, None] + np.arange(size)]
        yield rows, np.floor(taken * STEPS_PER_UNIT).astype(np.int64) + SHIFT


class Total:
    """An exact sum of integer arrays: machine integers while they are known to fit, then Python's."""

    def __init__(self):
        self.whole, self.part, self.bound = 0, 0, 0.0

    def add(self, values: np.ndarray, bound: float) -> None:
        if bound >= _SAFE or values.dtype == object:
            self.whole = self.whole + values.astype(object)
            return
        if self.bound + bound >= _SAFE:
            self.whole, self.part, self.bound = self.whole + self.part.astype(object), 0, 0.0
        self.part, self.bound = self.part + values, self.bound + bound

    def value(self) -> np.ndarray:
        return self.whole + (self.part.astype(object) if isinstance(self.part, np.ndarray) else 0)


def products(y: np.ndarray) -> np.ndarray:
    """y^T y, exactly: by floating point where every partial sum is an integer below 2^53."""
    most = float(np.abs(y).max()) if y.size else 0.0
    if most * most * len(y) < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    wide = y.astype(object)
    return wide.T @ wide


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple[list[int], Total]] = {}
    for batch in batches:
        for rows, x in by_length(batch):
            count, total = totals.setdefault(x.shape[1], ([0], Total()))
            count[0] += len(rows)
            bound = float(np.abs(x).max()) * len(x)
            total.add((x if bound < _SAFE else x.astype(object)).sum(0), bound)
    for size, (count, total) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([count[0]] * size, pa.int64()), _decimals(total.value())],
            ["size", "at", "n", "s"])


def _products(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Total] = {}
        for batch in batches:
            for _, x in by_length(batch):
                y = x - centres[x.shape[1]]
                total = totals.setdefault(x.shape[1], Total())
                total.add(products(y), float(np.abs(y).max()) ** 2 * len(y))
        for size, total in totals.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(total.value()[i, j])],
                ["size", "i", "j", "s"])
    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of every vector length among `rows` (see `integers`)."""
    summed = rows.mapInArrow(_sums, "size int, at int, n bigint, s decimal(38,0)")
    sums: dict[int, tuple[int, list[int]]] = {}
    for r in summed.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("size", "at").collect():
        sums.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    if not sums:
        return {}
    centres = {size: np.array([round(Decimal(v) / n) for v in s], np.int64) for size, (n, s) in sums.items()}
    multiplied = rows.mapInArrow(_products(centres), "size int, i int, j int, s decimal(38,0)")
    covariance = {size: np.zeros((size, size)) for size in sums}
    for r in multiplied.groupBy("size", "i", "j").agg(F.sum("s").alias("s")).collect():
        n, s = sums[r["size"]]
        m = centres[r["size"]]
        i, j = r["i"], r["j"]
        # Integers up to here; one division, correctly rounded.
        v = (n * int(r["s"]) - (s[i] - n * int(m[i])) * (s[j] - n * int(m[j]))) / (n * n)
        covariance[r["size"]][i, j] = covariance[r["size"]][j, i] = v
    out = {}
    for size, v in covariance.items():
        values, vectors = leading(v, components)
        out[size] = Fit(sums[size][0], sums[size][1], centres[size], vectors, values, float(np.trace(v)))
    return out


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """Per length, the largest entry of |covariance of the whitened rows - identity|, measured on the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch):
                z = fits[x.shape[1]].whitened(x)
                both = np.column_stack([z, np.ones(len(z))])
                totals[x.shape[1]] = totals.get(x.shape[1], 0.0) + both.T @ both
        for size, total in totals.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
                ["size", "i", "j", "s"])

    found: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(run, "size int, i int, j int, s double").groupBy("size", "i", "j").agg(F.sum("s").alias("s")).collect():
        wide = int(fits[r["size"]].live.sum()) + 1
        found.setdefault(r["size"], np.zeros((wide, wide)))[r["i"], r["j"]] = r["s"]
    out: dict[int, float | None] = {}
    for size, total in found.items():
        n, mean = total[-1, -1], total[:-1, -1] / total[-1, -1]
        apart = np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean)))
        out[size] = float(apart.max()) if apart.size else None
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = integers(vectors)
    fits = fit(rows, components)
    errors = identity_errors(rows, fits) if fits else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch):
                f = fits[x.shape[1]]
                k = len(f.values)
                z = np.full((len(x), k), np.nan)
                z[:, f.live] = f.whitened(x)
                share = np.where(f.live, f.values / (f.trace or 1.0), 0.0)
                each = np.repeat(np.arange(len(x)), k)
                dead = np.tile(~f.live, len(x))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), f.n)), pa.array(f.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel(), mask=dead), pa.array(np.tile(share, len(x))), pa.array([errors[x.shape[1]]] * len(each), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(
        run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
