"""First, last, n-th: row order made explicit, without a single task that holds everything.

Spark has no row order of its own, so every function names the ordering columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.operators.skew import lookup_join
from samplewright.session import cut, scratch_path

_RUNS_BOUND = 200_000


def dense_index(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "n", start: int = 1
) -> DataFrame:
    """Number the rows `start, start+1, …` in `order`, afresh for every value of `by`.

    The rows are range-partitioned on (by, order), so even a group that holds most rows is spread over tasks. Each
    task then only needs to know how many rows of its group lie in earlier partitions. The laid-out rows are written
    once: the offsets and the rows must come from one and the same layout.
    """
    keys = [*by, *order]
    laid = cut(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    runs = cut(laid.groupBy(*by, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows")))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(b).alias(f"_{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), "_from",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    if not by or runs.limit(_RUNS_BOUND + 1).count() <= _RUNS_BOUND:
        runs = F.broadcast(runs)  # one row per partition and group, counted above
    on = reduce(
        lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{i}")) for i, b in enumerate(by)], F.col("_part") == F.col("_p")
    )
    number = (F.col("_before") + F.col("_at") - F.col("_from") + start).cast("bigint")
    return laid.join(runs, on).select(*df.columns, number.alias(name))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the first row in `order`. Combined before the shuffle, so hot keys are cheap."""
    return _one_by(df, keys, order, values, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the last row in `order`."""
    return _one_by(df, keys, order, values, F.max_by)


def _one_by(df, keys, order, values, pick) -> DataFrame:
    got = df.groupBy(*keys).agg(pick(F.struct(*values), F.struct(*order)).alias("_v"))
    return got.select(*keys, *[F.col("_v")[v].alias(v) for v in values])


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, name: str = "rank") -> DataFrame:
    """The first `k` rows per group, for reports. Spark cuts every task's share to `k` rows before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def later_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Every row but the first of its key, with the first row's `order` and `carry` columns as `first_*`.

    `order` must tell the rows of a key apart, as a row number does.

    Keys seen once are dropped by the aggregate, so only repeated keys are joined back, as a reduced table.
    """
    cols = list(dict.fromkeys([*order, *carry]))
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    keyed = df.withColumn("_key", key)
    firsts = (
        keyed.groupBy("_key").agg(F.min(F.struct(*cols)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    return (
        lookup_join(keyed, firsts, "_key", count="_n")
        .where(F.struct(*order) > F.struct(*[F.col("_first")[c].alias(c) for c in order]))
        .select(*df.columns, *[F.col("_first")[c].alias(f"first_{c}") for c in cols])
    )


def row_slice(df: DataFrame, order: Sequence[str], span: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Rows `N-M`, counted from 1 and inclusive, or the rows listed in `rows(n)`. A span wins over a list."""
    numbered = dense_index(df, order, name="row_no")
    if span is not None:
        low, high = (int(x) for x in span.split("-"))
        return numbered.where(F.col("row_no").between(low, high))
    return numbered.join(rows.select(F.col("n").alias("row_no")).distinct(), "row_no", "left_semi")


class PageIndex:
    """A sorted copy of a table in key ranges, with the number of rows of each, kept so that a page opens only what it shows.

    The copy is a folder per range under `path`; the counts, one row per range, are beside it. `order` must tell rows apart where
    the place of equal rows matters.
    """

    def __init__(self, spark: SparkSession, path: str):
        head = spark.read.parquet(f"{path}/head").first()
        self.path, self.order = path, list(head["order"])
        self.rows = spark.read.schema(head["schema"]).parquet(f"{path}/rows")
        # One row per range, at most as many as there were shuffle partitions.
        self.sizes = [(r["_range"], r["n"]) for r in spark.read.parquet(f"{path}/sizes").orderBy("_range").collect()]

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[str], path: str | None = None, ranges: int | None = None) -> PageIndex:
        spark = df.sparkSession
        path = path or scratch_path(spark, "pages")
        laid = df.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
        laid.write.partitionBy("_range").parquet(f"{path}/rows")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
        sizes = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        sizes.coalesce(1).write.parquet(f"{path}/sizes")
        spark.createDataFrame([(list(order), schema)], "order array<string>, schema string").coalesce(1).write.parquet(f"{path}/head")
        return cls(spark, path)

    def __len__(self) -> int:
        return sum(n for _, n in self.sizes)

    def between(self, first: int, last: int) -> DataFrame:
        """Rows `first` to `last` of the order, counted from 1 and inclusive."""
        opened, before, skip = [], 0, None
        for number, n in self.sizes:
            if before < last and before + n >= first:
                skip = first - 1 - before if skip is None else skip
                opened.append(number)
            before += n
        if not opened:
            return self.rows.drop("_range").limit(0)
        held = self.rows.where(F.col("_range").isin(opened)).orderBy(*self.order).drop("_range")
        return held.offset(max(0, skip)).limit(last - first + 1)

    def page(self, number: int = 1, size: int = 100) -> DataFrame:
        _check_page(number, size)
        return self.between((number - 1) * size + 1, number * size)


def _check_page(number: int, size: int) -> None:
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("page numbers start at 1 and a page holds 1 to 1000 rows")


def page(
    df: DataFrame, order: Sequence[str], number: int = 1, size: int = 100, shallow: int = 100_000, index: PageIndex | None = None
) -> DataFrame:
    """One page, counted from 1; the size is at most 1000. Deep pages come from a page index: pass one to open many pages of a
    table, else it is built for this page."""
    _check_page(number, size)
    skip = (number - 1) * size
    if index is None and skip + size <= shallow:
        return df.orderBy(*order).offset(skip).limit(size)
    return (index or PageIndex.build(df, order)).page(number, size)
