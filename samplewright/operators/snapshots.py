"""Snapshots of a keyed table with a digest per key range: two are compared by reading only the ranges that differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import COMPARE_COLUMNS
from samplewright.operators.diff import field_diff, key_diff
from samplewright.operators.ranged import in_ranges, range_bounds, range_of
from samplewright.operators.ranking import last_by
from samplewright.session import scratch_path


class Snapshot:
    """One row per key, the last in order, with compared cells in normal form, in folders of key ranges.

    The digest of a range is the number of its rows and two sums over hashes of whole rows: it does not depend on their order. Two
    snapshots can be compared if they have the same bounds, so a later one is built `like` the one before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.parquet(f"{path}/head").first()
        self.keys, self.columns, self.bounds = list(head["keys"]), list(head["columns"]), list(head["bounds"])
        self.rows = spark.read.schema(head["schema"]).parquet(f"{path}/rows")
        self.digests = spark.read.parquet(f"{path}/digests")

    @classmethod
    def build(
        cls, df: DataFrame, keys: Sequence[str] = ("sampletype", "uid"), order: Sequence[str] = ("row_n",),
        columns: Sequence[str] = COMPARE_COLUMNS, like: Snapshot | None = None, ranges: int | None = None, path: str | None = None,
    ) -> Snapshot:
        """Write a snapshot of `df`; rows with a blank last key are left out. Ranges follow the last key."""
        spark = df.sparkSession
        path = path or scratch_path(spark, "snapshot")
        cols = [c for c in columns if c in df.columns and c not in keys]
        kept = df.where(~t.is_blank(keys[-1]))
        bounds = like.bounds if like else range_bounds(kept, keys[-1], ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
        cells = kept.select(*keys, *order, *[t.norm(c).alias(c) for c in cols])
        last = last_by(cells, list(keys), list(order), cols) if cols else cells.select(*keys).distinct()
        placed = last.withColumn("range", range_of(keys[-1], bounds))
        laid = placed.repartition("range").sortWithinPartitions("range", keys[-1])
        laid.write.partitionBy("range").parquet(f"{path}/rows")
        rows = spark.read.schema(laid.schema).parquet(f"{path}/rows")
        names = [*keys, *cols]
        a, b = F.xxhash64(*names), F.xxhash64(F.lit(1), *names)
        digests = rows.groupBy("range").agg(
            F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(20,0)")).alias("total"), F.bit_xor(b).alias("mixed"))
        digests.coalesce(1).write.parquet(f"{path}/digests")  # one row per range
        head = [(list(keys), cols, list(bounds), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields))]
        spark.createDataFrame(head, "keys array<string>, columns array<string>, bounds array<string>, schema string").coalesce(1).write.parquet(
            f"{path}/head")
        return cls(spark, path)

    def changed(self, other: Snapshot) -> list[int]:
        """Ranges whose digests differ, or that only one of the two has."""
        if self.bounds != other.bounds:
            raise ValueError("build the later snapshot like the earlier one")
        both = self.digests.withColumn("side", F.lit(1)).union(other.digests.withColumn("side", F.lit(2)))
        same = both.groupBy("range").agg(F.count(F.lit(1)).alias("sides"), F.count_distinct("n", "total", "mixed").alias("digests"))
        return sorted(r["range"] for r in same.where("sides < 2 or digests > 1").select("range").collect())  # one number per range

    def key_changes(self, other: Snapshot) -> DataFrame:
        """Keys that only one of the snapshots has: (keys…, side left_only or right_only)."""
        ranges = self.changed(other)
        return key_diff(in_ranges(self.rows, ranges), in_ranges(other.rows, ranges), self.keys).where("side <> 'common'")

    def key_diff(self, other: Snapshot) -> DataFrame:
        """Every key with its side. Keys of unchanged ranges are common: they are read from one side and not shuffled."""
        ranges = self.changed(other)
        moved = key_diff(in_ranges(self.rows, ranges), in_ranges(other.rows, ranges), self.keys)
        still = self.rows.where(~F.col("range").isin(ranges)) if ranges else self.rows
        return moved.unionByName(still.select(*self.keys, F.lit("common").alias("side")))

    def field_diff(self, other: Snapshot) -> DataFrame:
        """Differing fields of common keys: (keys…, field, left_value, right_value)."""
        ranges = self.changed(other)
        columns = list(dict.fromkeys([*self.columns, *other.columns]))
        return field_diff(in_ranges(self.rows, ranges), in_ranges(other.rows, ranges), self.keys, [self.keys[-1]], columns)
