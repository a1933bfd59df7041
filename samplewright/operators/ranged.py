"""Tables laid out in key ranges, one folder each, so that work can be kept to the ranges that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RANGES = 1 << 14
_PER_RANGE = 20


def range_bounds(df: DataFrame, key: str, ranges: int) -> list[str]:
    """At most `ranges - 1` ascending keys that cut the rows into runs of about equal length, from the keys with the smallest
    hashes: twenty per range reach the driver. Equal keys hash alike, so they are drawn once."""
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2:
        return []
    drawn = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(ranges * _PER_RANGE)
    keys = sorted(r["k"] for r in drawn.collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def range_of(key: str, bounds: Sequence[str]) -> Column:
    """Number of the bounds that are not above the key: an expression, so it is worked out where the row is. Null keys get 0.

    The bounds are halved once per binary digit of their number.
    """
    if not bounds:
        return F.lit(0)
    points, width = F.lit(list(bounds)), 1 << (len(bounds).bit_length() - 1)
    place = F.lit(0)
    halves = []
    while width:
        halves.append(width)
        width //= 2

    def passed(at: Column, step: Column) -> Column:
        inside = at + step <= len(bounds)
        return F.when(inside & (F.get(points, F.least(at + step, F.lit(len(bounds))) - 1) <= F.col(key)), at + step).otherwise(at)

    return F.aggregate(F.lit(halves), place, passed)


def in_ranges(df: DataFrame, ranges: Sequence[int]) -> DataFrame:
    """The rows of some range folders; the others are not opened."""
    return df.where(F.col("range").isin(list(ranges))) if ranges else df.limit(0)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table, or None if nothing was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
