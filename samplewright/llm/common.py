"""Helpers shared by the operators: clean inputs, ordered buckets, a keyed link graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 1 << 16


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns the operators read; a null text is the empty text. Other columns are left behind."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def bucket_count(df: DataFrame) -> int:
    """As many ordered buckets as there are shuffle partitions, so that the session's setting decides their size."""
    return max(1, min(MOST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most `parts - 1` ascending ids that cut the rows into runs of about equal length. Only the id column is read, and
    only the cut points reach the driver."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts)).alias("cuts")).first()["cuts"]
    return sorted(set(got or []))


def bucket_of(key: Column, cuts: Sequence[int]) -> Column:
    """Number of cut points that are not above `key`, by binary search: later buckets hold larger ids. A null key is in bucket 0."""
    n = len(cuts)
    if not n:
        return F.lit(0)
    points, steps = F.lit(list(cuts)), F.lit([1 << i for i in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(points, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at))
