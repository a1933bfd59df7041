"""Connected components of a link table, one label per node, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.session import cut


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """`links` has two columns `a` and `b`; the result has `node` and `root`, the smallest node reachable.

    Each round first ties every node's larger neighbours to its smallest neighbour, then ties a node's smaller neighbours
    together; a path's length shrinks by a factor each time, and rows never grow. Both steps are a `min` per node, combined
    before the shuffle, and a join that adaptive execution splits where a hub has many links. Every round is written to the
    shared folder, so a lost executor costs no earlier round. Nulls and self-links are ignored; repeated links count once.
    """
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    links = cut(links.where("a is not null and b is not null and a <> b").select(*ordered).distinct())
    seen = None
    for _ in range(rounds):
        stamp = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp[0] == 0 or stamp == seen:
            break
        seen = stamp
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").select(*ordered).distinct())
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    # Every remaining link ties a node to its root.
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
