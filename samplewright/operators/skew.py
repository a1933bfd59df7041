"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from samplewright.session import cut

PARTS = 200
MOST_PARTS = 20_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
FILTER_ROWS = 4_000_000  # keys of a bit table: 16 bits each and at most twice as many, 16 MB


def parts(df: DataFrame) -> int:
    """Shares that a big table is thought to be cut into: the session's shuffle partitions, but `PARTS` at least. A key with more
    rows than one share is hot, so there are at most so many hot keys, and both follow the size the session is set up for."""
    return min(MOST_PARTS, max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def ways(count: int, rows: int, shares: int) -> int:
    """How many tasks a hot key is spread over: each gets half a share. All hot keys together get at most 3 x `shares`."""
    return max(2, ceil(2 * count * shares / max(rows, 1)))


def hot_ways(df: DataFrame, key: str) -> dict:
    """The hot keys of a table and their ways. A sketch built in one pass names them; nothing is shuffled by key."""
    n = parts(df)
    top = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {n}, {max(4096, 8 * n)})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return {item["item"]: ways(item["count"], top["n"], n) for item in (top["top"] or []) if item["count"] * n >= top["n"]}


def hot_keys(df: DataFrame, key: str) -> list:
    """The hot keys of a table, the most frequent first."""
    found = hot_ways(df, key)
    return sorted(found, key=found.get, reverse=True)


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: Mapping | Sequence | None = None, salts: int = 32,
    merged: bool = False,
) -> DataFrame:
    """Join `left` to `right`, which holds one row per key, and spread the hot keys of `left` over several tasks.

    `hot` has the ways of every hot key, or names keys that all get `salts` ways; by default a sketch finds both. Only the
    right rows of hot keys are copied, once per way. Which keys count as hot changes the balance, never the result. The
    table of hot keys, at most `parts` rows, is broadcast. `how` is inner, left, left_semi or left_anti. `merged` says that both
    sides are long, so that neither is broadcast whatever size the planner guesses.
    """
    hot = hot_ways(left, key) if hot is None else hot if isinstance(hot, Mapping) else dict.fromkeys(hot, salts)
    if not hot:
        return left.join(right.hint("merge") if merged else right, key, how)
    kind = StructType([StructField(key, left.schema[key].dataType), StructField("_ways", IntegerType())])
    listed = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), kind))
    # Maps cannot be hashed; as text they can.
    hashed = [F.to_json(f"`{n}`") if "map<" in kind else F.col(f"`{n}`") for n, kind in left.dtypes if "void" not in kind]
    spread = F.coalesce(F.pmod(F.xxhash64(*hashed), F.col("_ways")).cast("int"), F.lit(0))
    salted = left.join(listed, key, "left").withColumn("_salt", spread).drop("_ways")
    copies = F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1)
    copied = right.join(listed, key, "left").withColumn("_salt", F.explode(copies)).drop("_ways")
    return salted.join(copied.hint("merge") if merged else copied, [key, "_salt"], how).drop("_salt")


def fits(table: DataFrame) -> bool:
    """Whether a written table is small enough to broadcast: `BROADCAST_ROWS` rows and `BROADCAST_BYTES` bytes at most."""
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*table.columns)))).alias("bytes")).first()
    return size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", count: str | None = None) -> DataFrame:
    """Join rows to a reduced table of one row per key.

    The reduced table is written once and measured. Within the bound above it is broadcast, and `left` is not shuffled
    at all; beyond it the join is salted. `count` names a column of `right` with the number of left rows per key, if it
    is known: hot keys are then read off it, else a sketch over `left` finds them. `count` is dropped from the result.
    """
    reduced = cut(right)
    size = reduced.agg(F.count(F.lit(1)).alias("rows"), *([F.sum(count).alias("left_rows")] if count else [])).first()
    slim = reduced.drop(count) if count else reduced
    if size["rows"] <= BROADCAST_ROWS:
        held = reduced.agg(F.sum(F.octet_length(F.to_json(F.struct(*reduced.columns)))).alias("bytes")).first()["bytes"]
        if (held or 0) <= BROADCAST_BYTES:
            return left.join(F.broadcast(slim), key, how)
    hot = None
    if count:
        n = parts(left)
        # At most one key per share.
        top = reduced.where((F.col(count) * n >= size["left_rows"]) & F.col(key).isNotNull()).select(key, count).collect()
        hot = {row[key]: ways(row[count], size["left_rows"], n) for row in top}
    return salted_join(left, slim, key, how, hot)


def among(rows: DataFrame, key: str, few: DataFrame, n: int, own: str | None = None) -> DataFrame:
    """The rows whose key may be in column `own` (by default `key`) of `few`, a table of `n` rows: all that are, and about one in
    sixteen of the others. Rows without a key go. Beyond `FILTER_ROWS` all rows stay.

    What is broadcast is a table of bits set by the hashes of the keys, so a long table is cut down where it lies before a join
    shuffles it.
    """
    if n > FILTER_ROWS:
        return rows
    if rows.schema[key].dataType != few.schema[own or key].dataType:
        raise ValueError("keys of different types have different hashes")
    bits = max(12, ceil(log2(16 * max(n, 1))))
    at = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(c)), 64 - bits)
    held = few.where(F.col(own or key).isNotNull()).select(at(own or key).alias("_at"))
    words = held.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 as int)))").alias("_bits"))
    lines = words.groupBy(F.shiftright("_word", 6).alias("_line")).agg(
        F.array(*[F.expr(f"coalesce(max(case when _word & 63 = {i} then _bits end), 0L)") for i in range(64)]).alias("_set"))
    placed = rows.where(F.col(key).isNotNull()).withColumn("_at", at(key)).withColumn("_line", F.shiftright("_at", 12))
    met = placed.join(F.broadcast(lines), "_line").where(
        "getbit(get(_set, cast(shiftright(_at, 6) & 63 as int)), cast(_at & 63 as int)) = 1")
    return met.select(*rows.columns)
