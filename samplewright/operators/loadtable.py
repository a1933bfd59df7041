"""A stored sample table that loads change range by range.

Rows lie in folders of uid ranges. Beside them, each range has its lowest and highest uid and a blocked Bloom filter of its uids, so
a load finds without reading rows which uploaded uids are surely new. New rows are appended to their ranges; only ranges with
updated rows are rewritten, by dynamic partition overwrite; all other folders keep their files.

A load is first written as a plan and logged, then applied, then logged as done. A load that was cut off is applied again from its
plan before anything else happens, and a load that is done answers with what it did, so a load can be sent again at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.operators.ranged import in_ranges, range_bounds, range_of, stored
from samplewright.session import cut, scratch_path

_BLOCK_BITS = 1 << 15  # one row of Spark's bitmap functions
_PROBES = 4
_BITS_PER_ROW = 12


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("uid"), blocks)


def _bits() -> list[Column]:
    """A uid's bits in its block."""
    return [F.pmod(F.xxhash64("uid", F.lit(i)), F.lit(_BLOCK_BITS)) for i in range(_PROBES)]


def bloom_rows(uids: DataFrame) -> DataFrame:
    """(range, blocks, block, bits) of `uids(range, uid)`: a row of 4 KB per block, one block per 2,700 uids or so."""
    sized = uids.groupBy("range").agg(F.ceil(F.count(F.lit(1)) * _BITS_PER_ROW / F.lit(_BLOCK_BITS)).alias("blocks"))
    each = uids.join(sized, "range").select("range", "blocks", _block(F.col("blocks")).alias("block"), F.explode(F.array(*_bits())).alias("bit"))
    return each.groupBy("range", "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(keys: DataFrame, blooms: DataFrame) -> DataFrame:
    """`keys(range, uid, …)` with `_maybe`: false where the range surely does not hold the uid."""
    sized = blooms.select("range", "blocks").distinct()
    placed = keys.join(sized, "range", "left").withColumn("block", _block(F.coalesce("blocks", F.lit(1))))
    hit = F.lit(True)
    for bit in _bits():
        byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    met = placed.join(blooms.select("range", "block", "bits"), ["range", "block"], "left")
    return met.withColumn("_maybe", F.coalesce(hit, F.lit(False))).select(*keys.columns, "_maybe")


class LoadTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.parquet(f"{path}/head").first()
        self.bounds, self.schema = list(head["bounds"]), head["schema"]
        self.columns = [c for c in head["columns"] if c != "uid"]

    @classmethod
    def create(cls, rows: DataFrame, ranges: int | None = None, path: str | None = None) -> LoadTable:
        """Lay out `rows`, one per uid; rows without a uid are kept in range -1."""
        spark = rows.sparkSession
        path = path or scratch_path(spark, "load-table")
        bounds = range_bounds(rows, "uid", ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
        cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
        spark.createDataFrame(
            [(bounds, ", ".join([*cols, "`range` int"]), rows.columns)], "bounds array<string>, schema string, columns array<string>").coalesce(1).write.parquet(
                f"{path}/head")
        table = cls(spark, path)
        table._placed(rows).repartition("range").write.partitionBy("range").parquet(f"{path}/rows")
        table._refresh(None)
        return table

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("range", F.when(t.is_blank("uid"), -1).otherwise(range_of("uid", self.bounds)))

    @property
    def rows(self) -> DataFrame:
        """All rows with their range, as the files are now."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _refresh(self, ranges: list[int] | None) -> None:
        """Write bounds and filters of some ranges, or of all, anew."""
        uids = (self.rows if ranges is None else in_ranges(self.rows, ranges)).where("range >= 0").select("range", "uid")
        stats = uids.groupBy("range").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), F.count(F.lit(1)).alias("n"))
        for name, df in (("stats", stats), ("blooms", bloom_rows(uids))):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema + ", range int").parquet(f"{self.path}/{name}")

    def _log(self) -> dict[str, set[str]]:
        """States of each load: one row per load and state."""
        log, out = stored(self.spark, f"{self.path}/log"), {}
        for r in log.collect() if log is not None else []:
            out.setdefault(r["load_id"], set()).add(r["state"])
        return out

    def _note(self, load_id: str, state: str) -> None:
        self.spark.createDataFrame([(load_id, state)], "load_id string, state string").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def plan(self, upload: DataFrame, update_existing: bool, conflicts: Sequence[str], order: Sequence[str] | None) -> DataFrame:
        """One row per uploaded uid: range, uid, outcome (inserted, skipped, updated, conflict) and the row as `new`."""
        row = F.struct(*self.columns)
        first = upload.where(~t.is_blank("uid")).groupBy("uid").agg(F.min_by(row, F.struct(*(order or self.columns))).alias("new"))
        new = cut(self._placed(first))
        stats = self._read("stats", "low string, high string, n bigint").select("range", "low", "high")
        within = new.join(stats, "range", "left").withColumn("_in", F.coalesce(F.col("uid").between(F.col("low"), F.col("high")), F.lit(False)))
        asked = may_hold(within.where("_in").select("range", "uid"), self._read("blooms", "blocks bigint, block bigint, bits binary"))
        asked = cut(asked.where("_maybe").select("range", "uid"))
        opened = [r["range"] for r in asked.select("range").distinct().collect()]  # one number per range
        old = in_ranges(self.rows, opened).join(asked, ["range", "uid"], "left_semi").select("uid", row.alias("old"))
        clash = F.lit(False)
        for c in conflicts:
            clash = clash | ~F.col("old")[c].eqNullSafe(F.col("new")[c])
        outcome = F.when(F.col("old").isNull(), "inserted").when(clash, "conflict").otherwise("updated" if update_existing else "skipped")
        return new.join(old, "uid", "left").select("range", "uid", outcome.alias("outcome"), "new")

    def load(
        self, upload: DataFrame, load_id: str, update_existing: bool = False, conflicts: Sequence[str] = ("sampletype",),
        order: Sequence[str] | None = None,
    ) -> DataFrame:
        """Load rows under a name of the caller's and return (uid, outcome) of every uploaded uid. Of rows that share a uid the
        first in `order` counts; a row whose `conflicts` columns disagree with the stored row is refused, alone."""
        states = self.recover()
        if load_id not in states:
            self.plan(upload, update_existing, conflicts, order).write.mode("overwrite").parquet(self._plan_path(load_id))
            self._note(load_id, "planned")
            self._apply(load_id, again=False)
        return self.spark.read.parquet(self._plan_path(load_id)).select("uid", "outcome")

    def recover(self) -> set[str]:
        """Finish loads that were planned and not done; names of all loads."""
        log = self._log()
        for load_id, states in log.items():
            if "done" not in states:
                self._apply(load_id, again=True)
        return set(log)

    def _plan_path(self, load_id: str) -> str:
        return f"{self.path}/plans/{load_id}"

    def _apply(self, load_id: str, again: bool) -> None:
        plan = self.spark.read.parquet(self._plan_path(load_id))
        touched = plan.where("outcome in ('inserted', 'updated')").groupBy("range").agg(F.max(F.col("outcome") == "updated").alias("rewrite")).collect()
        rewrite = [r["range"] for r in touched if r["rewrite"]]
        append = [r["range"] for r in touched if not r["rewrite"]]
        fresh = plan.where("outcome in ('inserted', 'updated')").select("uid", "new.*", "range").select("uid", *self.columns, "range")
        if append:
            rows = in_ranges(fresh, append)
            if again:  # an append that had ended is not made twice
                rows = rows.join(in_ranges(self.rows, append).select("range", "uid"), ["range", "uid"], "left_anti").select("uid", *self.columns, "range")
            self._write(rows, "append")
        if rewrite:
            changed = in_ranges(fresh, rewrite)
            kept = in_ranges(self.rows, rewrite).join(changed.select("range", "uid"), ["range", "uid"], "left_anti")
            # Rows that are read from the folders being replaced are written elsewhere first.
            self._write(cut(kept.select("uid", *self.columns, "range").unionByName(changed)), "overwrite")
        if touched:
            self._refresh([r["range"] for r in touched])
        self._note(load_id, "done")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("range").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(f"{self.path}/rows")
