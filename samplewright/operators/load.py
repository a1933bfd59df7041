"""Bulk load: merging uploads into existing rows, totals, and grouped retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.operators.ranking import later_rows


def merge_load(
    existing: DataFrame, upload: DataFrame, update_existing: bool = False, conflicts: Sequence[str] = ("sampletype",),
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The table after a load, with the `outcome` of each row.

    Outcomes: kept (not in the upload), inserted, skipped (already there), updated, and conflict for an upload row
    whose `conflicts` columns disagree with the stored row: it is refused, alone. Both tables have the same columns, and
    `existing` one row per uid. Of upload rows that share a uid the first in `order` counts, so the result has one row per
    uid; the others, and rows without a uid, are what `refused` returns. Stored rows without a uid are kept.
    """
    cols = [c for c in existing.columns if c != "uid"]
    row = F.struct(*cols)
    old = existing.where(~t.is_blank("uid")).select("uid", row.alias("_old"))
    new = upload.where(~t.is_blank("uid")).groupBy("uid").agg(F.min_by(row, F.struct(*(order or cols))).alias("_new"))
    met = old.join(new, "uid", "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    clash = F.lit(False)
    for c in conflicts:
        clash = clash | ~F.col("_old")[c].eqNullSafe(F.col("_new")[c])
    outcome = (
        F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(both & clash, "conflict")
        .otherwise("updated" if update_existing else "skipped")
    )
    row = F.when(F.col("outcome").isin("inserted", "updated"), F.col("_new")).otherwise(F.col("_old"))
    done = met.withColumn("outcome", outcome).withColumn("_row", row).select(
        "uid", *[F.col("_row")[c].alias(c) for c in cols], "outcome")
    return done.unionAll(existing.where(t.is_blank("uid")).select("uid", *cols, F.lit("kept")))


def refused(upload: DataFrame, order: Sequence[str]) -> DataFrame:
    """The upload rows that `merge_load` leaves out, with `reason`: no_uid (mint one first) or repeated, which is any row of a
    uid but the first. `order` must tell the rows of a uid apart."""
    blank = upload.where(t.is_blank("uid")).withColumn("reason", F.lit("no_uid"))
    again = later_rows(upload.where(~t.is_blank("uid")), ["uid"], order).select(*upload.columns, F.lit("repeated").alias("reason"))
    return blank.unionAll(again)


def load_totals(merged: DataFrame, minted: int | None = None, lost: DataFrame | None = None) -> DataFrame:
    """One row of totals: processed, success, skipped, failed, updated, uids_generated. `lost` are the refused rows: they
    count as processed and failed."""
    if lost is not None:
        merged = merged.select("outcome").unionAll(lost.select(F.lit("conflict")))
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return merged.agg(
        n("inserted", "updated", "skipped", "conflict").alias("processed"), n("inserted", "updated").alias("success"),
        n("skipped").alias("skipped"), n("conflict").alias("failed"), n("updated").alias("updated"),
        F.lit(minted or 0).cast("bigint").alias("uids_generated"),
    )


def retrieve_groups(found: DataFrame) -> DataFrame:
    """Retrieved samples per type, children counted apart; `found(uid, sampletype, direction)`, one row per sample."""
    return found.groupBy("sampletype").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("direction") == "down").alias("n_children"))


def retrieve_totals(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Totals of a retrieval: samples, types, children, and identifiers that were not found."""
    per = retrieve_groups(found)
    got = per.agg(
        F.sum("n_samples").alias("total_samples"), F.count(F.lit(1)).alias("total_sample_types"),
        F.sum("n_children").alias("total_children"), F.lit(0).cast("bigint").alias("failed_uids"))
    lost = asked.agg(
        F.lit(0).cast("bigint").alias("total_samples"), F.lit(0).cast("bigint").alias("total_sample_types"),
        F.lit(0).cast("bigint").alias("total_children"), F.count_if(F.col("uid").isNull()).alias("failed_uids"))
    names = ["total_samples", "total_sample_types", "total_children", "failed_uids"]
    return got.union(lost).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def rows_of_scientist(rows: DataFrame, who: str, columns: Sequence[str] = ("Scientist", "Notes")) -> DataFrame:
    """Per sheet: all rows, and rows that name a scientist in one of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.coalesce(t.attr("attrs", c), F.lit("")), F.lit(who))
    return rows.groupBy("sampletype").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_own"))
