"""Comparing two versions of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import COMPARE_COLUMNS, VOCAB_COLUMNS
from samplewright.operators.skew import lookup_join


def _sides(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    return left.select(*cols, F.lit(1).alias("_side")).union(right.select(*cols, F.lit(2).alias("_side")))


def key_diff(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("sampletype", "uid")) -> DataFrame:
    """Every key with its side: common, left_only or right_only.

    One grouped aggregate over both tables instead of a full outer join: repeated keys collapse before the shuffle.
    """
    seen = _sides(left, right, keys).where(~t.is_blank(keys[-1])).groupBy(*keys).agg(F.bit_or("_side").alias("_s"))
    side = F.when(F.col("_s") == 3, "common").when(F.col("_s") == 1, "left_only").otherwise("right_only")
    return seen.select(*keys, side.alias("side"))


def key_diff_counts(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("sampletype", "uid")) -> DataFrame:
    """Keys per type and side."""
    return key_diff(left, right, keys).groupBy(keys[0], "side").agg(F.count(F.lit(1)).alias("n_keys"))


def field_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("sampletype", "uid"), order: Sequence[str] = ("row_n",),
    columns: Sequence[str] = COMPARE_COLUMNS,
) -> DataFrame:
    """Differing fields of common keys: (keys, field, left_value, right_value).

    On each side the last row of a key wins. A column neither side has is skipped. Both sides are reduced and matched
    in one aggregate. The row number that picks the winner may differ between the sides.
    """
    cols = [c for c in columns if c in left.columns or c in right.columns]
    cell = lambda df, c: t.norm(c).alias(c) if c in df.columns else F.lit("").alias(c)
    both = (
        left.select(*keys, *order, *[cell(left, c) for c in cols], F.lit(1).alias("_side"))
        .union(right.select(*keys, *order, *[cell(right, c) for c in cols], F.lit(2).alias("_side")))
        .where(~t.is_blank(keys[-1]))
    )
    last = lambda side: F.max(
        F.when(F.col("_side") == side, F.struct(*order, F.struct(*cols).alias("v")))
    )
    met = both.groupBy(*keys).agg(last(1).alias("_l"), last(2).alias("_r")).where("_l IS NOT NULL AND _r IS NOT NULL")
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("field"), F.col("_l")["v"][c].alias("left_value"), F.col("_r")["v"][c].alias("right_value")
        )
        for c in cols
    ])
    return met.select(*keys, F.inline(pairs)).where("left_value <> right_value")


def drift_class(diffs: DataFrame) -> DataFrame:
    """Tell differences of format (case, white space) from differences of meaning."""
    same = t.fold_text("left_value") == t.fold_text("right_value")
    return diffs.withColumn("drift", F.when(same, "format").otherwise("semantic"))


def token_inventory(rows: DataFrame, column: str, source: str, sep: str = ";") -> DataFrame:
    """Distinct tokens of a list column with their count and the number of sources, most frequent first."""
    tokens = rows.select(F.explode(t.split_list(column, sep)).alias("token"), F.col(source).alias("source"))
    per_source = tokens.groupBy("token", "source").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_source.groupBy("token").agg(F.sum("n").alias("n_uses"), F.count(F.lit(1)).alias("n_sources"))
        .orderBy(F.desc("n_uses"), "token")
    )


def token_sources(rows: DataFrame, column: str, source: str, sep: str = ";") -> DataFrame:
    """The distinct (token, source) pairs behind the inventory."""
    return rows.select(F.explode(t.split_list(column, sep)).alias("token"), F.col(source).alias("source")).distinct()


def link_tally(rows: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Cells per URL type, and whether the type counts as filled."""
    kind = t.url_type(column).alias("url_type")
    keys = [by, kind] if by else [kind]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")).withColumn("filled", F.col("url_type") != "empty")


def fill_rate(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Filled cells and all cells per group."""
    return rows.groupBy(by).agg(
        F.count_if(t.url_type(column) != "empty").alias("n_filled"), F.count(F.lit(1)).alias("n_cells")
    )


def vocabulary(rows: DataFrame, columns: Sequence[str] = VOCAB_COLUMNS) -> DataFrame:
    """Distinct values of several columns as (field, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), t.filled(c).alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def unmatched_types(master: DataFrame, upload: DataFrame) -> DataFrame:
    """Types of the master without any upload row, with their row counts."""
    counted = master.groupBy("sampletype").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(upload.select("sampletype").distinct(), "sampletype", "left_anti")


def set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection and of both differences of two key sets."""
    sides = _sides(left, right, [key]).groupBy(key).agg(F.bit_or("_side").alias("_s"))
    return sides.agg(
        F.count_if(F.col("_s") == 3).alias("n_common"), F.count_if(F.col("_s") == 1).alias("n_left_only"),
        F.count_if(F.col("_s") == 2).alias("n_right_only"),
    )


def expected_vs_pulled(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """File names expected but not pulled, pulled but not expected, or pulled several times, one finding per row.

    The manifest's last row of a name is the one reported. Both sides are reduced in one aggregate.
    """
    want = manifest.where((F.col("target_storage") == "omero") & ~t.is_blank("target_filename")).select(
        F.col("target_filename").alias("filename"), F.struct("id", "original_path", "md5", "figure").alias("m"),
        F.lit(None).cast("bigint").alias("image_id"),
    )
    got = images.select("filename", F.lit(None).cast(want.schema["m"].dataType).alias("m"), "image_id")
    per = want.union(got).groupBy("filename").agg(
        F.max("m").alias("m"), F.count("image_id").alias("n_images"), F.min("image_id").alias("image_id")
    )
    findings = F.array(
        F.when(F.col("n_images") == 0, F.lit("missing")), F.when(F.col("m").isNull(), F.lit("extra")),
        F.when(F.col("n_images") > 1, F.lit("duplicate")),
    )
    return per.select(
        "filename", F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("finding"), "n_images", "image_id",
        F.col("m.original_path").alias("original_path"), F.col("m.md5").alias("md5"), F.col("m.figure").alias("figure"),
    )


def duplicate_imports(images: DataFrame) -> DataFrame:
    """The image ids behind every file name that was imported more than once, one row each."""
    several = images.groupBy("filename").agg(F.count(F.lit(1)).alias("n_images")).where("n_images > 1")
    several = several.withColumn("_n", F.col("n_images"))
    return lookup_join(images.select("filename", "image_id"), several, "filename", count="_n")


def round_trip(requested: DataFrame, returned: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Each UID of a round trip: ok, missing, parent (pulled along) or extra.

    `ancestors(uid)` is the upward closure of the requested ids.
    """
    flags = (
        requested.select("uid", F.lit(1).alias("_f"))
        .union(returned.select("uid", F.lit(2).alias("_f")))
        .union(ancestors.select("uid", F.lit(4).alias("_f")))
        .groupBy("uid").agg(F.bit_or("_f").alias("_f"))
    )
    has = lambda b: F.col("_f").bitwiseAND(b) != 0
    state: Column = (
        F.when(has(1) & has(2), "ok").when(has(1), "missing").when(has(2) & has(4), "parent").when(has(2), "extra")
    )
    return flags.select("uid", state.alias("state")).where("state IS NOT NULL")
