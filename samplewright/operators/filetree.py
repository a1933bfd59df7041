"""The file workflow: manifest, collisions, checks against the disk, staging, content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import paths as p
from samplewright.functions import text as t
from samplewright.model import IMAGE_TYPES, MANIFEST_COLUMNS
from samplewright.operators.ranking import dense_index, first_rows
from samplewright.operators.skew import fits, hot_ways, lookup_join, salted_join
from samplewright.session import cut, stored


def figure_files(files: DataFrame) -> DataFrame:
    return files.where(F.split_part("path", F.lit("/"), F.lit(1)).isin(*p.FIGURES))


def classify_listing(files: DataFrame) -> DataFrame:
    """`files(path, length, mtime)` of the figure folders with their classification and target path."""
    return p.classify_paths(figure_files(files)).withColumn(
        "target_relpath", p.target_relpath("figure", "target_filename", "target_storage")
    )


def build_manifest(files: DataFrame) -> DataFrame:
    """The manifest of a listing: classified and numbered `000001…` in the order of the paths' parts, so a folder's files come
    before those of a folder whose name is longer."""
    listed = figure_files(files).select("path", "length", "mtime", F.split("path", "/").alias("_parts"))
    numbered = dense_index(listed, ["_parts", "path"], name="_number")  # before the rules run, so they run once
    return classify_listing(numbered).withColumns({
        "id": F.lpad(F.col("_number").cast("string"), 6, "0"),
        "original_path": F.col("path"),
        "size_bytes": F.col("length").cast("bigint"),
        "mtime_iso": F.coalesce(F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
        "md5": F.lit(""),
        "figure": F.when(F.col("figure") == 0, "").otherwise(F.col("figure").cast("string")),
    }).select(*MANIFEST_COLUMNS)


def walk_summary(manifest: DataFrame) -> DataFrame:
    """Files by storage, by category, by figure and in total, in one pass: (dimension, value, n_files)."""
    dims = ["target_storage", "category", "figure"]
    sets = manifest.groupingSets([["target_storage"], ["category"], ["figure"], []], *dims).agg(
        F.count(F.lit(1)).alias("n_files"), F.grouping_id().alias("_g"))
    dim = F.when(F.col("_g") == 3, "storage").when(F.col("_g") == 5, "category").when(F.col("_g") == 6, "figure").otherwise(
        "total")
    value = F.when(F.col("_g") == 7, "").otherwise(F.coalesce(*[F.col(d).cast("string") for d in dims]))
    return sets.select(dim.alias("dimension"), value.alias("value"), "n_files")


def unclassified(manifest: DataFrame, k: int = 10) -> DataFrame:
    """The first files no rule knows."""
    unknown = manifest.where(F.col("category").isin("unknown", "")).withColumn("_g", F.lit(1))
    return first_rows(unknown, ["_g"], ["original_path"], k).drop("_g")


def _moving(manifest: DataFrame) -> DataFrame:
    return manifest.where((F.col("target_storage") != "skip") & (F.col("target_relpath") != ""))


def collisions(manifest: DataFrame) -> DataFrame:
    """Targets that several files would take, one source per row. Only colliding targets are joined back."""
    moving = cut(_moving(manifest).select("target_relpath", "original_path"))
    several = moving.groupBy("target_relpath").agg(F.count(F.lit(1)).alias("n_sources")).where("n_sources > 1")
    several = several.withColumn("_n", F.col("n_sources"))
    return lookup_join(moving, several, "target_relpath", count="_n")


def collision_counts(manifest: DataFrame) -> DataFrame:
    return _moving(manifest).groupBy("target_relpath").agg(F.count(F.lit(1)).alias("n_sources")).where("n_sources > 1")


def missing_checksums(manifest: DataFrame) -> DataFrame:
    """One row: how many files to move still lack a checksum; moving may start at zero."""
    need = (F.col("target_storage") != "skip") & t.is_blank("md5")
    return manifest.agg(F.count_if(need).alias("n_missing"), (F.count_if(need) == 0).alias("may_move"))


def to_hash(manifest: DataFrame) -> DataFrame:
    """(path) of the files that lack a checksum and are not skipped."""
    need = t.is_blank("md5") & (F.col("target_storage") != "skip")
    return manifest.where(need).select(F.col("original_path").alias("path"))


def add_checksums(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Fill blank checksums of files that are not skipped from `digests(path, md5)`.

    A file without a digest keeps a blank checksum and says so in `skip_reason`.
    """
    need = t.is_blank("md5") & (F.col("target_storage") != "skip")
    failed = need & F.col("_md5").isNull()
    new = {
        "md5": F.when(need, F.coalesce("_md5", F.lit(""))).otherwise(F.col("md5")),
        "skip_reason": F.when(failed & t.is_blank("skip_reason"), F.lit("md5 failed: file not readable")).otherwise(
            F.col("skip_reason")),
    }
    joined = manifest.join(digests.toDF("original_path", "_md5"), "original_path", "left")
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in manifest.columns])


def content_duplicates(files: DataFrame) -> DataFrame:
    """Files that share content: (md5, length, path, n_copies), one row per file of `files(path, length, md5)`.

    Groups are counted first; only files of repeated contents are joined back, and big groups are spread out.
    """
    key = F.concat_ws(":", "md5", F.col("length").cast("string"))
    keyed = files.select("path", "md5", "length", key.alias("_k"))
    several = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return lookup_join(keyed, several.withColumn("_n", F.col("n_copies")), "_k", count="_n").drop("_k")


def _on_disk(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows to move, with `src` and `dst` sizes from the listing (null when absent).

    The listing is written once and looked up from there by both paths. A long one is merged; targets that many rows share are read
    off the manifest, before anything is joined to it.
    """
    listing = stored(files.select("path", F.col("length").alias("_len")), "listing")
    moving = manifest.where(F.col("target_storage") != "skip")
    src = listing.toDF("original_path", "src_length")
    dst = listing.toDF("target_relpath", "dst_length")
    if fits(listing):
        return moving.join(F.broadcast(src), "original_path", "left").join(F.broadcast(dst), "target_relpath", "left")
    hot = hot_ways(moving, "target_relpath")
    return salted_join(moving.join(src.hint("merge"), "original_path", "left"), dst, "target_relpath", "left", hot, merged=True)


def verify_disk(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Status per moved file: ok, size_drift, not_moved (source still there) or missing_both."""
    drift = F.col("dst_length") != F.col("size_bytes").cast("bigint")
    status = (
        F.when(F.col("dst_length").isNull() & F.col("src_length").isNotNull(), "not_moved")
        .when(F.col("dst_length").isNull(), "missing_both").when(drift, "size_drift").otherwise("ok")
    )
    return _on_disk(manifest, files).select(
        "id", "original_path", "target_relpath", "size_bytes", "dst_length", status.alias("status"))


def move_plan(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """What a move would do with each row: move, already, missing or skip. Running it twice changes nothing."""
    src, dst = F.col("src_length").isNotNull(), F.col("dst_length").isNotNull()
    action = F.when(dst, "already").when(src, "move").otherwise("missing")
    plan = _on_disk(manifest, files).select("id", "original_path", "target_relpath", action.alias("action"))
    skipped = manifest.where(F.col("target_storage") == "skip")
    return plan.union(skipped.select("id", "original_path", "target_relpath", F.lit("skip")))


def restore_plan(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file lies at the target and not at its old place: these can be put back."""
    back = F.col("dst_length").isNotNull() & F.col("src_length").isNull()
    return _on_disk(manifest, files).where(back).select("id", "target_relpath", "original_path")


def stage_plan(
    files: DataFrame, index: DataFrame, defaults: dict[str, int] | None = None, excluded_root: str = "Figures",
    image_types: Sequence[str] = IMAGE_TYPES,
) -> DataFrame:
    """What staging would do with each file: (path, filename, sampletype, uid, figure, destination, state).

    `state` is stage, staged, uncurated, image, no_figure or collision. Hidden files and `excluded_root` are left out.
    """
    top = F.split_part("path", F.lit("/"), F.lit(1))
    name = p.base_name("path")
    seen = files.where(F.contains("path", F.lit("/")) & (top != excluded_root)).select("path", name.alias("filename"))
    seen = seen.where(~F.startswith("filename", F.lit("._")) & (F.col("filename") != ".DS_Store"))
    found = lookup_join(seen, index.select("filename", "sampletype", "uid"), "filename", "left")
    default = F.lit(None).cast("int")
    for kind, fig in (defaults or {}).items():
        default = F.when(F.col("sampletype") == kind, fig).otherwise(default)
    found = found.withColumn("figure", F.coalesce(p.figure_of("path"), default))
    found = found.withColumn("destination", p.staged_path(F.col("figure"), "sampletype", "filename"))
    state = (
        F.when(p.already_staged("path"), "staged").when(F.col("uid").isNull(), "uncurated")
        .when(F.col("sampletype").isin(*image_types), "image").when(F.col("figure").isNull(), "no_figure")
        .when(F.col("_taken") & (F.col("destination") != F.col("path")), "collision").otherwise("stage")
    )
    taken = files.select(F.col("path").alias("destination"), F.lit(True).alias("_taken")).distinct()
    return lookup_join(found, taken, "destination", "left").select(
        "path", "filename", "sampletype", "uid", "figure", "destination", state.alias("state"))


def stage_summary(plan: DataFrame) -> DataFrame:
    """Files per state, and per figure and type where they will be staged."""
    staged = F.col("state") == "stage"
    return plan.groupBy(
        "state", F.when(staged, F.col("figure")).alias("figure"),
        F.when(staged | (F.col("state") == "image"), F.col("sampletype")).alias("sampletype"),
    ).agg(F.count(F.lit(1)).alias("n_files"))


def bytes_by_top(files: DataFrame) -> DataFrame:
    """Files and bytes per top-level folder."""
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
