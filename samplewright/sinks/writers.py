"""Writers. Each writes a folder in parallel through Spark's commit protocol and returns its path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import FLAT_COLUMNS, IMAGE_COLUMNS, MANIFEST_COLUMNS, PULL_PLAN_COLUMNS


def write_four_tables(tables: dict[str, DataFrame], sampletype: str, path: str) -> str:
    """Instructions, samples, assay and ontology under `sampletype=X/`."""
    base = f"{path}/sampletype={sampletype}"
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{base}/{name}", header=True, escape='"')
    return base


def write_flat(rows: DataFrame, path: str) -> str:
    """Flat upload rows, one partition folder per arm. Rows of one arm may be written by many tasks."""
    rows.select("arm", *FLAT_COLUMNS).write.mode("overwrite").partitionBy("arm").csv(path, header=True, escape='"')
    return path


def write_uid_list(uids: DataFrame, path: str) -> str:
    """Sorted distinct UIDs, one per line. The parts in name order form the list; an empty list is one empty line."""
    ordered = uids.select("uid").distinct().orderBy("uid")
    if ordered.isEmpty():
        ordered = uids.sparkSession.range(1).select(F.lit("").alias("uid"))
    ordered.write.mode("overwrite").text(path)
    return path


def write_manifest(rows: DataFrame, path: str) -> str:
    """The manifest columns in their fixed order; others are dropped."""
    rows.select(*MANIFEST_COLUMNS).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
    return path


def write_pull_plan(plan: DataFrame, path: str) -> str:
    plan.select(*PULL_PLAN_COLUMNS).write.mode("overwrite").csv(path, header=True, sep="\t", escape='"')
    return path


def write_assay_cache(ids: DataFrame, project_id: str, fetched_at: str, path: str) -> str:
    """Title → id rows of one project, with the time of the fetch; other projects in the folder stay."""
    (
        ids.withColumn("fetched_at_utc", F.lit(fetched_at)).withColumn("project_id", F.lit(project_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").json(path)
    )
    return path


def write_assay_document(ids: DataFrame, shared: DataFrame, project_id: str, base_url: str, fetched_at: str, path: str) -> str:
    """One JSON document per project: `ids(title, assay_id)` as a map, and `shared(title, assay_id)` as lists of ids under their title.

    The document is one text by its format: as long as a project has assays.
    """
    lists = shared.groupBy("title").agg(F.sort_array(F.collect_set("assay_id")).alias("assay_ids"))
    both = ids.select("title", "assay_id", F.lit(None).cast("array<bigint>").alias("assay_ids")).union(lists.select("title", F.lit(None), "assay_ids"))
    entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("title", c)))))
    maps = both.agg(entries("assay_id").alias("assay_id_by_title"), entries("assay_ids").alias("duplicate_titles"))
    head = [F.lit(v).alias(c) for c, v in (("project_id", project_id), ("base_url", base_url), ("fetched_at_utc", fetched_at))]
    maps.select(F.to_json(F.struct(*head, "assay_id_by_title", "duplicate_titles"))).write.mode("overwrite").text(path)
    return path


def image_listing(images: DataFrame, base_url: str) -> DataFrame:
    """Image records with built URLs, in listing order of columns."""
    urls = {
        "web_url": t.image_detail_url(base_url, "image_id", "dataset_id"),
        "show_url": t.image_show_url(base_url, "image_id"),
    }
    return images.select(*[
        (urls[c] if c in urls else F.col(c) if c in images.columns else F.lit("")).alias(c) for c in IMAGE_COLUMNS])


def write_images(images: DataFrame, base_url: str, path: str) -> str:
    image_listing(images, base_url).write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def merge_to_gzip(lines: DataFrame, path: str, rows_per_part: int | None = None) -> str:
    """Lines `(output, source_no, line_no, value)` merged, in source order, into gzip text under `output=X/`.

    Ranges of (output, source, line) are spread over tasks, so one large output is written by many of them: its parts
    in name order are the merged file, and gzip members can simply be put one after another.
    """
    keys = ["output", "source_no", "line_no"]
    n = max(1, -(-lines.count() // rows_per_part)) if rows_per_part else None
    laid = lines.repartitionByRange(n, *keys) if n else lines.repartitionByRange(*keys)
    laid.sortWithinPartitions(*keys).select("output", "value").write.mode("overwrite").partitionBy("output").text(
        path, compression="gzip")
    return path


def guarded_write(plan: DataFrame, bad: str, path: str, write: bool = False) -> bool:
    """Write a plan only when asked to and when no row meets the condition `bad`. Returns whether it was written."""
    if not write or not plan.where(bad).isEmpty():
        return False
    plan.write.mode("overwrite").parquet(path)
    return True


def write_routed(upload: DataFrame, pending: DataFrame, path: str) -> tuple[str, str]:
    """Rows of known types to the upload, the others to a pending table."""
    upload.write.mode("overwrite").parquet(f"{path}/upload")
    pending.write.mode("overwrite").parquet(f"{path}/pending")
    return f"{path}/upload", f"{path}/pending"
