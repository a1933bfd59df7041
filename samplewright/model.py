"""Schemas and constants of the data model. Every cell is text unless a type is given."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Column sets that files of the domain carry, in file order.
FLAT_COLUMNS = ["uid", "sampletype", "name", "parent", "notes_summary", "assay_titles", "assay_ids", "json_metadata"]
FLAT_REQUIRED = ["uid", "sampletype", "json_metadata", "parent"]
MANIFEST_COLUMNS = [
    "id", "original_path", "size_bytes", "mtime_iso", "md5", "figure", "device_id", "region", "acquisition", "roi",
    "category", "target_storage", "sampletype", "target_filename", "target_relpath", "skip_reason", "notes",
]
IMAGE_COLUMNS = [
    "filename", "image_id", "dataset_id", "dataset_name", "project_id", "project_name", "fileset_id", "web_url",
    "show_url",
]
PULL_PLAN_COLUMNS = [
    "sample_annotation", "batch", "kind", "stream", "total_src_bytes", "n_sources", "output", "source_paths",
    "source_sizes", "error",
]
SAMPLE_LIST_COLUMNS = {"Sample Annotation": "sample_annotation", "Mouse Acc.# ID#": "mouse_acc", "Folder Name": "folder"}
COMPARE_COLUMNS = ["File_PrimaryData", "Link_PrimaryData", "Parent", "Accession", "Checksum_PrimaryData"]
VOCAB_COLUMNS = ["Type", "Material", "Vascularization", "ExperimentType", "Stimulation"]
TEMPLATE_SHEETS = ["Instructions", "Samples", "Assay", "Ontology"]
DEPOSIT_COLUMNS = [
    "*library name", "*title", "*library strategy", "*organism", "**tissue", "**cell line", "**cell type", "genotype",
    "treatment", "batch", "*molecule", "*single or paired-end", "*instrument model", "description",
]
PAIRED_COLUMNS = ["file name 1", "file name 2", "file name 3", "file name 4"]

# Sample types by role.
PARENT_TYPES = ["MUS", "TIS", "DNA", "RNA", "PAT", "PAV", "CHM", "CEL"]
IMAGE_TYPES = ["D.IMG", "A.IMG", "SLD", "A.SPTX"]
ROOT_TYPES = ["CEL", "MDL"]

# Marker texts in payloads.
PLACEHOLDER_MARKERS = ["*** PLACEHOLDER", "***PLACEHOLDER"]
SURPRISE_SENTINELS = ["XXX", "TODO", "FIXME", "???", "TBD", "UNCONFIRMED"]

# Issue codes that block an upload.
BLOCKERS = [
    "duplicate_uid", "missing_uid", "unknown_sampletype", "bad_json", "missing_json_metadata", "parent_uid_not_found",
    "duplicate_name", "blank_parent_nonroot",
]

# Issue severities; the worst one decides the disposition of a row.
INFO, SOFT, HARD = 0, 1, 2

# Texts that a deposit form takes only literally.
DEPOSIT_LITERALS = {
    "*single or paired-end": ["single", "paired-end"],
    "*instrument model": ["Illumina NextSeq 500"],
}


def local_table(spark: SparkSession, columns: dict[str, pa.DataType | None], rows: list[tuple]) -> DataFrame:
    """A lookup table given in code. It becomes a local relation, so the optimizer knows its exact size."""
    cols = list(zip(*rows)) if rows else [()] * len(columns)
    arrays = [pa.array(list(v), type=t or pa.string()) for v, t in zip(cols, columns.values())]
    return spark.createDataFrame(pa.table(dict(zip(columns, arrays))))
