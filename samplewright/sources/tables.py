"""Readers for text, CSV and JSON inputs. Schemas are given, never inferred from data where they are known."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import IMAGE_COLUMNS, MANIFEST_COLUMNS, PULL_PLAN_COLUMNS, SAMPLE_LIST_COLUMNS
from samplewright.operators.pulls import parse_plan
from samplewright.session import cut


def _strings(columns) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _place():
    """An orderable place of a row: file, block in the file, then the reader's own order within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest. Blank cells are empty strings, as everywhere in this file."""
    return spark.read.schema(_strings(MANIFEST_COLUMNS)).csv(path, header=True, escape='"', multiLine=True).fillna("")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The image listing with the place of each row, for last-row-wins."""
    rows = spark.read.schema(_strings(IMAGE_COLUMNS)).csv(path, header=True, escape='"', multiLine=True).fillna("")
    return rows.withColumn("line_no", _place())


def read_pull_plan(spark: SparkSession, path: str) -> DataFrame:
    plan = spark.read.schema(_strings(PULL_PLAN_COLUMNS)).csv(path, header=True, sep="\t", escape='"', multiLine=True).fillna("")
    return parse_plan(plan)


def parse_roster(lines: DataFrame) -> DataFrame:
    """Roster lines `(line_no, value)` to (line_no, accession, title): comments, blanks and single words are dropped.

    The title is the rest of the line, so that an id in brackets after a space is seen too.
    """
    line = t.strip("value")
    parts = F.split(line, r"\s+", 2)
    keep = (line != "") & ~F.startswith(line, F.lit("#")) & (F.size(parts) >= 2)
    return lines.where(keep).select("line_no", F.get(parts, F.lit(0)).alias("accession"), F.get(parts, F.lit(1)).alias("title"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return parse_roster(spark.read.text(path).withColumn("line_no", _place()))


def parse_catalogue(raw: DataFrame) -> DataFrame:
    """Catalogue records with comma lists to (sampletype, type_name, required, standard, possible)."""
    lists = {"required": "Required Metadata", "standard": "Standard Metadata", "possible": "Possible Metadata Fields"}
    return raw.select(
        F.col("SampleType").alias("sampletype"), F.coalesce("Name", F.lit("")).alias("type_name"),
        *[t.split_list(F.col(f"`{c}`") if c in raw.columns else F.lit(""), ",").alias(n) for n, c in lists.items()],
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    names = ["SampleType", "Name", "Required Metadata", "Standard Metadata", "Possible Metadata Fields"]
    return parse_catalogue(spark.read.schema(_strings(names)).json(path, multiLine=True))


def sample_type(catalogue: DataFrame, code: str) -> DataFrame:
    """The one catalogue row of a type; an unknown or repeated type is an error."""
    row = catalogue.where(F.col("sampletype") == code)
    if row.limit(2).count() != 1:
        raise KeyError(f"sample type {code!r} is not in the catalogue exactly once")
    return row


def read_assay_cache(spark: SparkSession, path: str, project_id: str | None = None) -> tuple[DataFrame, str]:
    """((title, assay_id), description). A missing or broken cache is empty, not an error.

    With a project, `path` is the folder that `write_assay_cache` fills; without one it is a document with a map of titles.
    """
    if project_id is not None:
        try:
            rows = spark.read.schema("title string, assay_id bigint, fetched_at_utc string, project_id string").json(path)
        except AnalysisException:
            return spark.createDataFrame([], "title string, assay_id bigint"), "no cache"
        mine = rows.where((F.col("project_id") == project_id) & F.col("title").isNotNull() & F.col("assay_id").isNotNull())
        return mine.select("title", "assay_id"), f"cache {path}, project {project_id}"
    schema = "project_id string, base_url string, fetched_at_utc string, assay_id_by_title map<string,bigint>"
    return _map_document(spark, path, schema, "assay_id_by_title", ("title", "assay_id"), "bigint", "cache")


def read_shared_titles(spark: SparkSession, path: str) -> DataFrame:
    """(title, assay_ids) of the titles that the cache document lists with several ids."""
    document = spark.read.schema("duplicate_titles map<string,array<bigint>>").json(path, multiLine=True)
    return document.select(F.explode("duplicate_titles").alias("title", "assay_ids"))


def read_synonyms(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """((cited, canonical), description), with the same leniency."""
    schema = "synonyms_by_cited_name map<string,string>"
    return _map_document(spark, path, schema, "synonyms_by_cited_name", ("cited", "canonical"), "string", "synonyms")


def _map_document(spark, path, schema, field, names, kind, label) -> tuple[DataFrame, str]:
    empty = spark.createDataFrame([], f"{names[0]} string, {names[1]} {kind}")
    try:
        document = cut(spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True))
        broken = document.where("_corrupt_record IS NOT NULL").limit(1).count()
    except AnalysisException:
        return empty, f"no {label}"
    if broken:
        return empty, f"{label} unreadable"
    return document.select(F.explode(field).alias(*names)), f"{label} {path}"


def parse_assay_pages(pages: DataFrame) -> DataFrame:
    """Landed API pages to (assay_id, title): records with an id and a title."""
    data = pages.select(F.explode("data").alias("d"))
    rows = data.select(F.col("d.id").cast("string").try_cast("bigint").alias("assay_id"), F.col("d.attributes.title").alias("title"))
    return rows.where(F.col("assay_id").isNotNull() & (F.coalesce("title", F.lit("")) != ""))


def read_assay_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages may be an object or a list around one; Spark reads both as records."""
    schema = "data array<struct<id:string,attributes:struct<title:string>>>, links struct<next:string>"
    return parse_assay_pages(spark.read.schema(schema).json(path, multiLine=True))


def read_allowed_edges(spark: SparkSession, path: str) -> DataFrame:
    schema = "fetched_at string, connections array<struct<assay:string,parent_type:string,child_type:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("connections"))


def parse_sample_list(rows: DataFrame) -> DataFrame:
    """The three named columns, trimmed, null as the empty string; all-null rows are dropped."""
    some = F.coalesce(*[F.col(f"`{c}`") for c in rows.columns]).isNotNull()
    return rows.where(some).select(*[t.norm(F.col(f"`{c}`")).alias(n) for c, n in SAMPLE_LIST_COLUMNS.items()])


def read_deposit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, paired-end rows) of a filled deposit document; the second part may be absent."""
    document = spark.read.json(path, multiLine=True)
    samples = document.select(F.posexplode("samples").alias("pos", "s")).select("pos", "s.*")
    if "paired_end_experiments" in document.columns:
        return samples, document.select(F.posexplode("paired_end_experiments").alias("pos", "p")).select("pos", "p.*")
    return samples, spark.createDataFrame([], "pos int")
