"""From typed sheets to flat upload rows, and to the four tables of a template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import FLAT_COLUMNS
from samplewright.operators.ranking import dense_index, first_by
from samplewright.operators.resolve import resolve_titles
from samplewright.operators.skew import lookup_join


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    """Blank cells leave the payload, and rows without any cell leave the table."""
    return rows.withColumn("attrs", t.drop_blank("attrs")).where(F.size("attrs") > 0)


def flat_rows(records: DataFrame, cache: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Records `(…, sampletype, parent_assay, attrs)` as the eight flat columns, other columns kept in front.

    Titles are resolved once per distinct title, not once per row.
    """
    titles = records.select(F.col("parent_assay").alias("title")).distinct()
    found = resolve_titles(titles, cache, synonyms).select(
        F.coalesce("title", F.lit("")).alias("_title"), "resolved_title", "assay_id"
    ).dropDuplicates(["_title"])
    rows = drop_blank_rows(records).withColumn("_title", F.coalesce("parent_assay", F.lit("")))
    cell = lambda k: F.coalesce(t.attr("attrs", k), F.lit(""))
    flat = {
        "uid": cell("UID"),
        "name": cell("Name"),
        "parent": cell("Parent"),
        "notes_summary": t.summary(cell("Notes")),
        "assay_titles": F.coalesce("resolved_title", F.lit("")),
        "assay_ids": F.coalesce(F.col("assay_id").cast("string"), F.lit("")),
        "json_metadata": t.payload_json("attrs"),
    }
    kept = [c for c in records.columns if c not in (*FLAT_COLUMNS, "attrs", "parent_assay")]
    joined = lookup_join(rows, found, "_title", "left")
    return joined.select(*kept, *[flat[c].alias(c) if c in flat else F.col(c) for c in FLAT_COLUMNS])


def route_pending(rows: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to upload, rows whose type the catalogue does not know). The catalogue has one row per type."""
    known = catalogue.select("sampletype").distinct()
    return rows.join(known, "sampletype", "left_semi"), rows.join(known, "sampletype", "left_anti")


def _first_seen(samples: DataFrame) -> DataFrame:
    """(field, at) of the payload keys, `at` being the first row and place. Rows are first reduced per key and place, by numbers that a
    hash table can hold; a least struct of every cell would be found by sorting all cells."""
    cells = samples.select("row_n", F.posexplode(F.map_keys("attrs")).alias("pos", "field"))
    places = cells.groupBy("field", "pos").agg(F.min("row_n").alias("row_n"))
    return places.groupBy("field").agg(F.min(F.struct("row_n", "pos")).alias("at"))


def column_order(sampletype: str, catalogue: DataFrame, samples: DataFrame) -> list[str]:
    """UID, then required, standard and possible fields of the type, then unseen keys in first-seen order.

    Only the distinct field names of one type come to the driver; they are the columns of the result.
    """
    row = catalogue.where(F.col("sampletype") == sampletype).select("required", "standard", "possible").limit(2).collect()
    if len(row) != 1:
        raise KeyError(f"sample type {sampletype!r} is not in the catalogue")
    listed = ["UID", *(row[0]["required"] or []), *(row[0]["standard"] or []), *(row[0]["possible"] or [])]
    seen = _first_seen(samples.where(F.col("sampletype") == sampletype)).orderBy("at")
    return list(dict.fromkeys([*listed, *[r["field"] for r in seen.select("field").collect()]]))


def four_tables(
    sampletype: str, samples: DataFrame, catalogue: DataFrame, assays: DataFrame, ontology: DataFrame
) -> dict[str, DataFrame]:
    """The four tables of a template. `assays(pos, title)`, `ontology(pos, field, value)`."""
    spark = samples.sparkSession
    cols = column_order(sampletype, catalogue, samples)
    fields = spark.range(1).select(F.posexplode(F.array(*map(F.lit, cols))).alias("pos", "Field"))
    own = samples.where(F.col("sampletype") == sampletype)
    return {
        "instructions": fields.select(
            "Field", F.concat(F.lit(sampletype + "::"), "Field").alias("Database Field"),
            F.lit("Text").alias("Field Type"), F.lit("").alias("Ontology"),
        ),
        "samples": own.select("row_n", *[F.coalesce(t.attr("attrs", c), F.lit("")).alias(c) for c in cols]),
        "assay": assays.select(
            "pos", F.lit(sampletype).alias("SampleType"), F.lit("").alias("AssayType"), F.col("title").alias("Assay"),
            F.lit("child").alias("Direction"),
        ),
        "ontology": ontology.select("pos", F.col("field").alias("Field"), F.col("value").alias("Value")),
    }


def retrieve_uids(rows: DataFrame, parent_types: list[str] | None) -> DataFrame:
    """Distinct UIDs of an upload; `parent_types` are left out unless None, as they come back by themselves."""
    uids = rows.select(t.filled("uid").alias("uid")).where(t.uid_type("uid").isNotNull())
    if parent_types is not None:
        uids = uids.where(~t.uid_type("uid").isin(*parent_types))
    return uids.distinct()


def count_by_type(uids: DataFrame) -> DataFrame:
    return uids.groupBy(t.uid_type("uid").alias("sampletype")).agg(F.count(F.lit(1)).alias("n_uids"))


def preferred_uploads(rows: DataFrame) -> DataFrame:
    """Rows of the preferred upload of each base: `X-upload-new` beats `X-upload`. Rows carry `file`."""
    name = F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.xlsx$", "")
    marked = rows.withColumns({
        "base": F.regexp_replace(name, "-upload(-new)?", ""),
        "is_new": F.contains(name, F.lit("-upload-new")).cast("int"),
    })
    best = marked.groupBy("base").agg(F.max("is_new").alias("_best"))
    return lookup_join(marked, best, "base").where("is_new = _best").drop("_best")


def mint_blank_uids(rows: DataFrame, existing: DataFrame, lab: str, date: str, order: list[str]) -> DataFrame:
    """Give blank UIDs the next free counter of their type, after those in use in `rows` and `existing`."""
    used = rows.select(t.filled("uid").alias("uid")).union(existing.select(t.filled("uid").alias("uid")))
    used = used.where(F.col("uid").isNotNull()).withColumn("sampletype", t.uid_type("uid"))
    top = used.groupBy("sampletype").agg(F.max(t.uid_index("uid", F.col("sampletype"), lab, date)).alias("_top"))
    blank = dense_index(rows.where(t.is_blank("uid")), order, by=["sampletype"], name="_n")
    minted = blank.join(top, "sampletype", "left").withColumn(
        "uid", t.mint_uid(F.col("sampletype"), lab, date, F.coalesce("_top", F.lit(0)) + F.col("_n"))
    )
    kept = rows.where(~t.is_blank("uid")).withColumn("minted", F.lit(False))
    return kept.unionByName(minted.select(*rows.columns).withColumn("minted", F.lit(True)))


def arm_counts(rows: DataFrame) -> DataFrame:
    """Rows and source files per arm."""
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").alias("n_files"))


def first_assay(assay_rows: DataFrame) -> DataFrame:
    """Per file the first assay title (column 3) that is filled and not in brackets."""
    named = assay_rows.select("file", "row_n", t.filled(F.get("values", F.lit(2))).alias("parent_assay"))
    named = named.where(F.col("parent_assay").isNotNull() & ~F.startswith("parent_assay", F.lit("(")))
    return first_by(named, ["file"], ["row_n"], ["parent_assay"])
