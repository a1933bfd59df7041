"""Workbooks, archives and written files, all made by Spark from the test tables and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import local_table
from samplewright.operators import backfill, checks, filetree, flat, pulls, ranking
from samplewright.plans import diffs, registry as r, trees
from samplewright.plans.base import Book
from samplewright.session import cut, scratch_path, spread, stored
from samplewright.sinks import binary, writers
from samplewright.sources import archives, sheets, tables
from samplewright.sources import files as sources

book = Book()

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(ref: str, value, shared: dict) -> str:
    """Numbers as numbers, short texts shared, longer ones inline."""
    if value is None:
        return ""
    if isinstance(value, int):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if len(value) < 12:
        return f'<c r="{ref}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def render_workbook(tabs: dict[str, list[list]]) -> bytes:
    """A small workbook with one sheet per tab, empty cells left out."""
    shared: dict[str, int] = {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, rows in enumerate(tabs.values(), 1):
            body = "".join(
                f'<row r="{n}">' + "".join(_cell(chr(65 + c) + str(n), v, shared) for c, v in enumerate(row)) + "</row>"
                for n, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>")
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(tabs, 1))
        z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tabs) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
    return out.getvalue()


_CHUNK = 500


def workbook_files(spark, sf):
    """Template workbooks of at most 500 orders each, as (path, content)."""

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        rows = [["UID", "Name", "", "Parent", "Notes", "Status"]]
        for k, cust, status, prio in zip(pdf["o_orderkey"], pdf["o_custkey"], pdf["o_orderstatus"], pdf["o_orderpriority"]):
            rows.append([None] * 6 if k % 50 == 3 else [
                f"ORD-{r.DATE}{r.LAB}-{k}", f"order {k}", int(k), f"CUS-{r.DATE}{r.LAB}-{cust}", None if k % 4 == 0 else f"<{prio}> & more",
                status if k % 5 else ""])
        tabs = {
            "Instructions": [["Field", "Database Field", "Field Type", "Ontology"], ["UID", None, "Text"], ["Name", "ORD::Name", "Text"]],
            "Samples": rows,
            "Assay": [["SampleType", "AssayType", "Assay", "Direction"], ["ORD", None, "(visit registration)"],
                      ["ORD", "", "RNA extraction" if chunk % 2 else "Cell Culture", "child"]],
            "Ontology": [["Field", "Value"], ["Status", "F"]],
        }
        return pd.DataFrame({"path": [f"/up/Arm{chunk % 3}_ORD{chunk}.xlsx"], "content": [render_workbook(tabs)]})

    orders = r.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    slots = spark.sparkContext.defaultParallelism
    chunked = orders.withColumn("chunk", F.expr(f"o_orderkey div {_CHUNK}")).repartition(slots, "chunk")
    return chunked.groupBy("chunk").applyInPandas(
        lambda pdf: render(pdf.sort_values("o_orderkey")), "path string, content binary")


_BOOK = f"""
made AS (SELECT *, o_orderkey // {_CHUNK} AS chunk, o_orderkey % {_CHUNK} + 2 AS row_n FROM orders),
sheet AS (SELECT '/up/Arm' || chunk % 3 || '_ORD' || chunk || '.xlsx' AS file, row_n, {r._U('ORD', 'o_orderkey')} AS uid, 'order ' || o_orderkey AS name,
  o_orderkey::VARCHAR AS col2, {r._U('CUS', 'o_custkey')} AS parent, CASE WHEN o_orderkey % 4 > 0 THEN '<' || o_orderpriority || '> & more' END AS notes,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS status, CASE chunk % 2 WHEN 1 THEN 'RNA extraction' ELSE 'Cell Culture' END AS assay, chunk
  FROM made WHERE o_orderkey % 50 <> 3)"""


@book.query(f"WITH {_BOOK} SELECT file, row_n, 'ORD' AS sampletype, assay AS parent_assay, uid, name, col2, parent, notes, status FROM sheet")
def workbook_scan(spark, sf):
    records = sheets.four_sheet_records(cut(workbook_files(spark, sf)))
    cell = lambda k, n: t.attr("attrs", k).alias(n)
    return records.select(
        "file", "row_n", "sampletype", "parent_assay", cell("UID", "uid"), cell("Name", "name"), cell("_col2", "col2"),
        cell("Parent", "parent"), cell("Notes", "notes"), cell("Status", "status"))


@book.query(f"""WITH {_BOOK}, n AS (SELECT '/up/Arm' || chunk % 3 || '_ORD' || chunk || '.xlsx' AS file, count(*) AS n FROM made GROUP BY ALL)
SELECT file, 'Samples' AS sheet, n + 1 AS n_rows, 6 AS n_cols, 'UID, Name, None, Parent, Notes, Status' AS headers FROM n
UNION ALL SELECT file, 'Instructions', 3, 4, 'Field, Database Field, Field Type, Ontology' FROM n
UNION ALL SELECT file, 'Assay', 3, 4, 'SampleType, AssayType, Assay, Direction' FROM n UNION ALL SELECT file, 'Ontology', 2, 2, 'Field, Value' FROM n""")
def sheet_profile(spark, sf):
    return sheets.profile(sheets.scan_workbooks(workbook_files(spark, sf)))


@book.query(f"WITH {_BOOK} SELECT file, row_n, uid FROM sheet")
def uid_column_scan(spark, sf):
    return sheets.uid_cells(sheets.scan_workbooks(workbook_files(spark, sf), ["Samples"])).select("file", "row_n", "uid")


@book.query(f"WITH {_BOOK} SELECT DISTINCT uid FROM sheet")
def master_uid_scan(spark, sf):
    return sheets.master_uids(sheets.scan_workbooks(workbook_files(spark, sf)))


@book.query(f"WITH {_BOOK} SELECT file, count(*) AS n FROM sheet GROUP BY 1")
def sheet_pick(spark, sf):
    picked = sheets.pick_sheet(sheets.scan_workbooks(workbook_files(spark, sf))).where("row_n > 1")
    return picked.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"WITH {_BOOK} SELECT file, row_n, uid FROM (SELECT file, row_n, uid, row_number() OVER (PARTITION BY file ORDER BY row_n) AS n FROM sheet) WHERE n <= 3")
def sheet_sample(spark, sf):
    rows = sheets.uid_cells(sheets.scan_workbooks(workbook_files(spark, sf), ["Samples"]))
    return ranking.first_rows(rows, ["file"], ["row_n"], 3).select("file", "row_n", "uid")


@book.query(f"""WITH {_BOOK} SELECT 'Arm' || chunk % 3 AS arm, count(*) AS n_rows, count(DISTINCT file) AS n_files,
  count(*) FILTER (notes IS NOT NULL) AS n_notes, count(*) FILTER (assay = 'RNA extraction') AS n_synonym FROM sheet GROUP BY 1""")
def consolidate(spark, sf):
    """Template workbooks to flat rows, written by arm and read back."""
    made = cut(workbook_files(spark, sf))
    arms = sources.template_files(made.select("path")).withColumnRenamed("path", "file")
    records = stored(sheets.four_sheet_records(made).join(arms, "file"), "records")  # workbooks are parsed once
    rows = flat.flat_rows(records, r.assay_cache(spark), r.synonyms(spark))
    path = writers.write_flat(rows, scratch_path(spark, "flat"))
    per_arm = flat.arm_counts(records.select("arm", "file"))
    back = spark.read.csv(path, header=True, escape='"', multiLine=True).groupBy("arm").agg(
        F.count_if(F.col("notes_summary") != "").alias("n_notes"), F.count_if(F.col("assay_ids") == "61").alias("n_synonym"))
    return per_arm.join(back, "arm")


@book.query("""
SELECT 'T' || p_partkey % 40 AS base, 'T' || p_partkey % 40 || CASE WHEN bool_or(p_partkey % 3 = 0 AND p_size > 40) THEN '-upload-new' ELSE '-upload' END || '.xlsx' AS name
FROM part GROUP BY p_partkey % 40""")
def preferred_files(spark, sf):
    k = F.col("p_partkey")
    new = (k % 3 == 0) & (F.col("p_size") > 40)
    name = F.concat(F.lit("/up/T"), (k % 40).cast("string"), F.when(new, "-upload-new").otherwise("-upload"), F.lit(".xlsx"))
    all_old = r.table(spark, sf, "part").select(F.concat(F.lit("/up/T"), (k % 40).cast("string"), F.lit("-upload.xlsx")))
    found = r.table(spark, sf, "part").select(name.alias("path")).union(all_old).union(all_old.select(F.lit("/up/~T1-upload.xlsx"))).distinct()
    return sources.preferred_files(found).select("base", F.regexp_replace("path", "^.*/", "").alias("name"))


@book.query("SELECT DISTINCT 'T' || p_partkey % 40 AS sampletype, CASE WHEN p_size > 40 THEN '-upload-new' ELSE '-upload' END AS kind FROM part")
def grouped_uploads(spark, sf):
    kind = F.when(F.col("p_size") > 40, "-upload-new").otherwise("-upload")
    name = F.concat(F.lit("/up/T"), (F.col("p_partkey") % 40).cast("string"), kind, F.lit(".xlsx"))
    found = sources.grouped_uploads(r.table(spark, sf, "part").select(name.alias("path")).distinct())
    return found.select("sampletype", F.regexp_extract("path", r"(-upload.*)\.xlsx$", 1).alias("kind"))


# --- archives and text files -----------------------------------------------------------------------------------------

_DOCS_A_TASK = 5_000


def archive_files(spark, sf):
    """Zip files of at most 100 documents each, as (path, content). A task makes about 50, whatever the number of documents, so what
    leaves it at once does not grow."""

    def pack(docs: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("docs/", "")
            for doc_id, lang, text in zip(docs["doc_id"], docs["lang"], docs["text"], strict=True):
                z.writestr(f"docs/{lang}/d_{doc_id}.txt", text.as_py() or "")
        return pa.table({"path": [f"/zips/part_{docs['chunk'][0]}.zip"], "content": [out.getvalue()]})

    docs = r.table(spark, sf, "documents").select("doc_id", "lang", "text").withColumn("chunk", F.expr("doc_id div 100"))
    tasks = max(spark.sparkContext.defaultParallelism, docs.count() // _DOCS_A_TASK)
    return docs.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(pack, "path string, content binary")


@book.query("SELECT 'part_' || doc_id // 100 || '.zip' AS zip_name, 'docs/' || lang || '/d_' || doc_id || '.txt' AS member, 'd_' || doc_id || '.txt' AS filename FROM documents")
def archive_listing(spark, sf):
    return sources.archive_members(archive_files(spark, sf))


@book.query(book.sql["archive_listing"])
def archive_source(spark, sf):
    """The same archives as files, listed by the data source."""
    made = archive_files(spark, sf).select(F.substring("path", 2, 1000).alias("path"), "content")
    path = binary.write_files(made, scratch_path(spark, "archives"))
    return archives.list_archives(spark, path).select("zip_name", "member", "filename")


def _doc_files(spark, sf, path, name):
    """One file per document below `path`."""
    docs = spread(r.table(spark, sf, "documents"))
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return binary.write_files(docs.select(name.alias("path"), body.alias("content")), path)


_PULLED = """
src AS (SELECT doc_id, source, '24-' || source || '-P' || doc_id % 3 || '/' || doc_id || '_NA_sequence.fastq' AS path, doc_id % 3 AS plate, coalesce(text, '') AS text FROM documents)"""


@book.query(f"""WITH {_PULLED} SELECT 'fastq/B/B_S' || source || '.fastq.gz' AS output, count(*) AS n_sources, sum(strlen(text))::BIGINT AS src_bytes,
  md5(string_agg(text, '' ORDER BY plate, path)) AS md5 FROM src GROUP BY source""")
def pull_merge(spark, sf):
    """Source files, a written pull plan over them, its outputs merged, unpacked and hashed."""
    k = F.col("doc_id")
    source_dir = F.concat(F.lit("24-"), "source", F.lit("-P"), (k % 3).cast("string"))
    root = _doc_files(spark, sf, scratch_path(spark, "sources"), F.concat(source_dir, F.lit("/"), k.cast("string"), F.lit("_NA_sequence.fastq")))
    listing = sources.list_files(spark, root).select(
        F.split_part("path", F.lit("/"), F.lit(1)).alias("source_dir"), "path", F.col("length").alias("size"), F.element_at(F.split("path", "/"), -1).alias("name"))
    listing = cut(listing)
    samples = r.table(spark, sf, "documents").select(F.concat(F.lit("S"), "source").alias("sample_annotation"), F.lit("B").alias("folder")).distinct()
    strategy = local_table(spark, {"batch": None, "plates": pa.list_(pa.string()), "year_prefix": None}, [("B", ["P0", "P1", "P2"], "24")])
    plan = pulls.plan_table(pulls.plan_jobs(samples, strategy, listing), pulls.job_sources(samples, strategy, listing))
    jobs = tables.read_pull_plan(spark, writers.write_pull_plan(plan, scratch_path(spark, "plan")))
    out = scratch_path(spark, "pulled")
    merged = binary.merge_sources(pulls.plan_files(jobs), root, out)
    return merged.join(sources.unpacked_digests(spark, out, merged.select(F.col("output").alias("path"))).withColumnRenamed("path", "output"), "output").select(
        "output", "n_sources", "src_bytes", "md5")


@book.query("""SELECT 'doc/' || doc_id AS path, md5(coalesce(text, '')) AS md5, strlen(coalesce(text, '')) AS length, n_copies FROM (
  SELECT *, count(*) OVER (PARTITION BY coalesce(text, '')) AS n_copies FROM documents) WHERE n_copies > 1""")
def content_dups_on_disk(spark, sf):
    """Documents as files; copies found by length, by both ends, and by whole digests of what is left."""
    root = _doc_files(spark, sf, scratch_path(spark, "copies"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    listing = cut(sources.list_files(spark, root).select("path", "length"))
    digests = sources.staged_digests(spark, root, listing, edge=1024)
    return filetree.content_duplicates(digests.where("md5 IS NOT NULL")).select("path", "md5", "length", "n_copies")


@book.query("SELECT 'd/' || doc_id AS path, md5(coalesce(text, '')) AS md5 FROM documents")
def file_checksums(spark, sf):
    """True digests of files, one per document."""
    root = _doc_files(spark, sf, scratch_path(spark, "digests"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    return sources.file_digests(spark, root, sources.list_files(spark, root))


def _doc_lines(spark, sf):
    docs = spread(r.table(spark, sf, "documents"))
    return docs.select(
        F.col("source").alias("output"), F.col("doc_id").alias("source_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


@book.query("""SELECT source AS output, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes FROM (
  SELECT source, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents) GROUP BY 1""")
def gzip_merge(spark, sf):
    lines = _doc_lines(spark, sf).withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    path = writers.merge_to_gzip(lines, scratch_path(spark, "merge"))
    back = spark.read.text(path)
    return back.groupBy("output").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("value").cast("bigint")).alias("n_bytes"))


@book.query("SELECT 'output=' || source AS top, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM documents GROUP BY 1")
def file_tree(spark, sf):
    path = scratch_path(spark, "tree")
    r.table(spark, sf, "documents").select(F.col("source").alias("output"), "text").write.partitionBy("output").text(path)
    return filetree.bytes_by_top(sources.list_files(spark, path, "*.txt")).drop("n_files")


@book.query("SELECT 'output=' || source AS top, 0::BIGINT AS n_without, true AS all_hex FROM documents GROUP BY 1")
def file_md5(spark, sf):
    """Checksums of files that Spark wrote from the documents."""
    path = scratch_path(spark, "hash")
    r.table(spark, sf, "documents").select(F.col("source").alias("output"), "text").write.partitionBy("output").text(path)
    listing = sources.list_files(spark, path, "*.txt").select(
        F.col("path").alias("original_path"), F.lit("").alias("md5"), F.lit("zenodo").alias("target_storage"), F.lit("").alias("skip_reason"))
    done = filetree.add_checksums(listing, sources.file_digests(spark, path, filetree.to_hash(listing)))
    return done.groupBy(F.split_part("original_path", F.lit("/"), F.lit(1)).alias("top")).agg(
        F.count_if(F.col("md5") == "").alias("n_without"), F.bool_and(F.col("md5").rlike("^[0-9a-f]{32}$")).alias("all_hex"))


@book.query(r.with_sql(r.NODES_SQL) + "SELECT DISTINCT uid AS value FROM nodes WHERE sampletype NOT IN ('CUS', 'D.LIN')")
def uid_list_file(spark, sf):
    uids = flat.retrieve_uids(r.nodes(spark, sf), ["CUS", "D.LIN"])
    return spark.read.text(writers.write_uid_list(uids, scratch_path(spark, "uids")))


@book.query(trees.book.sql["manifest"])
def manifest_file(spark, sf):
    path = writers.write_manifest(filetree.build_manifest(trees.files(spark, sf)), scratch_path(spark, "manifest"))
    return tables.read_manifest(spark, path).withColumn("size_bytes", F.col("size_bytes").cast("bigint"))


@book.query(f"""WITH {trees._PULLS} SELECT output, stream, n_sources AS n_files, bytes AS n_bytes, regexp_extract(paths, '([^/;]*)$', 1) AS last_name FROM plan WHERE error IS NULL""")
def pull_plan_file(spark, sf):
    inputs = trees.pull_inputs(spark, sf)
    plan = pulls.plan_table(pulls.plan_jobs(*inputs), pulls.job_sources(*inputs))
    back = tables.read_pull_plan(spark, writers.write_pull_plan(plan, scratch_path(spark, "plan")))
    return back.select(
        "output", "stream", F.size("sources").cast("bigint").alias("n_files"),
        F.aggregate("sources", F.lit(0).cast("bigint"), lambda a, s: a + s["size"]).alias("n_bytes"), F.element_at("sources", -1)["name"].alias("last_name"))


@book.query(diffs.book.sql["image_listing"].replace("image_id, dataset_id,", "image_id::VARCHAR AS image_id, dataset_id::VARCHAR AS dataset_id,"))
def image_file(spark, sf):
    images = diffs._images(spark, sf)
    back = tables.read_images(spark, writers.write_images(images, "https://img.example.org", scratch_path(spark, "images")))
    return back.drop("line_no")


@book.query(f"SELECT title, assay_id, '2024-01-01T00:00:00Z' AS fetched_at_utc, 'P1' AS project_id, n_ids FROM (SELECT title, min(assay_id) AS assay_id, count(*) AS n_ids FROM ({'SELECT DISTINCT p_name AS title, p_partkey AS assay_id FROM part'}) GROUP BY 1)")
def assay_cache_file(spark, sf):
    from samplewright.operators.resolve import lowest_ids

    assays = r.table(spark, sf, "part").select(F.col("p_partkey").alias("assay_id"), F.col("p_name").alias("title"))
    path = writers.write_assay_cache(lowest_ids(assays, assays), "P1", "2024-01-01T00:00:00Z", scratch_path(spark, "cache"))
    return spark.read.json(path)


@book.query("""WITH ids AS (SELECT p_name AS title, min(p_partkey) AS assay_id, list(p_partkey ORDER BY p_partkey) AS all_ids FROM part GROUP BY 1)
SELECT title, assay_id, CASE WHEN len(all_ids) > 1 THEN array_to_string(all_ids, ',') ELSE '' END AS duplicates FROM ids""")
def assay_document(spark, sf):
    """The cache as the one document that the uploader reads, with the ids of every shared title, read back."""
    from samplewright.operators.resolve import lowest_ids, shared_titles

    assays = r.table(spark, sf, "part").select(F.col("p_partkey").alias("assay_id"), F.col("p_name").alias("title"))
    path = writers.write_assay_document(
        lowest_ids(assays, assays), shared_titles(assays, assays), "P1", "https://x.example.org", "2024-01-01T00:00:00Z", scratch_path(spark, "document"))
    known, _ = tables.read_assay_cache(spark, path)
    return known.join(tables.read_shared_titles(spark, path), "title", "left").select(
        "title", "assay_id", F.coalesce(F.array_join(F.transform("assay_ids", lambda i: i.cast("string")), ","), F.lit("")).alias("duplicates"))


@book.query("""SELECT 'samples' AS part, c_custkey AS n, c_name AS a, c_mktsegment AS b FROM customer
UNION ALL SELECT 'pairs', c_custkey, c_name || '_1', c_name || '_2' FROM customer WHERE c_custkey % 2 = 0""")
def deposit_document(spark, sf):
    """A filled deposit document, written as one JSON text and read back."""
    k, name = F.col("c_custkey"), F.col("c_name")
    rows = r.table(spark, sf, "customer").select(
        F.struct(k.alias("n"), name.alias("*library name"), F.col("c_mktsegment").alias("organism")).alias("s"),
        F.when(k % 2 == 0, F.struct(k.alias("n"), F.concat(name, F.lit("_1")).alias("file name 1"), F.concat(name, F.lit("_2")).alias("file name 2"))).alias("p"))
    # One document by its format: a deposit's samples.
    document = rows.agg(F.sort_array(F.collect_list("s")).alias("samples"), F.sort_array(F.collect_list("p")).alias("paired_end_experiments"))
    path = scratch_path(spark, "deposit")
    document.select(F.to_json(F.struct("*"))).write.text(path)
    samples, pairs = tables.read_deposit(spark, path)
    return samples.select(F.lit("samples").alias("part"), "n", F.col("`*library name`").alias("a"), F.col("organism").alias("b")).union(
        pairs.select(F.lit("pairs"), "n", "file name 1", "file name 2"))


_HEADS = [
    ["uid", "sampletype", "name", "parent", "assay_titles", "assay_ids", "json_metadata"],
    [" UID ", "Sample_Type", "Name", "Parent", "assay_titles", "assayIds", "JsonMetadata"],
    ["uid", "sampletype", "name", "Uid ", "assay_titles", "assay_ids", "json_metadata"]]


def flat_files(spark, sf):
    """Flat upload workbooks of 500 orders: plain headers, aliases, or a header given twice in place of a column."""

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        rows = [_HEADS[chunk % 3]]
        for k, cust in zip(pdf["o_orderkey"], pdf["o_custkey"], strict=True):
            uid = f"ORD-{r.DATE}{r.LAB}-{k}"
            fourth = f"CUS-{r.DATE}{r.LAB}-{cust}" if chunk % 3 < 2 else uid
            odd = ',"Odd":"x"' if k % 700 == 7 else ""
            rows.append([None] * 7 if k % 50 == 3 else [
                uid if chunk % 3 < 2 else "first" if k % 2 else None, "ORD", f"order {k}", fourth, "Cell Culture; RNA extraction" if k % 4 else None,
                int(k) if k % 5 else None, f'{{"UID":"{uid}","Name":"order {k}"{odd}}}'])
        return pd.DataFrame({"path": [f"/up/flat_{chunk}.xlsx"], "content": [render_workbook({"Samples": rows, "Notes": [["x"]]})]})

    orders = r.table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("chunk", F.expr(f"o_orderkey div {_CHUNK}"))
    return orders.repartition(spark.sparkContext.defaultParallelism, "chunk").groupBy("chunk").applyInPandas(
        lambda pdf: render(pdf.sort_values("o_orderkey")), "path string, content binary")


_FLAT = f"""
flat AS (SELECT '/up/flat_' || o_orderkey // {_CHUNK} || '.xlsx' AS file, o_orderkey // {_CHUNK} % 3 AS kind, o_orderkey AS k, o_orderkey % {_CHUNK} + 2 AS row_n, {r._U('ORD', 'o_orderkey')} AS uid,
  'order ' || o_orderkey AS name, CASE WHEN o_orderkey // {_CHUNK} % 3 < 2 THEN {r._U('CUS', 'o_custkey')} END AS parent,
  CASE WHEN o_orderkey % 4 > 0 THEN 'Cell Culture; RNA extraction' END AS assay_titles, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey::VARCHAR END AS assay_ids,
  o_orderkey % 700 = 7 AS odd FROM orders WHERE o_orderkey % 50 <> 3)"""


@book.query(f"""WITH {_FLAT} SELECT file, row_n, uid, 'ORD' AS sampletype, name, parent, assay_titles, assay_ids,
  '{{"UID":"' || uid || '","Name":"' || name || '"' || CASE WHEN odd THEN ',"Odd":"x"' ELSE '' END || '}}' AS json_metadata FROM flat""")
def flat_upload_scan(spark, sf):
    """Flat upload sheets: the rows that all checks start from, whatever the case and the alias of their headers."""
    return sheets.flat_upload(sheets.scan_workbooks(flat_files(spark, sf), ["Samples"]))


@book.query(f"""WITH {_FLAT},
per AS (SELECT file, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS n_missing, CASE kind WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n_repeated, max(odd::INT)::BIGINT AS n_names FROM flat GROUP BY file, kind)
SELECT file, n_missing, n_repeated, n_names, n_missing + n_repeated + n_names = 0 AS valid FROM per
UNION ALL SELECT NULL, sum(n_missing)::BIGINT, sum(n_repeated)::BIGINT, sum(n_names)::BIGINT, sum(n_missing + n_repeated + n_names) = 0 FROM per""")
def batch_structure(spark, sf):
    """The structure of every flat upload file, its own headers included, and one verdict for the batch."""
    cells = cut(sheets.scan_workbooks(flat_files(spark, sf), ["Samples"]))
    rows = checks.prepare(sheets.flat_upload(cells))
    return checks.batch_structure(sheets.sheet_headers(cells), rows, r.catalogue_fields(spark))


@book.query("SELECT sum((o_orderkey % 4 <> 1)::INT)::BIGINT AS n_in_scope, FALSE AS with_misses, TRUE AS without_misses FROM orders")
def guarded_write(spark, sf):
    """A patch with unmapped rows is refused; without them it is written."""
    patched = cut(diffs._patched(spark, sf))
    bad = "state IN ('no_id', 'not_in_roster')"
    refused = writers.guarded_write(patched, bad, scratch_path(spark, "refused"), write=True)
    path = scratch_path(spark, "written")
    written = writers.guarded_write(patched.where(f"NOT ({bad})"), bad, path, write=True)
    return patched.agg(
        F.count_if(F.col("state") != "out_of_scope").alias("n_in_scope"), F.lit(refused).alias("with_misses"), F.lit(written).alias("without_misses"))


@book.query(f"WITH {diffs._ROSTER} SELECT sample_id, accession, n_lines FROM gsm")
def roster_file(spark, sf):
    """A roster written as text and read back; the line numbers of one file keep its order."""
    path = scratch_path(spark, "roster")
    k = F.col("line_no")
    diffs._roster(spark, sf).orderBy(k).select(F.concat_ws("  ", "accession", "title").alias("value")).write.text(path)
    return backfill.roster_map(tables.read_roster(spark, path))


@book.query("""SELECT o_orderkey AS row_n, 'ORD-' || o_orderkey AS uid, o_orderstatus AS sampletype FROM orders""")
def header_aliases(spark, sf):
    rows = r.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_n"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias(" UID "),
        F.col("o_orderstatus").alias("Sample_Type"))
    return t.with_canonical_headers(rows)


@book.query("""SELECT trim(c_name) AS sample_annotation, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_custkey::VARCHAR END AS mouse_acc, c_mktsegment AS folder FROM customer WHERE c_custkey % 5 > 0""")
def sample_list(spark, sf):
    k = F.col("c_custkey")
    there = lambda c: F.when(k % 5 > 0, c)
    return tables.parse_sample_list(r.table(spark, sf, "customer").select(
        there(F.concat(F.lit(" "), "c_name")).alias("Sample Annotation"), there(F.when(k % 3 > 0, k)).cast("string").alias("Mouse Acc.# ID#"),
        there(F.concat("c_mktsegment", F.lit("\t"))).alias("Folder Name")))
