"""File trees: classification, manifests, staging, hashes; pull plans and deposit sheets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from samplewright.functions import paths as p
from samplewright.model import local_table
from samplewright.operators import deposit, filetree, pulls
from samplewright.plans import registry as r
from samplewright.plans.base import Book
from samplewright.session import spread, stored

book = Book()

# One path shape per line, `{k}` is the order key, with what its classification must be.
FIELDS = ["figure", "device_id", "region", "acquisition", "roi", "category", "target_storage", "sampletype", "target_filename",
          "skip_reason", "notes"]
_SKIP = lambda path, fig, cat, why: (path, fig, "", "na", "", "", cat, "skip", "", "", why, "")
VARIANTS = [
    ("Figure 1/s{k}/intrav_sim_final.mph", 1, "", "na", "", "", "comsol-model", "zenodo", "MDL", "intrav_sim_final.mph", "", ""),
    _SKIP("Figure 1/other{k}.txt", 1, "unknown", "unexpected file under Figure 1"),
    _SKIP("Figure 2/Movie{k}.TIF", 2, "excluded-movie", "excluded from submitted manuscript"),
    ("Figure 2/velocity sims/fused-DEV-{k}.tif", 2, "", "na", "", "", "velocity-sim", "zenodo", "D.SIM", "velsim-dev-{k}.tif", "",
     "muVes simulation output"),
    ("Figure 2/TC area over time/Dev {k}_A.oib", 2, "dev-{k}-a", "na", "", "", "tc-area", "omero", "D.IMG", "tc-area-dev-{k}-a.oib", "", ""),
    ("Figure 2/TC area over time/d4/Dev_{k}.tif", 2, "dev-{k}", "na", "", "", "tc-area-early", "omero", "D.IMG", "tc-area-d4-dev-{k}.tif",
     "", "early timepoint d4"),
    ("Figure 3/abc dev {k}.oib", 3, "abc-dev-{k}", "tissue", "", "", "imaging-raw", "omero", "D.IMG", "abc-dev-{k}_t.oib", "", ""),
    ("Figure 3/dev-{k}_0002/ROI3_02.oib", 3, "dev-{k}", "chamber", "0002", "R3_02", "imaging-tile", "omero", "D.IMG",
     "dev-{k}_c0002_R3_02.oib", "", ""),
    ("Figure 5/231-day9-dev-{k}_0001/roi1-01.oib.csv", 5, "231-day9-gel-dev-{k}", "chamber", "0001", "R1_01", "quantification", "zenodo",
     "A.IMG", "231-day9-gel-dev-{k}_c0001_R1_01.csv", "", ""),
    ("Figure 6/ImgLib/a{k}.PNG", 6, "", "na", "", "", "storm-density", "zenodo", "A.IMG", "a{k}.PNG", "", "STORM density map (ImgLib)"),
    ("Figure 6/STORMLib/deep/b{k}.txt", 6, "", "na", "", "", "storm-coords", "zenodo", "A.IMG", "b{k}.txt", "",
     "STORM coordinates (STORMLib)"),
    _SKIP("Figure 6/x{k}.csv", 6, "unknown", "unexpected file under Figure 6"),
    _SKIP("Figure 7/Figure 3/x{k}.oib", 7, "duplicate", "byte-identical mirror of top-level Figure 3"),
    _SKIP("Figure 4/unknown{k}.xyz", 4, "unknown", "unrecognized pattern: Figure 4/unknown{k}.xyz"),
    ("Figure 4/mcf7 TC-100 dev{k}/12_03.oib", 4, "MCF7-TC100-dev{k}", "chamber", "0001", "T12_03", "imaging-tile", "omero", "D.IMG",
     "MCF7-TC100-dev{k}_c0001_T12_03.oib", "", ""),
    ("Figure 2/d7-1000tcs-dev-x{k}_0003/15uM Bottom left10_01.oib", 2, "d7-1000TCs-dev-x{k}", "na", "0003", "BL10_01", "imaging-tile", "omero",
     "D.IMG", "d7-1000TCs-dev-x{k}_a0003_BL10_01.oib", "", "original tile prefix: '15uM'"),
    ("Figure 3/dev y{k}_0001/DEV-Y{k}.oib", 3, "dev-y{k}", "chamber", "0001", "", "stitched-image", "zenodo", "A.IMG",
     "dev-y{k}_c0001_chamber-fused.oib", "", "FluoView-stitched composite saved under device name"),
    ("Figure 4/dev-z{k}-0005/MATL_Mosaic.log", 4, "dev-z{k}", "chamber", "0005", "", "mosaic-log", "zenodo", "", "dev-z{k}_c0005_mosaic.log",
     "", "attach as Link_SecondaryData on parent D.IMG row(s)"),
    ("Figure 4/dev-z{k}-0005/TileConfiguration.registered.txt", 4, "dev-z{k}", "chamber", "0005", "", "stitch-config", "zenodo", "",
     "dev-z{k}_c0005_tilecfg-reg.txt", "", "Fiji stitching output (registered)"),
    ("Figure 7/pm6 dev w{k}_0001/Fused.tif", 7, "PM6-dev-w{k}", "chamber", "0001", "", "stitched-image", "zenodo", "A.IMG",
     "PM6-dev-w{k}_c0001_fused.tif", "", "stitched composite of ROI tiles"),
    _SKIP("Figure 9/a{k}.oib", 9, "unknown", "unrecognized pattern: Figure 9/a{k}.oib"),
    _SKIP("Other/a{k}.oib", 0, "unknown", "not under Figure N: Other/a{k}.oib"),
    ("Figure 3/é dev{k}.tif", 3, "dev{k}", "tissue", "", "", "imaging-raw", "omero", "D.IMG", "dev{k}_t.tif", "", ""),
    _SKIP("Figure 4/a{k}.oib.bak", 4, "unknown", "unrecognized pattern: Figure 4/a{k}.oib.bak"),
    ("Figure 4/dev-q{k}_0001/TileConfiguration.txt", 4, "dev-q{k}", "chamber", "0001", "", "stitch-config", "zenodo", "",
     "dev-q{k}_c0001_tilecfg.txt", "", "Fiji stitching input"),
    _SKIP("Figure 5/d9-231-flow-dev-{k}_0007/07-3.oib", 5, "unknown", "unrecognized pattern: Figure 5/d9-231-flow-dev-{k}_0007/07-3.oib"),
]
_N = len(VARIANTS)


def _fill(template: str, key: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), key.cast("string"))


def _choose(column: int) -> Column:
    k = F.col("o_orderkey")
    chain = F.when(F.lit(False), F.lit(""))
    for i, variant in enumerate(VARIANTS):
        chain = chain.when(k % _N == i, _fill(str(variant[column]), k))
    return chain


def files(spark, sf):
    """One file per order: (path, length, mtime)."""
    return spread(r.table(spark, sf, "orders")).select(
        _choose(0).alias("path"), (F.col("o_orderkey") * 7 + 1).alias("length"), F.col("o_orderdate").alias("mtime"),
        F.col("o_orderkey").alias("k"))


def _case(column: int, kind: str = "") -> str:
    whens = " ".join("WHEN {} THEN replace('{}', '{{k}}', o_orderkey::VARCHAR)".format(i, str(v[column]).replace("'", "''"))
                     for i, v in enumerate(VARIANTS))
    return f"(CASE o_orderkey % {_N} {whens} END){kind}"


_EXPECTED = "expected AS (SELECT o_orderkey AS k, o_orderkey * 7 + 1 AS length, o_orderdate AS mtime, " + ", ".join(
    [f"{_case(0)} AS path"] + [f"{_case(i + 1, '::INT' if f == 'figure' else '')} AS {f}" for i, f in enumerate(FIELDS)]) + """ FROM orders),
placed AS (SELECT *, CASE WHEN target_filename = '' THEN '' WHEN target_storage = 'omero' THEN 'Figure ' || figure || '/' || target_filename
    WHEN target_storage = 'zenodo' THEN 'Figure ' || figure || ' - secondary/' || target_filename ELSE '' END AS target_relpath FROM expected),
walked AS (SELECT * FROM placed WHERE figure BETWEEN 1 AND 7)"""


@book.query(f"WITH {_EXPECTED} SELECT path, {', '.join(FIELDS)}, target_relpath FROM placed")
def classify_paths(spark, sf):
    df = p.classify_paths(files(spark, sf).select("path"))
    return df.withColumn("target_relpath", p.target_relpath("figure", "target_filename", "target_storage"))


@book.query(f"""WITH {_EXPECTED} SELECT lpad((row_number() OVER (ORDER BY string_split(path, '/')))::VARCHAR, 6, '0') AS id, path AS original_path, length AS size_bytes,
  strftime(mtime, '%Y-%m-%dT%H:%M:%S') AS mtime_iso, '' AS md5, figure::VARCHAR AS figure, {', '.join(FIELDS[1:])}, target_relpath FROM walked""")
def manifest(spark, sf):
    return filetree.build_manifest(files(spark, sf))


@book.query(f"""WITH {_EXPECTED} SELECT 'storage' AS dimension, target_storage AS value, count(*) AS n_files FROM walked GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM walked GROUP BY 2 UNION ALL SELECT 'figure', figure::VARCHAR, count(*) FROM walked GROUP BY 2
UNION ALL SELECT 'total', '', count(*) FROM walked""")
def walk_summary(spark, sf):
    return filetree.walk_summary(filetree.classify_listing(files(spark, sf)))


@book.query(f"WITH {_EXPECTED} SELECT path AS original_path, skip_reason FROM walked WHERE category = 'unknown' ORDER BY path LIMIT 10")
def unclassified(spark, sf):
    listing = filetree.classify_listing(files(spark, sf)).withColumnRenamed("path", "original_path")
    return filetree.unclassified(listing).select("original_path", "skip_reason")


@book.query(f"""WITH {_EXPECTED} SELECT target_relpath, original_path, n_sources FROM (SELECT target_relpath, path AS original_path,
  count(*) OVER (PARTITION BY target_relpath) AS n_sources FROM walked WHERE target_storage <> 'skip') WHERE n_sources > 1""")
def collisions(spark, sf):
    return filetree.collisions(filetree.classify_listing(files(spark, sf)).withColumnRenamed("path", "original_path"))


_DISK = f"""{_EXPECTED},
moved AS (SELECT *, (k // {_N}) % 5 AS st FROM walked WHERE category <> 'comsol-model' AND target_storage <> 'skip')"""


def _disk(spark, sf):
    """A manifest, written once so that its rules run once, and a listing: files at their source, at their target, at both, changed in
    size, or gone."""
    plan = stored(filetree.classify_listing(files(spark, sf)).where("category <> 'comsol-model'").select(
        F.col("k").cast("string").alias("id"), F.col("path").alias("original_path"), "target_relpath", "target_storage",
        F.col("length").alias("size_bytes"), "k"), "plan")
    state = F.expr(f"(k div {_N}) % 5")
    moving = plan.where("target_storage <> 'skip'")
    listing = moving.where(state.isin(0, 3)).select(F.col("original_path").alias("path"), F.col("size_bytes").alias("length")).union(
        moving.where(state.isin(1, 2, 3)).select("target_relpath", F.col("size_bytes") + F.when(state == 2, 1).otherwise(0)))
    return plan.drop("k"), listing


@book.query(f"""WITH {_DISK} SELECT k::VARCHAR AS id, path AS original_path, target_relpath, length AS size_bytes,
  CASE WHEN st IN (1, 3) THEN length WHEN st = 2 THEN length + 1 END AS dst_length,
  CASE st WHEN 0 THEN 'not_moved' WHEN 4 THEN 'missing_both' WHEN 2 THEN 'size_drift' ELSE 'ok' END AS status FROM moved""")
def drift_report(spark, sf):
    return filetree.verify_disk(*_disk(spark, sf))


@book.query(f"""WITH {_DISK} SELECT CASE st WHEN 0 THEN 'move' WHEN 4 THEN 'missing' ELSE 'already' END AS action, count(*) AS n FROM moved GROUP BY 1
UNION ALL SELECT 'skip', count(*) FROM walked WHERE target_storage = 'skip'""")
def move_plan(spark, sf):
    return filetree.move_plan(*_disk(spark, sf)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"WITH {_DISK} SELECT k::VARCHAR AS id, target_relpath, path AS original_path FROM moved WHERE st IN (1, 2)")
def restore_plan(spark, sf):
    return filetree.restore_plan(*_disk(spark, sf))


_WHOLE_DISK = f"""{_EXPECTED},
moving AS (SELECT *, (k // {_N}) % 5 AS st FROM walked WHERE target_storage <> 'skip'),
disk AS (SELECT path, max(length) AS length FROM (
  SELECT path, length FROM moving WHERE st IN (0, 3)
  UNION ALL SELECT target_relpath, length + CASE WHEN st = 2 THEN 1 ELSE 0 END FROM moving WHERE st IN (1, 2, 3)) GROUP BY 1),
seen AS (SELECT m.*, s.length AS src_length, d.length AS dst_length FROM moving m LEFT JOIN disk s ON m.path = s.path LEFT JOIN disk d ON m.target_relpath = d.path)"""


def _whole_disk(spark, sf):
    """As `_disk`, with the files whose targets collide: what lies at a shared target is one file."""
    plan = stored(filetree.classify_listing(files(spark, sf)).select(
        F.col("k").cast("string").alias("id"), F.col("path").alias("original_path"), "target_relpath", "target_storage",
        F.col("length").alias("size_bytes"), "k"), "plan")
    state = F.expr(f"(k div {_N}) % 5")
    moving = plan.where("target_storage <> 'skip'")
    here = moving.where(state.isin(0, 3)).select(F.col("original_path").alias("path"), F.col("size_bytes").alias("length"))
    there = moving.where(state.isin(1, 2, 3)).select("target_relpath", F.col("size_bytes") + F.when(state == 2, 1).otherwise(0))
    return plan.drop("k"), here.union(there).groupBy("path").agg(F.max("length").alias("length"))


@book.query(f"""WITH {_WHOLE_DISK} SELECT k::VARCHAR AS id, path AS original_path, target_relpath, length AS size_bytes, dst_length,
  CASE WHEN dst_length IS NULL AND src_length IS NOT NULL THEN 'not_moved' WHEN dst_length IS NULL THEN 'missing_both' WHEN dst_length <> length THEN 'size_drift' ELSE 'ok' END AS status
FROM seen""")
def drift_report_all(spark, sf):
    """The drift report over all files: of files that share a target, those of another size than what lies there have drifted."""
    return filetree.verify_disk(*_whole_disk(spark, sf))


@book.query(f"""WITH {_WHOLE_DISK} SELECT k::VARCHAR AS id, path AS original_path, target_relpath,
  CASE WHEN dst_length IS NOT NULL THEN 'already' WHEN src_length IS NOT NULL THEN 'move' ELSE 'missing' END AS action FROM seen
UNION ALL SELECT k::VARCHAR, path, target_relpath, 'skip' FROM walked WHERE target_storage = 'skip'""")
def move_plan_all(spark, sf):
    return filetree.move_plan(*_whole_disk(spark, sf))


@book.query(f"WITH {_WHOLE_DISK} SELECT k::VARCHAR AS id, target_relpath, path AS original_path FROM seen WHERE dst_length IS NOT NULL AND src_length IS NULL")
def restore_plan_all(spark, sf):
    return filetree.restore_plan(*_whole_disk(spark, sf))


_STAGE_FILES = """
staged_files AS (
  SELECT o_orderkey AS k, o_orderkey % 8 AS j, CASE o_orderkey % 8 WHEN 0 THEN 'Figure 2/f' WHEN 1 THEN 'Figure 3/sub/f' WHEN 2 THEN 'Source Data/f'
    WHEN 3 THEN 'Source Data/f' WHEN 4 THEN 'Figure 4/Figure4_D.CSV/f' WHEN 5 THEN 'Figures/f' WHEN 6 THEN 'Figure 2/._f' ELSE 'Figure 6/g' END
    || o_orderkey || '.csv' AS path FROM orders),
plan AS (
  SELECT path, CASE j WHEN 7 THEN 'g' ELSE 'f' END || k || '.csv' AS filename, CASE j WHEN 1 THEN 'D.IMG' WHEN 2 THEN 'D.SIM' WHEN 7 THEN NULL ELSE 'D.CSV' END AS sampletype,
    CASE WHEN j < 7 THEN 'U' || k END AS uid, CASE j WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 4 THEN 4 WHEN 7 THEN 6 END AS figure,
    CASE j WHEN 0 THEN CASE WHEN k % 16 = 8 THEN 'collision' ELSE 'stage' END WHEN 1 THEN 'image' WHEN 2 THEN 'stage' WHEN 3 THEN 'no_figure' WHEN 4 THEN 'staged' ELSE 'uncurated' END AS state
  FROM staged_files WHERE j NOT IN (5, 6)
  UNION ALL SELECT 'Figure 2/Figure2_D.CSV/f' || k || '.csv', 'f' || k || '.csv', 'D.CSV', 'U' || k, 2, 'staged' FROM staged_files WHERE k % 16 = 8)"""


def _stage_plan(spark, sf):
    k = F.col("o_orderkey")
    orders = r.table(spark, sf, "orders")
    heads = ["Figure 2/f", "Figure 3/sub/f", "Source Data/f", "Source Data/f", "Figure 4/Figure4_D.CSV/f", "Figures/f", "Figure 2/._f", "Figure 6/g"]
    head = F.get(F.array(*map(F.lit, heads)), (k % 8).cast("int"))
    name = lambda h: F.concat(h, k.cast("string"), F.lit(".csv"))
    listing = orders.select(name(head).alias("path")).union(
        orders.where("o_orderkey % 16 = 8").select(name(F.lit("Figure 2/Figure2_D.CSV/f"))))
    index = orders.where("o_orderkey % 8 < 7").select(
        name(F.lit("f")).alias("filename"), F.when(k % 8 == 1, "D.IMG").when(k % 8 == 2, "D.SIM").otherwise("D.CSV").alias("sampletype"),
        F.concat(F.lit("U"), k.cast("string")).alias("uid"))
    return filetree.stage_plan(listing, index, {"D.SIM": 5})


@book.query(f"WITH {_STAGE_FILES} SELECT path, filename, sampletype, uid, figure, state FROM plan")
def stage_plan(spark, sf):
    return _stage_plan(spark, sf).drop("destination")


@book.query(f"""WITH {_STAGE_FILES} SELECT path, 'Figure ' || figure || '/Figure' || figure || '_' || sampletype || '/' || filename AS destination, state
FROM plan WHERE state IN ('stage', 'collision', 'staged')""")
def stage_destinations(spark, sf):
    """Where staged files go, and what already lies there."""
    return _stage_plan(spark, sf).where("state in ('stage', 'collision', 'staged')").select("path", "destination", "state")


@book.query(f"""WITH {_STAGE_FILES} SELECT state, CASE WHEN state = 'stage' THEN figure END AS figure, CASE WHEN state IN ('stage', 'image') THEN sampletype END AS sampletype,
  count(*) AS n_files FROM plan GROUP BY ALL""")
def stage_summary(spark, sf):
    return filetree.stage_summary(_stage_plan(spark, sf))


@book.query("""SELECT 'doc/' || doc_id AS path, md5(text) AS md5, strlen(text) AS length, n_copies FROM (
  SELECT *, count(*) OVER (PARTITION BY md5(text), strlen(text)) AS n_copies FROM documents) WHERE n_copies > 1""")
def content_dups(spark, sf):
    docs = r.table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("md5"),
        F.octet_length("text").cast("bigint").alias("length"))
    return filetree.content_duplicates(docs)


@book.query("""SELECT 'doc/' || doc_id AS original_path, CASE WHEN doc_id % 5 = 0 THEN 'kept' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN '' ELSE md5(text) END AS md5,
  CASE WHEN doc_id % 7 = 0 THEN 'no use' WHEN doc_id % 5 > 0 AND doc_id % 11 = 0 THEN 'md5 failed: file not readable' ELSE '' END AS skip_reason FROM documents""")
def checksums(spark, sf):
    docs, k = spread(r.table(spark, sf, "documents")), F.col("doc_id")
    path = F.concat(F.lit("doc/"), k.cast("string"))
    plan = docs.select(
        path.alias("original_path"), F.when(k % 5 == 0, "kept").otherwise("").alias("md5"),
        F.when(k % 7 == 0, "skip").otherwise("zenodo").alias("target_storage"), F.when(k % 7 == 0, "no use").otherwise("").alias("skip_reason"))
    digests = docs.where("doc_id % 11 > 0").select(path.alias("path"), F.md5("text").alias("md5"))
    return filetree.add_checksums(plan, digests).select("original_path", "md5", "skip_reason")


@book.query("SELECT count(*) FILTER (doc_id % 7 > 0 AND doc_id % 5 > 0) AS n_missing, count(*) FILTER (doc_id % 7 > 0 AND doc_id % 5 > 0) = 0 AS may_move FROM documents")
def missing_checksums(spark, sf):
    k = F.col("doc_id")
    return filetree.missing_checksums(r.table(spark, sf, "documents").select(
        F.when(k % 5 == 0, "kept").otherwise("").alias("md5"), F.when(k % 7 == 0, "skip").otherwise("zenodo").alias("target_storage")))


@book.query("SELECT source AS top, count(*) AS n_files, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY 1")
def bytes_by_top(spark, sf):
    return filetree.bytes_by_top(r.table(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("bigint").alias("length")))


# --- pull plans ------------------------------------------------------------------------------------------------------

_STRATEGY = [("b0", ["p0", "p1"], "D19"), ("b1", ["p2"], "D20"), ("b2", ["p3"], "D20"), ("b3", ["p4", "p5"], "D20"), ("b4", ["p6"], "D21")]
_PLATES = {b: ps for b, ps, _ in _STRATEGY}
_STRATEGY_SQL = r.values_sql("strategy", ["batch", "plate", "plate_no", "year", "plates"], [
    (b, plate, i, y, "[" + ", ".join(f"'{x}'" for x in ps) + "]") for b, ps, y in _STRATEGY for i, plate in enumerate(ps)])
_PULLS = f"""{_STRATEGY_SQL},
samples AS (SELECT c_custkey AS ck, 'D' || (389000 + c_custkey) AS sa, 'b' || c_custkey % 6 AS batch FROM customer),
dirs AS (SELECT s.*, plate, plate_no, plates, year || '-' || substr(sa, 2) || '-' || plate AS dir FROM samples s LEFT JOIN strategy USING (batch)),
fastq AS (SELECT o_orderkey AS ok, o_custkey, CASE o_custkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'R1' ELSE 'R2' END WHEN 1 THEN 'NA'
    WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'R1' ELSE 'NA' END WHEN 3 THEN 'R1' END AS stream, o_orderkey * 3 AS size FROM orders),
sources AS (SELECT ck, sa, batch, plate_no, stream, size, dir || '/x' || ok || CASE stream WHEN 'R1' THEN '_1' WHEN 'R2' THEN '_2' ELSE '_NA' END || '_sequence.fastq' AS path
  FROM fastq JOIN dirs ON o_custkey = ck AND plate_no = CASE WHEN batch IN ('b0', 'b3') THEN (ok // 2) % 2 ELSE 0 END WHERE stream IS NOT NULL),
n AS (SELECT sa, batch, any_value(plates) AS plates, (SELECT count(*) FROM sources x WHERE x.sa = d.sa AND stream = 'R1') AS r1, (SELECT count(*) FROM sources x WHERE x.sa = d.sa AND stream = 'R2') AS r2,
  (SELECT count(*) FROM sources x WHERE x.sa = d.sa AND stream = 'NA') AS na FROM dirs d GROUP BY ALL),
jobs AS (
  SELECT sa, batch, NULL AS kind, NULL AS stream, 'no plate strategy for batch ' || batch AS error FROM n WHERE plates IS NULL
  UNION ALL SELECT sa, batch, NULL, NULL, sa || ': AMBIGUOUS — has both paired and _NA_ files in same plate dirs' FROM n WHERE plates IS NOT NULL AND r1 > 0 AND na > 0
  UNION ALL SELECT sa, batch, 'paired-stream', 'R1', NULL FROM n WHERE plates IS NOT NULL AND r1 > 0 AND na = 0
  UNION ALL SELECT sa, batch, CASE WHEN r2 > 0 THEN 'paired-stream' END, CASE WHEN r2 > 0 THEN 'R2' END, CASE WHEN r2 = 0 THEN sa || ': missing R2 stream' END
    FROM n WHERE plates IS NOT NULL AND r1 > 0 AND na = 0
  UNION ALL SELECT sa, batch, CASE WHEN na = 1 THEN 'single' ELSE 'single-merged' END, 'NA', NULL FROM n WHERE plates IS NOT NULL AND r1 = 0 AND na > 0
  UNION ALL SELECT sa, batch, NULL, NULL, sa || ': no FASTQs found in plate dirs ' || plates FROM n WHERE plates IS NOT NULL AND r1 = 0 AND na = 0),
plan AS (SELECT j.sa, j.batch, j.kind, j.stream, j.error, CASE WHEN j.error IS NULL THEN 'fastq/' || j.batch || '/' || j.batch || '_' || j.sa ||
    CASE WHEN j.stream IN ('R1', 'R2') THEN '_' || j.stream ELSE '' END || '.fastq.gz' END AS output,
  count(s.path) AS n_sources, coalesce(sum(s.size), 0)::BIGINT AS bytes, string_agg(s.path, ';' ORDER BY plate_no, s.path) AS paths,
  string_agg(s.size::VARCHAR, ';' ORDER BY plate_no, s.path) AS sizes
  FROM jobs j LEFT JOIN sources s ON s.sa = j.sa AND s.stream = j.stream GROUP BY ALL)"""


def pull_inputs(spark, sf):
    """(samples, strategy, listing of sequence files)."""
    k = F.col("c_custkey")
    samples = r.table(spark, sf, "customer").select(
        F.concat(F.lit("D"), (k + 389000).cast("string")).alias("sample_annotation"), F.concat(F.lit("b"), (k % 6).cast("string")).alias("folder"))
    types = {"batch": None, "plates": pa.list_(pa.string()), "year_prefix": None}
    strategy = local_table(spark, types, _STRATEGY)
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    stream = (
        F.when(c % 5 == 0, F.when(o % 2 == 0, "_1").otherwise("_2")).when(c % 5 == 1, "_NA")
        .when(c % 5 == 2, F.when(o % 2 == 0, "_1").otherwise("_NA")).when(c % 5 == 3, "_1").otherwise("_other")
    )
    plates = F.create_map(*[x for i, (_, ps, y) in enumerate(_STRATEGY) for x in (
        F.lit(i), F.array(*[F.struct(F.lit(y).alias("y"), F.lit(q).alias("p")) for q in (ps * 2)[:2]]))])
    plate = F.get(F.try_element_at(plates, (c % 6).cast("int")), F.expr("cast((o_orderkey div 2) % 2 as int)"))
    source_dir = F.concat(plate["y"], F.lit("-"), (c + 389000).cast("string"), F.lit("-"), plate["p"])
    name = F.concat(F.lit("x"), o.cast("string"), stream, F.lit("_sequence.fastq"))
    listing = r.table(spark, sf, "orders").select(source_dir.alias("source_dir"), name.alias("name"), (o * 3).alias("size")).where(
        "source_dir IS NOT NULL").withColumn("path", F.concat_ws("/", "source_dir", "name"))
    return samples, strategy, listing


@book.query(f"WITH {_PULLS} SELECT sa AS sample_annotation, batch, kind, stream, n_sources, bytes AS total_src_bytes, output, error FROM plan")
def stream_grouping(spark, sf):
    return pulls.plan_jobs(*pull_inputs(spark, sf))


@book.query(f"WITH {_PULLS} SELECT sa AS sample_annotation, batch, stream, plate_no, path, size FROM sources")
def job_sources(spark, sf):
    return pulls.job_sources(*pull_inputs(spark, sf)).drop("name")


@book.query(f"""WITH {_PULLS} SELECT CASE WHEN error IS NULL THEN sa ELSE '' END AS sample_annotation, CASE WHEN error IS NULL THEN batch ELSE '' END AS batch,
  coalesce(kind, '') AS kind, coalesce(stream, '') AS stream, CASE WHEN error IS NULL THEN bytes::VARCHAR ELSE '' END AS total_src_bytes,
  CASE WHEN error IS NULL THEN n_sources::VARCHAR ELSE '' END AS n_sources, coalesce(output, '') AS output, coalesce(paths, '') AS source_paths,
  coalesce(sizes, '') AS source_sizes, coalesce(error, '') AS error FROM plan""")
def plan_table(spark, sf):
    inputs = pull_inputs(spark, sf)
    return pulls.plan_table(pulls.plan_jobs(*inputs), pulls.job_sources(*inputs))


@book.query(f"""WITH {_PULLS} SELECT coalesce(batch, 'TOTAL') AS batch, count(*) FILTER (error IS NULL) AS n_jobs, sum(bytes)::BIGINT AS src_bytes,
  count(error) AS n_errors, (sum(bytes) * 3 // 10)::BIGINT AS gzip_bytes FROM plan GROUP BY ROLLUP (batch)""")
def plan_rollup(spark, sf):
    return pulls.plan_rollup(pulls.plan_jobs(*pull_inputs(spark, sf)))


@book.query(f"WITH {_PULLS} SELECT output FROM plan WHERE error IS NULL AND output NOT IN (SELECT output FROM plan WHERE output IS NOT NULL AND bytes % 2 = 0)")
def pending_jobs(spark, sf):
    jobs = pulls.plan_jobs(*pull_inputs(spark, sf))
    there = jobs.where("output IS NOT NULL").select(F.col("output").alias("path"), F.expr("1 - total_src_bytes % 2").alias("length"))
    return pulls.pending_jobs(jobs, there).select("output")


@book.query("SELECT 'D' || (389000 + c_custkey) AS sample_annotation, 'b3' AS folder FROM customer WHERE c_custkey % 6 = 3")
def batch_samples(spark, sf):
    return pulls.of_batch(pull_inputs(spark, sf)[0], "b3")


# --- deposit sheets --------------------------------------------------------------------------------------------------

def deposit_samples(spark, sf):
    k = F.col("o_orderkey")
    raw = F.slice(F.array(*[F.concat(F.lit(f"r{i}_"), k.cast("string")) for i in range(4)]), 1, (k % 5).cast("int"))
    proc = F.slice(F.array(*[F.concat(F.lit(f"p{i}_"), k.cast("string")) for i in range(3)]), 1, (k % 4).cast("int"))
    return r.table(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.lit("lib"), k.cast("string")).alias("*library name"), F.lit("paired-end").alias("*single or paired-end"),
        F.when(k % 5 > 0, raw).alias("raw_files"), F.when(k % 3 == 0, F.lit("lone")).alias("*raw file"),
        F.when(k % 4 > 0, proc).alias("processed_data_files"), F.when(k % 8 == 0, F.lit("pa")).alias("processed data file"),
        F.when(k % 16 == 0, F.lit("pb")).alias("processed data file (2)"))


@book.query("""
SELECT o_orderkey AS k, 'lib' || o_orderkey AS "*library name", NULL AS "*title", 'paired-end' AS "*single or paired-end",
  CASE WHEN o_orderkey % 4 > 0 THEN 'p0_' || o_orderkey WHEN o_orderkey % 8 = 0 THEN 'pa' END AS "processed data file",
  CASE WHEN o_orderkey % 4 > 1 THEN 'p1_' || o_orderkey WHEN o_orderkey % 16 = 0 THEN 'pb' END AS "processed data file (2)",
  CASE WHEN o_orderkey % 4 > 2 THEN 'p2_' || o_orderkey END AS "processed data file (3)",
  CASE WHEN o_orderkey % 5 > 0 THEN 'r0_' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'lone' END AS "*raw file",
  CASE WHEN o_orderkey % 5 > 1 THEN 'r1_' || o_orderkey END AS "raw file", CASE WHEN o_orderkey % 5 > 2 THEN 'r2_' || o_orderkey END AS "raw file (2)",
  CASE WHEN o_orderkey % 5 > 3 THEN 'r3_' || o_orderkey END AS "raw file (3)" FROM orders""")
def ragged_columns(spark, sf):
    wide = deposit.deposit_table(deposit_samples(spark, sf), ["k"])
    empty = ["*library strategy", "*organism", "**tissue", "**cell line", "**cell type", "genotype", "treatment", "batch", "*molecule",
             "*instrument model", "description"]
    return wide.drop(*empty)


@book.query("SELECT 3 AS max_processed, 4 AS max_raw FROM (SELECT count(*) FROM orders)")
def list_widths(spark, sf):
    return deposit.list_widths(deposit_samples(spark, sf))


@book.query("""SELECT 'a' || o_orderkey AS "file name 1", 'b' || o_orderkey AS "file name 2", NULL AS "file name 3", NULL AS "file name 4" FROM orders""")
def paired_table(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return deposit.paired_table(r.table(spark, sf, "orders").select(
        F.concat(F.lit("a"), k).alias("file name 1"), F.concat(F.lit("b"), k).alias("file name 2"), k.alias("other")))
