"""Comparing versions, inventories and link backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.operators import backfill, diff, lineage, resolve, snapshots
from samplewright.plans import registry as r
from samplewright.plans.base import Book
from samplewright.session import cut, spread
from samplewright.sources.tables import parse_assay_pages, parse_catalogue, parse_roster

book = Book()

# --- two versions of the orders --------------------------------------------------------------------------------------

_VERSIONS = """
master AS (
  SELECT o_orderkey AS row_n, 'T' || o_orderkey % 3 AS sampletype, 'ORD-' || o_orderkey AS uid, 'ord_' || o_orderkey || '.csv' AS file,
    'https://x/' || o_orderkey AS link, 'CUS-' || o_custkey AS parent, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'GSM' || o_orderkey END AS acc
  FROM orders WHERE o_orderkey % 7 > 0),
sheets AS (
  SELECT o_orderkey AS row_n, 'T' || o_orderkey % 3 AS sampletype, 'ORD-' || o_orderkey AS uid,
    CASE o_orderkey % 5 WHEN 0 THEN ' ORD_' || o_orderkey || '.csv ' WHEN 1 THEN 'other.csv' ELSE 'ord_' || o_orderkey || '.csv' END AS file,
    'https://x/' || o_orderkey AS link, CASE WHEN o_orderkey % 13 = 0 THEN 'CUS-X' ELSE 'CUS-' || o_custkey END AS parent,
    'GSM' || o_orderkey AS acc
  FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 3 < 2
  UNION ALL SELECT o_orderkey + 1000000, 'T' || o_orderkey % 3, 'ORD-' || o_orderkey, 'late.csv', 'https://x/' || o_orderkey, 'CUS-' || o_custkey,
    'GSM' || o_orderkey FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 3 < 2),
last_sheets AS (SELECT * FROM sheets QUALIFY row_number() OVER (PARTITION BY sampletype, uid ORDER BY row_n DESC) = 1),
sides AS (SELECT coalesce(m.sampletype, s.sampletype) AS sampletype, coalesce(m.uid, s.uid) AS uid,
  CASE WHEN m.uid IS NULL THEN 'right_only' WHEN s.uid IS NULL THEN 'left_only' ELSE 'common' END AS side
  FROM master m FULL JOIN last_sheets s ON m.uid = s.uid AND m.sampletype = s.sampletype),
pairs AS (SELECT m.sampletype, m.uid, unnest(['File_PrimaryData', 'Link_PrimaryData', 'Parent', 'Accession']) AS field,
  unnest([m.file, m.link, m.parent, coalesce(m.acc, '')]) AS left_value, unnest([trim(s.file), s.link, s.parent, s.acc]) AS right_value
  FROM master m JOIN last_sheets s ON m.uid = s.uid AND m.sampletype = s.sampletype),
diffs AS (SELECT * FROM pairs WHERE left_value <> right_value)"""


def _master(spark, sf):
    k = F.col("o_orderkey")
    s = k.cast("string")
    return r.table(spark, sf, "orders").where("o_orderkey % 7 > 0").select(
        k.alias("row_n"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("sampletype"), F.concat(F.lit("ORD-"), s).alias("uid"),
        F.concat(F.lit("ord_"), s, F.lit(".csv")).alias("File_PrimaryData"), F.concat(F.lit("https://x/"), s).alias("Link_PrimaryData"),
        F.concat(F.lit("CUS-"), F.col("o_custkey").cast("string")).alias("Parent"),
        F.when(k % 6 > 0, F.concat(F.lit("GSM"), s)).alias("Accession"))


def _sheets(spark, sf):
    k = F.col("o_orderkey")
    s, kind = k.cast("string"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("sampletype")
    base = r.table(spark, sf, "orders").where("o_orderkey % 3 < 2")
    parent = F.concat(F.lit("CUS-"), F.col("o_custkey").cast("string"))
    file = F.when(k % 5 == 0, F.concat(F.lit(" ORD_"), s, F.lit(".csv "))).when(k % 5 == 1, "other.csv").otherwise(
        F.concat(F.lit("ord_"), s, F.lit(".csv")))
    tail = [F.concat(F.lit("https://x/"), s).alias("Link_PrimaryData")]
    acc = F.concat(F.lit("GSM"), s).alias("Accession")
    first = base.where("o_orderkey % 11 > 0").select(
        k.alias("row_n"), kind, F.concat(F.lit("ORD-"), s).alias("uid"), file.alias("File_PrimaryData"), *tail,
        F.when(k % 13 == 0, "CUS-X").otherwise(parent).alias("Parent"), acc)
    late = base.where("o_orderkey % 19 = 0").select(
        (k + 1000000).alias("row_n"), kind, F.concat(F.lit("ORD-"), s).alias("uid"), F.lit("late.csv").alias("File_PrimaryData"),
        *tail, parent.alias("Parent"), acc)
    return first.union(late)


@book.query(f"WITH {_VERSIONS} SELECT * FROM sides")
def key_diff(spark, sf):
    return diff.key_diff(_master(spark, sf), _sheets(spark, sf))


@book.query(f"WITH {_VERSIONS} SELECT sampletype, side, count(*) AS n_keys FROM sides GROUP BY 1, 2")
def key_diff_counts(spark, sf):
    return diff.key_diff_counts(_master(spark, sf), _sheets(spark, sf))


@book.query(f"WITH {_VERSIONS} SELECT * FROM diffs")
def field_diff(spark, sf):
    return diff.field_diff(_master(spark, sf), _sheets(spark, sf))


def _snapshots(spark, sf):
    first = snapshots.Snapshot.build(_master(spark, sf))
    return first, snapshots.Snapshot.build(_sheets(spark, sf), like=first)


@book.query(f"WITH {_VERSIONS} SELECT * FROM sides")
def snapshot_key_diff(spark, sf):
    """The key diff from stored snapshots, by the ranges whose digests differ."""
    first, second = _snapshots(spark, sf)
    return first.key_diff(second)


@book.query(f"WITH {_VERSIONS} SELECT * FROM diffs")
def snapshot_field_diff(spark, sf):
    first, second = _snapshots(spark, sf)
    return first.field_diff(second)


@book.query(f"""WITH {_VERSIONS} SELECT field, CASE WHEN lower(regexp_replace(left_value, '\\s+', '', 'g')) = lower(regexp_replace(right_value, '\\s+', '', 'g'))
  THEN 'format' ELSE 'semantic' END AS drift, count(*) AS n FROM diffs GROUP BY 1, 2""")
def drift_class(spark, sf):
    found = diff.drift_class(diff.field_diff(_master(spark, sf), _sheets(spark, sf)))
    return found.groupBy("field", "drift").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"""WITH {_VERSIONS} SELECT count(*) FILTER (side = 'common') AS n_common, count(*) FILTER (side = 'left_only') AS n_left_only,
  count(*) FILTER (side = 'right_only') AS n_right_only FROM sides""")
def set_diff(spark, sf):
    return diff.set_diff(_master(spark, sf), _sheets(spark, sf), "uid")


@book.query(f"WITH {_VERSIONS} SELECT sampletype, count(*) AS n_rows FROM master WHERE sampletype NOT IN (SELECT sampletype FROM sheets) GROUP BY 1")
def unmatched_types(spark, sf):
    return diff.unmatched_types(_master(spark, sf), _sheets(spark, sf))


@book.query("""
SELECT token, count(*) AS n_uses, count(DISTINCT source) AS n_sources FROM (
  SELECT trim(unnest(string_split(text, chr(10))), e' \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f') AS token, source FROM documents)
WHERE token <> '' GROUP BY 1""")
def token_inventory(spark, sf):
    return diff.token_inventory(spread(r.table(spark, sf, "documents")), "text", "source", "\n")


@book.query("""
SELECT DISTINCT token, source FROM (
  SELECT trim(unnest(string_split(text, ',')), e' \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f') AS token, role AS source FROM conversations)
WHERE token <> ''""")
def token_sources(spark, sf):
    return diff.token_sources(r.table(spark, sf, "conversations"), "text", "role", ",")


_URL = """CASE WHEN coalesce(u, '') = '' THEN 'empty' WHEN contains(lower(u), 'zenodo.org') THEN 'zenodo' WHEN contains(lower(u), 'omero') THEN 'omero'
  WHEN contains(lower(u), 'geo/query') OR contains(lower(u), 'ncbi.nlm.nih.gov/geo') THEN 'geo' WHEN starts_with(lower(u), 'http') THEN 'other_url'
  ELSE 'non_url' END"""


@book.query(f"""SELECT {_URL} AS url_type, count(*) AS n_cells, {_URL} <> 'empty' AS filled FROM (
  SELECT url AS u FROM pages UNION ALL SELECT CASE event_type WHEN 'click' THEN 'https://Zenodo.org/r/' || event_id WHEN 'view' THEN 'HTTPS://omero.x/' || event_id
    WHEN 'error' THEN '' WHEN 'signup' THEN NULL ELSE 'https://www.ncbi.nlm.nih.gov/geo/x' END FROM events) GROUP BY ALL""")
def url_tally(spark, sf):
    e = F.col("event_type")
    k = F.col("event_id").cast("string")
    link = F.when(e == "click", F.concat(F.lit("https://Zenodo.org/r/"), k)).when(e == "view", F.concat(F.lit("HTTPS://omero.x/"), k)).when(
        e == "error", "").when(e == "purchase", "https://www.ncbi.nlm.nih.gov/geo/x")
    cells = r.table(spark, sf, "pages").select(F.col("url").alias("link")).union(r.table(spark, sf, "events").select(link.alias("link")))
    return diff.link_tally(cells, "link")


@book.query(r.with_sql(r.ORDER_UPLOAD_SQL) + """
SELECT arm, count(*) FILTER (coalesce(j_link, '') <> '') AS n_filled, count(*) AS n_cells FROM parsed GROUP BY 1""")
def fill_rate(spark, sf):
    rows = r.order_upload(spark, sf).select("arm", t.attr(t.payload("json_metadata"), "Link_PrimaryData").alias("link"))
    return diff.fill_rate(rows, "link", "arm")


@book.query("""
SELECT DISTINCT field, value FROM (SELECT unnest(['p_name', 'p_brand', 'p_type']) AS field, unnest([trim(p_name), trim(p_brand), trim(p_type)]) AS value FROM part)
WHERE value <> ''""")
def vocab(spark, sf):
    return diff.vocabulary(r.table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


# --- images and manifests --------------------------------------------------------------------------------------------

_IMAGES = """
manifest AS (SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS id, 'Figure 3/raw_' || o_orderkey || '.oib' AS original_path, md5(o_orderkey::VARCHAR) AS md5,
    '3' AS figure, CASE o_orderkey % 4 WHEN 3 THEN 'zenodo' ELSE 'omero' END AS target_storage, 'img_' || o_orderkey || '.oib' AS target_filename FROM orders),
images AS (SELECT event_id AS image_id, 'img_' || CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id * 2 END || '.oib' AS filename, user_id AS dataset_id FROM events)"""


def _manifest(spark, sf):
    k = F.col("o_orderkey")
    s = k.cast("string")
    return r.table(spark, sf, "orders").select(
        F.lpad(s, 9, "0").alias("id"), F.concat(F.lit("Figure 3/raw_"), s, F.lit(".oib")).alias("original_path"), F.md5(s).alias("md5"),
        F.lit("3").alias("figure"), F.when(k % 4 == 3, "zenodo").otherwise("omero").alias("target_storage"),
        F.concat(F.lit("img_"), s, F.lit(".oib")).alias("target_filename"))


def _images(spark, sf):
    k = F.col("event_id")
    name = F.concat(F.lit("img_"), F.when(k % 10 == 0, 0).otherwise(k * 2).cast("string"), F.lit(".oib"))
    return r.table(spark, sf, "events").select(k.alias("image_id"), name.alias("filename"), F.col("user_id").alias("dataset_id"))


@book.query(f"""WITH {_IMAGES},
want AS (SELECT * FROM manifest WHERE target_storage = 'omero'),
got AS (SELECT filename, count(*) AS n, min(image_id) AS image_id FROM images GROUP BY 1),
j AS (SELECT coalesce(target_filename, filename) AS filename, coalesce(n, 0) AS n_images, image_id, original_path, md5, figure, target_filename AS w, filename AS g
  FROM want FULL JOIN got ON target_filename = filename)
SELECT filename, finding, n_images, image_id, original_path, md5, figure FROM (
  SELECT *, 'missing' AS finding FROM j WHERE g IS NULL UNION ALL SELECT *, 'extra' FROM j WHERE w IS NULL UNION ALL SELECT *, 'duplicate' FROM j WHERE n_images > 1)""")
def expected_vs_pulled(spark, sf):
    return diff.expected_vs_pulled(_manifest(spark, sf), _images(spark, sf))


@book.query(f"WITH {_IMAGES} SELECT filename, image_id, n_images FROM (SELECT *, count(*) OVER (PARTITION BY filename) AS n_images FROM images) WHERE n_images > 1")
def duplicate_imports(spark, sf):
    return diff.duplicate_imports(_images(spark, sf))


_DETAIL = """CASE WHEN dataset_id = 0 THEN 'https://img.example.org/webclient/img_detail/' || image_id || '/'
  ELSE 'https://img.example.org/webclient/img_detail/' || image_id || '/?dataset=' || dataset_id END"""


@book.query(f"""WITH {_IMAGES} SELECT filename, image_id, dataset_id, '' AS dataset_name, '' AS project_id, '' AS project_name, '' AS fileset_id,
  {_DETAIL} AS web_url, 'https://img.example.org/webclient/?show=image-' || image_id AS show_url FROM images""")
def image_listing(spark, sf):
    from samplewright.sinks.writers import image_listing as listing

    return listing(_images(spark, sf), "https://img.example.org")


@book.query(f"""WITH {_IMAGES},
last AS (SELECT filename, arg_max(CASE WHEN image_id % 3 = 0 THEN CASE WHEN image_id % 9 = 0 THEN NULL ELSE 'show-' || image_id END
    ELSE 'web-' || image_id END, image_id) AS old_url, max(image_id) AS m FROM images GROUP BY 1),
links AS (SELECT filename, CASE WHEN m % 9 = 0 THEN NULL WHEN m % 3 = 0 THEN 'show-' || m ELSE 'web-' || m END AS url FROM last)
SELECT o_orderkey AS k, coalesce(url, old) AS link_primarydata, url IS NOT NULL AS touched, (coalesce(url, old) IS DISTINCT FROM old)::INT AS changed
FROM (SELECT o_orderkey, 'img_' || o_orderkey || '.oib' AS f, CASE WHEN o_orderkey % 2 = 0 THEN 'web-' || (o_orderkey // 2) END AS old FROM orders)
LEFT JOIN links ON f = filename""")
def backfill_by_name(spark, sf):
    k = F.col("image_id")
    images = _images(spark, sf).select(
        "filename", "image_id", F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("web-"), k.cast("string"))).alias("web_url"),
        F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("show-"), k.cast("string"))).alias("show_url"))
    o = F.col("o_orderkey")
    rows = r.table(spark, sf, "orders").select(
        o.alias("k"), F.concat(F.lit("img_"), o.cast("string"), F.lit(".oib ")).alias("file"),
        F.when(o % 2 == 0, F.concat(F.lit("web-"), F.expr("o_orderkey div 2").cast("string"))).alias("link_primarydata"))
    links = backfill.image_links(images, ["image_id"])
    return backfill.backfill_by_name(rows, links, "file").select("k", "link_primarydata", "touched", "changed")


_ARCHIVES = """
members AS (SELECT 'bucket_' || d.doc_id % 9 || '.zip' AS zip_name, 'f_' || (d.doc_id % 400) || '.txt' AS filename FROM documents d),
listed AS (SELECT p_partkey AS row_n, CASE p_partkey % 3 WHEN 0 THEN 'D.TXT' WHEN 1 THEN 'A.TXT' ELSE 'Q.TXT' END AS sampletype, 'U-' || p_partkey AS uid,
  'f_' || p_partkey % 300 || '.txt' AS file FROM part),
idx AS (SELECT file AS filename, sampletype, uid FROM listed QUALIFY row_number() OVER (PARTITION BY file ORDER BY row_n) = 1),
matched AS (SELECT zip_name, m.filename, sampletype, uid, CASE WHEN uid IS NULL THEN 'no_curation_match' WHEN sampletype = 'Q.TXT' THEN 'no_sheet' ELSE 'matched' END AS state
  FROM members m LEFT JOIN idx i ON m.filename = i.filename),
links AS (SELECT sampletype, uid, 'https://zenodo.org/records/77/files/' || max(zip_name) || '?download=1&preview=1' AS url FROM matched WHERE state = 'matched' GROUP BY 1, 2)"""


def _members(spark, sf):
    k = F.col("doc_id")
    return r.table(spark, sf, "documents").select(
        F.concat(F.lit("bucket_"), (k % 9).cast("string"), F.lit(".zip")).alias("zip_name"),
        F.concat(F.lit("f_"), (k % 400).cast("string"), F.lit(".txt")).alias("filename"))


def _listed(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "D.TXT").when(k % 3 == 1, "A.TXT").otherwise("Q.TXT")
    return r.table(spark, sf, "part").select(
        k.alias("row_n"), F.lit(0).alias("sheet_pos"), kind.alias("sampletype"), F.concat(F.lit("U-"), k.cast("string")).alias("uid"),
        F.concat(F.lit("f_"), (k % 300).cast("string"), F.lit(".txt ")).alias("file_primarydata"))


def _matched(spark, sf):
    listed = _listed(spark, sf)
    sheets = listed.where("sampletype <> 'Q.TXT'")
    return backfill.match_members(_members(spark, sf), resolve.file_index(listed), sheets)


@book.query(f"WITH {_ARCHIVES} SELECT * FROM idx")
def file_index(spark, sf):
    return resolve.file_index(_listed(spark, sf))


@book.query(f"WITH {_ARCHIVES} SELECT state, zip_name, count(*) AS n, count(uid) AS n_uids FROM matched GROUP BY 1, 2")
def member_matches(spark, sf):
    return _matched(spark, sf).groupBy("state", "zip_name").agg(F.count(F.lit(1)).alias("n"), F.count("uid").alias("n_uids"))


@book.query(f"""WITH {_ARCHIVES} SELECT l.uid, l.sampletype, url AS link_primarydata, url IS NOT NULL AS touched, (url IS NOT NULL)::INT AS changed
FROM listed l LEFT JOIN links k ON l.sampletype = k.sampletype AND l.uid = k.uid""")
def backfill_by_uid(spark, sf):
    links = backfill.archive_links(_matched(spark, sf), "77")
    return backfill.backfill_by_uid(_listed(spark, sf), links).select("uid", "sampletype", "link_primarydata", "touched", "changed")


# --- accessions ------------------------------------------------------------------------------------------------------

_LINE = """CASE c_custkey % 10 WHEN 0 THEN '# GSM comment' WHEN 1 THEN 'GSMonly' WHEN 2 THEN 'GSM' || (1000 + c_custkey) || '  spot (D22-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ') left'
  WHEN 3 THEN 'GSM' || (1000 + c_custkey) || ' no id here' WHEN 4 THEN '  GSM' || (1000 + c_custkey) || chr(9) || 'lib_D' || (389000 + c_custkey - 1)
  ELSE 'GSM' || (1000 + c_custkey) || ' lib_D' || (389000 + c_custkey) END"""
_ROSTER = f"""
lines AS (SELECT c_custkey AS line_no, trim({_LINE}) AS line FROM customer),
roster AS (SELECT line_no, regexp_extract(line, '^(\\S+)\\s+(.*)$', 1) AS accession, regexp_extract(line, '^(\\S+)\\s+(.*)$', 2) AS title FROM lines
  WHERE line <> '' AND line[1] <> '#' AND regexp_matches(line, '\\s')),
ids AS (SELECT *, coalesce(nullif(regexp_extract(title, '_(D\\d+)\\s*$', 1), ''), nullif(regexp_extract(title, '\\((D\\d{{2}}-\\d{{4}})\\)', 1), '')) AS sample_id FROM roster),
gsm AS (SELECT sample_id, arg_max(accession, line_no) AS accession, count(*) AS n_lines FROM ids WHERE sample_id IS NOT NULL GROUP BY 1)"""


def _roster(spark, sf):
    k = F.col("c_custkey")
    g = F.concat(F.lit("GSM"), (k + 1000).cast("string"))
    line = (
        F.when(k % 10 == 0, "# GSM comment").when(k % 10 == 1, "GSMonly")
        .when(k % 10 == 2, F.concat(g, F.lit("  spot (D22-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(") left")))
        .when(k % 10 == 3, F.concat(g, F.lit(" no id here")))
        .when(k % 10 == 4, F.concat(F.lit("  "), g, F.lit("\tlib_D"), (k + 389000 - 1).cast("string")))
        .otherwise(F.concat(g, F.lit(" lib_D"), (k + 389000).cast("string")))
    )
    return parse_roster(r.table(spark, sf, "customer").select(k.alias("line_no"), line.alias("value")))


@book.query(f"WITH {_ROSTER} SELECT line_no, accession, title, sample_id FROM ids")
def roster_parse(spark, sf):
    return _roster(spark, sf).withColumn("sample_id", t.roster_id("title"))


@book.query(f"WITH {_ROSTER} SELECT * FROM gsm")
def roster_map(spark, sf):
    return backfill.roster_map(_roster(spark, sf))


@book.query(f"WITH {_ROSTER} SELECT line_no, accession FROM ids WHERE sample_id IS NULL")
def roster_misses(spark, sf):
    return backfill.roster_misses(_roster(spark, sf)).select("line_no", "accession")


@book.query(f"WITH {_ROSTER} SELECT sample_id, accession FROM gsm WHERE regexp_matches(sample_id, '^D\\d{{2}}-\\d{{4}}')")
def roster_spatial(spark, sf):
    return backfill.spatial_part(backfill.roster_map(_roster(spark, sf))).select("sample_id", "accession")


_PATCH = f"""{_ROSTER},
seq AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'D.SEQ-' WHEN 1 THEN 'A.GEX-' ELSE 'D.SEQ-' END || o_orderkey AS uid,
  CASE WHEN o_orderkey % 17 = 0 THEN 'nothing' ELSE 'run_D' || (389000 + o_custkey) || '_1.fastq' END AS file,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSM' || (1000 + o_custkey) END AS link,
  CASE WHEN o_orderkey % 5 = 0 THEN 'GSM' || (1000 + o_custkey) END AS acc FROM orders),
patched AS (SELECT k, CASE WHEN uid NOT LIKE 'D.SEQ-%' THEN 'out_of_scope' WHEN NOT regexp_matches(file, 'D\\d+') THEN 'no_id' WHEN g.accession IS NULL THEN 'not_in_roster'
    ELSE 'patched' END AS state, g.accession AS got, link, acc FROM seq LEFT JOIN gsm g ON uid LIKE 'D.SEQ-%' AND regexp_extract(file, 'D\\d+') = g.sample_id),
cells AS (SELECT k, state, coalesce('https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=' || got, link) AS new_link, coalesce(got, acc) AS new_acc, link, acc FROM patched)"""


def _sequences(spark, sf):
    k = F.col("o_orderkey")
    g = (F.col("o_custkey") + 1000).cast("string")
    return r.table(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.when(k % 4 == 1, "A.GEX-").otherwise("D.SEQ-"), k.cast("string")).alias("uid"),
        F.when(k % 17 == 0, "nothing").otherwise(F.concat(F.lit("run_D"), (F.col("o_custkey") + 389000).cast("string"), F.lit("_1.fastq"))).alias("file"),
        F.when(k % 3 == 0, F.concat(F.lit(t.ACCESSION_URL + "GSM"), g)).alias("link_primarydata"),
        F.when(k % 5 == 0, F.concat(F.lit("GSM"), g)).alias("accession"))


def _patched(spark, sf):
    roster = backfill.roster_map(_roster(spark, sf))
    return backfill.patch_accessions(_sequences(spark, sf), roster, "D.SEQ", "file", t.BULK_ID)


@book.query(f"""WITH {_PATCH} SELECT k, state, new_link AS link_primarydata, new_acc AS accession,
  ((new_link IS DISTINCT FROM link)::INT + (new_acc IS DISTINCT FROM acc)::INT)::BIGINT AS changed FROM cells""")
def accession_patch(spark, sf):
    return _patched(spark, sf).select("k", "state", "link_primarydata", "accession", F.col("changed").cast("bigint").alias("changed"))


_SPATIAL = f"""{_ROSTER},
spots AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'D.SEQ-' ELSE 'A.SPTX-' END || o_orderkey AS uid,
  CASE WHEN o_orderkey % 11 = 0 THEN 'no spot' ELSE 'slide D22-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' left' END AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSM' || (1000 + o_custkey) END AS link FROM orders),
hits AS (SELECT k, uid, link, CASE WHEN starts_with(uid, 'A.SPTX-') THEN nullif(regexp_extract(name, 'D\\d{{2}}-\\d{{4}}'), '') END AS id FROM spots),
spatial AS (SELECT * FROM gsm WHERE regexp_matches(sample_id, '^D\\d{{2}}-\\d{{4}}'))"""


@book.query(f"""WITH {_SPATIAL} SELECT k, CASE WHEN NOT starts_with(uid, 'A.SPTX-') THEN 'out_of_scope' WHEN id IS NULL THEN 'no_id' WHEN accession IS NULL THEN 'not_in_roster'
  ELSE 'patched' END AS state, coalesce('https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=' || accession, link) AS link_primarydata
FROM hits LEFT JOIN spatial ON id = sample_id""")
def spatial_patch(spark, sf):
    """Links of spatial samples, from the part of the bulk roster that can stand in for a spatial one."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    rows = r.table(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.when(k % 3 == 0, "D.SEQ-").otherwise("A.SPTX-"), key).alias("uid"),
        F.when(k % 11 == 0, "no spot").otherwise(F.concat(F.lit("slide D22-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit(" left"))).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSM"), (F.col("o_custkey") + 1000).cast("string"))).alias("link_primarydata"))
    roster = backfill.spatial_part(backfill.roster_map(_roster(spark, sf)))
    return backfill.patch_accessions(rows, roster, "A.SPTX", "name", r"D\d{2}-\d{4}", accession_column=None).select("k", "state", "link_primarydata")


@book.query(f"""WITH {_PATCH} SELECT state, count(*) AS n_rows, sum((new_link IS DISTINCT FROM link)::INT + (new_acc IS DISTINCT FROM acc)::INT)::BIGINT AS n_changed
FROM cells GROUP BY 1""")
def accession_report(spark, sf):
    return backfill.patch_report(_patched(spark, sf))


@book.query("""SELECT o_orderkey % 4 = 1 AS in_scope, count(*) AS n_rows, sum(CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END)::BIGINT AS n_changed FROM orders GROUP BY 1""")
def constant_patch(spark, sf):
    done = backfill.patch_constant(_sequences(spark, sf), "A.GEX", "link_primarydata", t.ACCESSION_URL + "GSE1")
    return done.groupBy(t.has_type("uid", ["A.GEX"]).alias("in_scope")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("changed").alias("n_changed"))


# --- landed documents ------------------------------------------------------------------------------------------------

@book.query("""
SELECT p_brand AS sampletype, p_name AS type_name, CASE WHEN p_size % 2 = 0 THEN 'UID|Name|' || p_type ELSE 'UID' END AS required,
  'Notes' AS standard FROM part""")
def catalogue_parse(spark, sf):
    raw = r.table(spark, sf, "part").select(
        F.col("p_brand").alias("SampleType"), F.col("p_name").alias("Name"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("UID, Name,, "), "p_type")).otherwise("UID").alias("Required Metadata"),
        F.lit(" Notes ,").alias("Standard Metadata"))
    return parse_catalogue(raw).select(
        "sampletype", "type_name",
        F.array_join("required", "|").alias("required"), F.array_join("standard", "|").alias("standard"))


@book.query("SELECT event_id AS assay_id, event_type AS title FROM events WHERE event_type <> 'error' AND event_id % 7 > 0")
def assay_pages(spark, sf):
    k = F.col("event_id")
    record = F.struct(
        F.when(k % 7 > 0, k).cast("string").alias("id"),
        F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("title")).alias("attributes"))
    pages = r.table(spark, sf, "events").select(F.array(record).alias("data"))
    return parse_assay_pages(pages)


@book.query(r.with_sql(r.NODES_SQL, recursive=True) + """,
up(uid) AS (SELECT uid FROM small_nodes WHERE sampletype = 'ORD' AND (sample_id // 10) % 3 = 0
  UNION SELECT parent_uid FROM small_edges JOIN up ON child_uid = up.uid),
asked AS (SELECT uid FROM small_nodes WHERE sampletype = 'ORD' AND (sample_id // 10) % 3 = 0),
back AS (SELECT uid FROM small_nodes WHERE (sample_id // 10) % 5 > 0)
SELECT CASE WHEN uid IN (SELECT uid FROM asked) THEN CASE WHEN uid IN (SELECT uid FROM back) THEN 'ok' ELSE 'missing' END
  WHEN uid IN (SELECT uid FROM up) THEN 'parent' ELSE 'extra' END AS state, count(*) AS n
FROM (SELECT uid FROM asked UNION SELECT uid FROM back) GROUP BY 1""".replace(",\nup(uid)", ", up(uid)", 1))
def round_trip(spark, sf):
    nodes = r.nodes(spark, sf, lines=False)
    asked = nodes.where("sampletype = 'ORD' AND (sample_id div 10) % 3 = 0").select("uid")
    back = nodes.where("(sample_id div 10) % 5 > 0").select("uid")
    ancestors = lineage.closure(asked, lineage.lineage_edges(nodes), "up").select("uid")
    return diff.round_trip(asked, back, ancestors).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@book.query(r.with_sql(r.NODES_SQL, recursive=True) + """,
asked AS (SELECT uid FROM nodes WHERE sampletype IN ('ORD', 'D.LIN') AND uid LIKE '%7'),
up(uid) AS (SELECT uid FROM asked UNION SELECT parent_uid FROM edges JOIN up ON child_uid = up.uid),
back AS (SELECT uid FROM nodes WHERE uid NOT LIKE '%3')
SELECT CASE WHEN uid IN (SELECT uid FROM asked) THEN CASE WHEN uid IN (SELECT uid FROM back) THEN 'ok' ELSE 'missing' END
  WHEN uid IN (SELECT uid FROM up) THEN 'parent' ELSE 'extra' END AS state, count(*) AS n
FROM (SELECT uid FROM asked UNION SELECT uid FROM back) GROUP BY 1""".replace(",\nasked", ", asked", 1))
def round_trip_all(spark, sf):
    """A round trip of orders and lines over the whole registry."""
    nodes = r.nodes(spark, sf)
    asked = nodes.where("sampletype IN ('ORD', 'D.LIN') AND uid LIKE '%7'").select("uid")
    back = nodes.where("uid NOT LIKE '%3'").select("uid")
    ancestors = lineage.closure(asked, cut(lineage.lineage_edges(nodes)), "up").select("uid")
    return diff.round_trip(asked, back, ancestors).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
