"""Quality checks, parents, flat rows, assays and loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import PARENT_TYPES, PLACEHOLDER_MARKERS, SURPRISE_SENTINELS, local_table
from samplewright.operators import checks, flat, load, loadtable, ranking, resolve
from samplewright.plans import registry as r
from samplewright.plans.base import Book
from samplewright.session import scratch_path
from samplewright.sinks import writers

book = Book()
UPLOAD = (r.ORDER_UPLOAD_SQL,)
KNOWN = (r.NODES_SQL, r.ORDER_UPLOAD_SQL, r.LINE_UPLOAD_SQL, r.BASELINE_SQL)

# Parents cited by orders (column, else payload) and by lines, one row per citation.
_REFS = """
refs AS (
  SELECT row_n, uid, sampletype, trim(p) AS parent_uid FROM (
    SELECT row_n, uid, sampletype, unnest(string_split(coalesce(nullif(parent, ''), j_parent, ''), ';')) AS p FROM parsed
    UNION ALL SELECT row_n, uid, sampletype, unnest(string_split(parent, ';')) FROM line_upload)
  WHERE trim(p) <> '' AND NOT contains(p, '*** PLACEHOLDER') AND NOT contains(p, '***PLACEHOLDER')
),
known AS (
  SELECT uid, min(o) AS origin FROM (SELECT uid, 0 AS o FROM upload UNION ALL SELECT uid, 0 FROM line_upload
    UNION ALL SELECT uid, 1 FROM baseline) WHERE uid <> '' GROUP BY uid
)"""


def _rows(spark, sf):
    """Orders and line items as one prepared upload."""
    orders = checks.prepare(r.order_upload(spark, sf)).select("row_n", "uid", "sampletype", "parent", "attrs")
    lines = r.line_upload(spark, sf).select("row_n", "uid", "sampletype", "parent", F.lit(None).cast(t.PAYLOAD_TYPE).alias("attrs"))
    return orders.union(lines)


@book.query(r.with_sql(*KNOWN, _REFS) + """
SELECT CASE origin WHEN 0 THEN 'intra' WHEN 1 THEN 'baseline' ELSE 'missing' END AS status, count(*) AS n_refs
FROM refs LEFT JOIN known ON parent_uid = known.uid GROUP BY 1""")
def parent_resolution(spark, sf):
    return resolve.parent_tally(_rows(spark, sf), r.baseline(spark, sf))


@book.query(r.with_sql(*KNOWN, _REFS) + """
SELECT refs.*, CASE origin WHEN 0 THEN 'intra' WHEN 1 THEN 'baseline' ELSE 'missing' END AS status
FROM refs LEFT JOIN known ON parent_uid = known.uid""")
def parent_status_rows(spark, sf):
    return resolve.resolve_parents(_rows(spark, sf), r.baseline(spark, sf))


@book.query(r.with_sql(*KNOWN, _REFS) + "SELECT refs.* FROM refs ANTI JOIN known ON parent_uid = known.uid")
def missing_parent_rows(spark, sf):
    return resolve.missing_parents(_rows(spark, sf), r.baseline(spark, sf))


@book.query(r.with_sql(*UPLOAD) + """
SELECT count(*) FILTER (sampletype NOT IN ('REG', 'PRT')) AS nonroot, count(*) FILTER (sampletype IN ('REG', 'PRT')) AS root
FROM parsed WHERE trim(coalesce(nullif(parent, ''), j_parent, '')) = ''""")
def blank_parent_tally(spark, sf):
    rows = checks.prepare(r.order_upload(spark, sf)).where(t.parent_cell("parent", "attrs").isNull())
    root = F.col("sampletype").isin(*r.ROOTS)
    return rows.agg(F.count_if(~root).alias("nonroot"), F.count_if(root).alias("root"))


@book.query(f"""
SELECT 'X.' || p_size % 3 || '-{r.DATE}{r.LAB}-' || p_partkey AS uid, 'X.' || p_size % 3 AS sampletype, p_partkey AS n FROM part""")
def uid_mint(spark, sf):
    kind = F.concat(F.lit("X."), (F.col("p_size") % 3).cast("string"))
    return r.table(spark, sf, "part").select(
        t.mint_uid(kind, r.LAB, r.DATE, F.col("p_partkey")).alias("uid"), kind.alias("sampletype"), F.col("p_partkey").alias("n")
    ).withColumn("sampletype", t.uid_type("uid"))


@book.query(f"""
WITH rows AS (
  SELECT p_partkey AS k, CASE WHEN p_size < 20 THEN 'BIG' ELSE 'S.' || p_size % 3 END AS sampletype,
    CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size < 20 THEN 'BIG' ELSE 'S.' || p_size % 3 END || '-{r.DATE}{r.LAB}-' || p_partkey
         ELSE '' END AS uid FROM part),
top AS (SELECT sampletype, max(k) AS top FROM rows WHERE uid <> '' GROUP BY 1)
SELECT k, sampletype, CASE WHEN uid <> '' THEN uid ELSE sampletype || '-{r.DATE}{r.LAB}-' ||
  (coalesce(top, 0) + row_number() OVER (PARTITION BY sampletype, uid = '' ORDER BY k)) END AS uid, uid = '' AS minted
FROM rows LEFT JOIN top USING (sampletype)""")
def uid_autogenerate(spark, sf):
    kind = F.when(F.col("p_size") < 20, "BIG").otherwise(F.concat(F.lit("S."), (F.col("p_size") % 3).cast("string")))
    rows = r.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), kind.alias("sampletype"))
    uid = F.when(F.col("k") % 4 == 0, t.mint_uid(F.col("sampletype"), r.LAB, r.DATE, F.col("k"))).otherwise("")
    rows = rows.withColumn("uid", uid)
    return flat.mint_blank_uids(rows, rows.where("1 = 0"), r.LAB, r.DATE, ["k"])


@book.query(r.with_sql(r.NODES_SQL) + "SELECT split_part(uid, '-', 1) AS sampletype, count(DISTINCT uid) AS n_uids FROM nodes GROUP BY 1")
def uid_type_counts(spark, sf):
    return flat.count_by_type(flat.retrieve_uids(r.nodes(spark, sf), None))


@book.query(r.with_sql(r.NODES_SQL) + """
SELECT DISTINCT uid FROM nodes WHERE split_part(uid, '-', 1) NOT IN ('MUS','TIS','DNA','RNA','PAT','PAV','CHM','CEL','CUS')""")
def retrieve_list(spark, sf):
    return flat.retrieve_uids(r.nodes(spark, sf), [*PARENT_TYPES, "CUS"]).orderBy("uid")


@book.query(r.with_sql(r.LINE_UPLOAD_SQL) + """
SELECT uid, row_n, tie, first_tie, 'D.LIN' AS first_sampletype FROM (
  SELECT *, row_number() OVER w AS rn, first_value(tie) OVER w AS first_tie FROM line_upload
  WINDOW w AS (PARTITION BY uid ORDER BY row_n, tie)) WHERE rn > 1""")
def dup_uid(spark, sf):
    rows = r.line_upload(spark, sf)
    return checks.duplicate_uids(rows, ["row_n", "tie"]).select("uid", "row_n", "tie", "first_tie", "first_sampletype")


@book.query(r.with_sql(*UPLOAD) + """
SELECT sampletype, name, row_n, first_row_n FROM (
  SELECT sampletype, j_name AS name, row_n, row_number() OVER w AS rn, first_value(row_n) OVER w AS first_row_n FROM parsed
  WHERE j_name <> '' WINDOW w AS (PARTITION BY sampletype, j_name ORDER BY row_n)) WHERE rn > 1""")
def dup_name(spark, sf):
    rows = checks.prepare(r.order_upload(spark, sf))
    return checks.duplicate_names(rows, ROW_ORDER).select("sampletype", "name", "row_n", "first_row_n")


@book.query(r.with_sql(*UPLOAD, r.TYPES_SQL) + """
SELECT row_n, uid, sampletype FROM upload ANTI JOIN types USING (sampletype)""")
def unknown_type(spark, sf):
    return checks.unknown_types(r.order_upload(spark, sf), r.catalogue(spark)).select("row_n", "uid", "sampletype")


_ISSUES = """
gaps AS (SELECT row_n, uid, sampletype, unnest(['Name', 'Status', 'Clerk']) AS field, j_name, j_status, j_clerk
         FROM parsed WHERE sampletype = 'ORD'),
row_issues AS (
  SELECT 'missing_uid' AS code, 2 AS severity, row_n, uid, sampletype FROM parsed WHERE uid = ''
  UNION ALL SELECT 'unknown_sampletype', 2, row_n, uid, sampletype FROM parsed WHERE sampletype = 'ORX'
  UNION ALL SELECT 'bad_json', 2, row_n, uid, sampletype FROM parsed WHERE json_metadata <> '' AND NOT coalesce(ok, false)
  UNION ALL SELECT 'missing_json_metadata', 2, row_n, uid, sampletype FROM parsed WHERE json_metadata = ''
  UNION ALL SELECT 'blank_parent_nonroot', 2, row_n, uid, sampletype FROM parsed WHERE coalesce(nullif(parent, ''), j_parent, '') = ''
  UNION ALL SELECT 'missing_required', 0, row_n, uid, sampletype FROM gaps
    WHERE coalesce(CASE field WHEN 'Name' THEN j_name WHEN 'Status' THEN j_status ELSE j_clerk END, '') = ''
),
dup_uids AS (SELECT row_n, uid, sampletype FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY row_n) AS rn FROM parsed WHERE uid <> '') WHERE rn > 1),
dup_names AS (SELECT row_n, uid, sampletype FROM (
  SELECT *, row_number() OVER (PARTITION BY sampletype, j_name ORDER BY row_n) AS rn FROM parsed WHERE j_name <> '') WHERE rn > 1),
lost AS (
  SELECT row_n, uid, sampletype FROM (
    SELECT row_n, uid, sampletype, trim(unnest(string_split(coalesce(nullif(parent, ''), j_parent, ''), ';'))) AS p FROM parsed)
  WHERE p <> '' AND NOT contains(p, '*** PLACEHOLDER') AND p NOT IN (SELECT uid FROM upload) AND p NOT IN (SELECT uid FROM baseline)
),
issues AS (
  SELECT * FROM row_issues
  UNION ALL SELECT 'duplicate_uid', 2, * FROM dup_uids UNION ALL SELECT 'duplicate_name', 2, * FROM dup_names
  UNION ALL SELECT 'parent_uid_not_found', 2, * FROM lost
)"""
#: Row numbers of the order upload run through all its files.
ROW_ORDER = ["row_n"]
ISSUES = (r.NODES_SQL, r.ORDER_UPLOAD_SQL, r.BASELINE_SQL, _ISSUES)


def _prepared(spark, sf):
    return checks.prepare(r.order_upload(spark, sf))


def _issues(spark, sf):
    return checks.all_issues(_prepared(spark, sf), r.catalogue(spark), r.baseline(spark, sf), r.ROOTS, ROW_ORDER)


@book.query(r.with_sql(*ISSUES) + "SELECT code, severity, row_n, uid, sampletype FROM row_issues")
def row_checks(spark, sf):
    return checks.row_issues(_prepared(spark, sf), r.catalogue(spark), r.ROOTS).drop("detail", "file")


@book.query(r.with_sql(*ISSUES) + """
SELECT row_n, uid, code FROM row_issues WHERE code IN ('bad_json', 'missing_json_metadata')""")
def bad_json(spark, sf):
    found = checks.row_issues(_prepared(spark, sf), r.catalogue(spark), r.ROOTS)
    return found.where(F.col("code").isin("bad_json", "missing_json_metadata")).select("row_n", "uid", "code")


@book.query(r.with_sql(*ISSUES) + """
SELECT sampletype, field, count(*) AS n_blank FROM gaps
WHERE coalesce(CASE field WHEN 'Name' THEN j_name WHEN 'Status' THEN j_status ELSE j_clerk END, '') = '' GROUP BY 1, 2""")
def required_gaps(spark, sf):
    return checks.required_gaps(checks.row_issues(_prepared(spark, sf), r.catalogue(spark), r.ROOTS))


@book.query(r.with_sql(*ISSUES) + """
SELECT code, count(*) AS n_issues, code <> 'missing_required' AS is_blocker FROM issues GROUP BY code""")
def issue_rollup(spark, sf):
    return checks.issue_rollup(_issues(spark, sf))


@book.query(r.with_sql(*ISSUES) + """
SELECT code, row_n, uid, rank FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_n, uid) AS rank
  FROM row_issues WHERE code <> 'missing_required') WHERE rank <= 10""")
def issue_examples(spark, sf):
    found = checks.row_issues(_prepared(spark, sf), r.catalogue(spark), r.ROOTS).where("code <> 'missing_required'")
    return checks.issue_examples(found).select("code", "row_n", "uid", F.col("rank").cast("bigint").alias("rank"))


@book.query(r.with_sql(*ISSUES) + """
SELECT code, row_n, uid, rank FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_n, uid) AS rank
  FROM issues WHERE code <> 'missing_required') WHERE rank <= 10""")
def blocker_examples(spark, sf):
    """The first findings of all blocker codes; `issue_examples` has those of the row checks only, as its SQL says."""
    found = _issues(spark, sf).where("code <> 'missing_required'")
    return checks.issue_examples(found).select("code", "row_n", "uid", F.col("rank").cast("bigint").alias("rank"))


_EXPECTED = [("ORD", 15000), ("ORX", 5), ("MDL", 1)]
_COUNTS = r.values_sql("expected", ["sampletype", "expected"], _EXPECTED) + """,
actual AS (SELECT sampletype, count(*) AS actual FROM upload GROUP BY 1),
counts AS (SELECT coalesce(a.sampletype, e.sampletype) AS sampletype, coalesce(actual, 0) AS actual, expected::BIGINT AS expected,
  CASE WHEN expected IS NULL THEN 'unexpected' WHEN expected = coalesce(actual, 0) THEN 'ok' ELSE 'mismatch' END AS status
  FROM actual a FULL JOIN expected e ON a.sampletype = e.sampletype)"""


def _counts(spark, sf):
    import pyarrow as pa

    expected = local_table(spark, {"sampletype": None, "expected": pa.int64()}, _EXPECTED)
    return checks.type_counts(r.order_upload(spark, sf), expected)


@book.query(r.with_sql(*UPLOAD, _COUNTS) + """
SELECT * FROM counts UNION ALL SELECT 'TOTAL', sum(actual)::BIGINT, sum(expected)::BIGINT,
  CASE WHEN sum(actual) = sum(expected) THEN 'ok' ELSE 'mismatch' END FROM counts""")
def type_counts_vs_expected(spark, sf):
    return _counts(spark, sf)


@book.query(r.with_sql(*ISSUES, _COUNTS) + """
SELECT n AS n_blockers, m AS counts_ok, CASE WHEN n > 0 THEN 'blockers' WHEN m THEN 'pass' ELSE 'count_mismatch' END AS verdict,
  CASE WHEN n > 0 THEN 1 ELSE 0 END AS exit_code
FROM (SELECT (SELECT count(*) FROM issues WHERE code <> 'missing_required') AS n, (SELECT bool_and(status = 'ok') FROM counts) AS m)""")
def verdict(spark, sf):
    return checks.verdict(_issues(spark, sf), _counts(spark, sf))


def _marker_sql(m):
    return f"SELECT '{m}' AS marker, coalesce(sum((length(json_metadata) - length(replace(json_metadata, '{m}', ''))) // {len(m)}), 0)::BIGINT AS n FROM upload"


def _sentinel_sql(s):
    return f"SELECT 'surprise:{s}', count(*) FILTER (contains(json_metadata, '{s}')) FROM upload"


@book.query(r.with_sql(*UPLOAD) + " UNION ALL ".join(
    [_marker_sql(m) for m in PLACEHOLDER_MARKERS] + [_sentinel_sql(s) for s in SURPRISE_SENTINELS]))
def marker_counts(spark, sf):
    return checks.marker_counts(r.order_upload(spark, sf))


@book.query(r.with_sql(*ISSUES) + """,
worst AS (SELECT row_n, max(severity) AS s FROM issues GROUP BY 1),
level AS (SELECT arm, greatest(coalesce(s, 0),
    CASE WHEN coalesce(j_file, '') = '' THEN 2 WHEN contains(j_file, '*** PLACEHOLDER') THEN 1 ELSE 0 END,
    CASE WHEN coalesce(j_link, '') = '' OR coalesce(j_sum, '') = '' THEN 1 ELSE 0 END) AS l
  FROM parsed LEFT JOIN worst USING (row_n))
SELECT arm, CASE l WHEN 2 THEN 'HARD_REJECT' WHEN 1 THEN 'SOFT_FLAG' ELSE 'CLEAN' END AS disposition, count(*) AS n_rows
FROM level GROUP BY 1, 2""".replace(",\nworst", ", worst", 1))
def disposition(spark, sf):
    return checks.dispositions(_prepared(spark, sf), _issues(spark, sf))


_MARKED = lambda *cells: " OR ".join(f"contains(coalesce({c}, ''), '{m}')" for c in cells for m in PLACEHOLDER_MARKERS)

_DISPOSED = f"""
found AS (
  SELECT row_n, severity AS s, CASE code WHEN 'parent_uid_not_found' THEN 'dangling Parent UID' WHEN 'unknown_sampletype' THEN 'pending-schema type' ELSE code END AS reason
  FROM issues WHERE severity > 0
  UNION SELECT row_n, 2, 'missing File_PrimaryData' FROM parsed WHERE coalesce(trim(j_file), '') = ''
  UNION SELECT row_n, 1, 'PLACEHOLDER marker in File_PrimaryData' FROM parsed WHERE {_MARKED('j_file')}
  UNION SELECT row_n, 1, 'PLACEHOLDER marker in metadata' FROM parsed WHERE {_MARKED('j_uid', 'j_name', 'j_parent', 'j_status', 'j_clerk', 'j_notes', 'j_link', 'j_sum', 'j_subject')}
  UNION SELECT row_n, 1, 'Link_PrimaryData blank' FROM parsed WHERE coalesce(trim(j_link), '') = ''
  UNION SELECT row_n, 1, 'Checksum_PrimaryData blank' FROM parsed WHERE coalesce(trim(j_sum), '') = ''
  UNION SELECT row_n, 1, 'assay_id unresolved' FROM (SELECT row_n, trim(unnest(string_split(assay_titles, ';'))) AS title FROM parsed)
  WHERE title <> '' AND title NOT IN (SELECT title FROM cache) AND title NOT IN (SELECT cited FROM synonyms JOIN cache ON canonical = cache.title)),
level AS (SELECT row_n, max(s) AS s FROM found GROUP BY 1),
disposed AS (SELECT arm, file, p.row_n, uid, CASE coalesce(l.s, 0) WHEN 2 THEN 'HARD_REJECT' WHEN 1 THEN 'SOFT_FLAG' ELSE 'CLEAN' END AS disposition,
    (SELECT string_agg(reason, '; ' ORDER BY reason) FROM found f WHERE f.row_n = p.row_n AND f.s = l.s) AS reasons
  FROM parsed p LEFT JOIN level l USING (row_n))"""
WHY = (*ISSUES, r.ASSAYS_SQL, r.SYNONYMS_SQL, _DISPOSED)


def _disposed(spark, sf):
    return checks.disposition_rows(_prepared(spark, sf), _issues(spark, sf), r.assay_cache(spark), r.synonyms(spark))


@book.query(r.with_sql(*WHY) + "SELECT arm, file, row_n, uid, disposition, coalesce(reasons, '') AS reasons FROM disposed")
def disposition_rows(spark, sf):
    return _disposed(spark, sf).withColumn("reasons", F.array_join("reasons", "; "))


@book.query(r.with_sql(*WHY) + """
SELECT arm, disposition, reason, count(*) AS n_rows FROM (SELECT arm, disposition, unnest(string_split(reasons, '; ')) AS reason FROM disposed WHERE reasons IS NOT NULL)
GROUP BY ALL""")
def disposition_reasons(spark, sf):
    return checks.disposition_reasons(_disposed(spark, sf))


@book.query(r.with_sql(*UPLOAD) + """
SELECT row_n, CASE WHEN coalesce(trim(j_file), '') = '' THEN 2 WHEN contains(j_file, '*** PLACEHOLDER') THEN 1 ELSE 0 END AS file_flag
FROM parsed""")
def file_column_flags(spark, sf):
    return checks.file_column_flags(_prepared(spark, sf)).select("row_n", "file_flag")


@book.query(r.with_sql(*UPLOAD) + """
SELECT 'VALIDATION_ATTRIBUTE_NAME' AS type, '''' || field || ''' is not a defined attribute for SampleType ''' || sampletype || '''' AS message,
  count(*) AS n_rows
FROM (SELECT sampletype, unnest(json_keys(json_metadata)) AS field FROM upload WHERE ok)
WHERE sampletype = 'ORX' OR field = 'Subjet ID' GROUP BY sampletype, field""")
def attribute_names(spark, sf):
    return checks.attribute_names(_prepared(spark, sf), r.catalogue_fields(spark))


_VIOLATIONS = """
cells AS (SELECT file, 'Status' AS field, j_status AS value FROM parsed UNION ALL SELECT file, 'Clerk', j_clerk FROM parsed),
bad AS (SELECT file, field, value, count(*) AS n_rows FROM cells WHERE value <> ''
  AND NOT EXISTS (SELECT 1 FROM ontology o WHERE o.field = cells.field AND o.value = cells.value) GROUP BY ALL)"""


@book.query(r.with_sql(*UPLOAD, r.ONTOLOGY_SQL, _VIOLATIONS) + "SELECT * FROM bad")
def ontology_violations(spark, sf):
    return checks.ontology_violations(_prepared(spark, sf), r.ontology(spark)).select("file", "field", "value", "n_rows")


@book.query(r.with_sql(*UPLOAD, r.ONTOLOGY_SQL, _VIOLATIONS) + """
SELECT file, (SELECT count(*) FROM bad b WHERE b.file = f.file) AS n_bad,
  EXISTS (SELECT 1 FROM bad b WHERE b.file = f.file) AS rejected FROM (SELECT DISTINCT file FROM upload) f""")
def rejected_files(spark, sf):
    return checks.rejected_files(_prepared(spark, sf), r.ontology(spark))


@book.query(r.with_sql(*UPLOAD) + """,
bad AS (SELECT DISTINCT file, sampletype, field FROM (SELECT file, sampletype, unnest(json_keys(json_metadata)) AS field FROM upload WHERE ok)
  WHERE sampletype = 'ORX' OR field = 'Subjet ID')
SELECT file, count(field) AS n_errors, count(field) = 0 AS valid FROM (SELECT DISTINCT file FROM upload) LEFT JOIN bad USING (file)
GROUP BY file""".replace(",\nbad", ", bad", 1))
def structure_check(spark, sf):
    return checks.structure_check(_prepared(spark, sf), r.catalogue_fields(spark))


@book.query(r.with_sql(r.NODES_SQL, r.ORDER_UPLOAD_SQL) + """
SELECT row_n, u.uid, u.name FROM upload u SEMI JOIN small_nodes n ON u.sampletype = n.sampletype AND u.name = n.name""")
def names_in_use(spark, sf):
    taken = r.nodes(spark, sf, lines=False)
    return checks.names_in_use(r.order_upload(spark, sf), taken).select("row_n", "uid", "name")


@book.query("""
SELECT field, value, count(*) AS n_rows FROM (
  SELECT '*single or paired-end' AS field, CASE l_linenumber % 3 WHEN 0 THEN 'paired' WHEN 1 THEN 'paired-end' ELSE 'single' END AS value FROM lineitem
  UNION ALL SELECT '*instrument model', CASE l_returnflag WHEN 'A' THEN 'Illumina NextSeq 500' WHEN 'R' THEN 'NextSeq 500'
    ELSE 'illumina nextseq 500' END FROM lineitem)
WHERE value NOT IN ('single', 'paired-end', 'Illumina NextSeq 500') GROUP BY 1, 2""")
def literal_check(spark, sf):
    from samplewright.model import DEPOSIT_LITERALS

    end = F.when(F.col("l_linenumber") % 3 == 0, "paired").when(F.col("l_linenumber") % 3 == 1, "paired-end").otherwise("single")
    model = F.when(F.col("l_returnflag") == "A", "Illumina NextSeq 500").when(F.col("l_returnflag") == "R", "NextSeq 500").otherwise("illumina nextseq 500")
    rows = r.table(spark, sf, "lineitem").select(end.alias("*single or paired-end"), model.alias("*instrument model"))
    return checks.literal_violations(rows, DEPOSIT_LITERALS)


@book.query(r.with_sql(r.NODES_SQL, r.ALLOWED_SQL) + """
SELECT parent_type, child_type, count(*) AS n_edges FROM (
  SELECT split_part(parent_uid, '-', 1) AS parent_type, split_part(child_uid, '-', 1) AS child_type FROM edges)
WHERE (parent_type, child_type) NOT IN (SELECT (parent_type, child_type) FROM allowed) GROUP BY 1, 2""")
def edge_violations(spark, sf):
    from samplewright.operators.lineage import lineage_edges

    edges = lineage_edges(r.nodes(spark, sf)).distinct().select(
        t.uid_type("parent_uid").alias("parent_type"), t.uid_type("child_uid").alias("child_type"))
    return checks.edge_violations(edges, r.allowed_edges(spark))


@book.query(r.with_sql(*ISSUES) + """
SELECT code AS type, sampletype AS message, count(*) AS n_errors, count(DISTINCT row_n) AS n_rows, count(DISTINCT nullif(uid, '')) AS n_uids
FROM row_issues GROUP BY 1, 2""")
def error_groups(spark, sf):
    found = checks.row_issues(_prepared(spark, sf), r.catalogue(spark), r.ROOTS)
    return checks.error_groups(found.select(F.col("code").alias("type"), F.col("sampletype").alias("message"), "row_n", "uid"))


@book.query(r.with_sql(*ISSUES) + "SELECT DISTINCT code AS type, sampletype AS message, row_n, uid FROM row_issues")
def error_members(spark, sf):
    found = checks.row_issues(_prepared(spark, sf), r.catalogue(spark), r.ROOTS)
    return checks.error_members(found.select(F.col("code").alias("type"), F.col("sampletype").alias("message"), "row_n", "uid"))


# --- flat rows and assays --------------------------------------------------------------------------------------------

_TITLE = "CASE o_orderkey % 4 WHEN 0 THEN 'Cell Culture' WHEN 1 THEN 'RNA extraction' WHEN 2 THEN 'Unlisted Assay' END"
_RESOLVED = r.ASSAYS_SQL + ",\n" + r.SYNONYMS_SQL + """,
resolved AS (SELECT t.title, CASE WHEN c.assay_id IS NOT NULL THEN t.title WHEN c2.assay_id IS NOT NULL THEN s.canonical
    ELSE coalesce(t.title, '') END AS resolved_title, coalesce(c.assay_id, c2.assay_id) AS assay_id,
    CASE WHEN coalesce(t.title, '') = '' THEN 'blank' WHEN c.assay_id IS NOT NULL THEN 'direct'
         WHEN c2.assay_id IS NOT NULL THEN 'synonym' ELSE 'unresolved' END AS how
  FROM titles t LEFT JOIN cache c ON t.title = c.title LEFT JOIN synonyms s ON t.title = s.cited
  LEFT JOIN cache c2 ON s.canonical = c2.title)"""


def _records(spark, sf):
    title = F.when(F.col("o_orderkey") % 4 == 0, "Cell Culture").when(F.col("o_orderkey") % 4 == 1, "RNA extraction").when(
        F.col("o_orderkey") % 4 == 2, "Unlisted Assay")
    notes = F.concat_ws(" ", F.lit("status"), "o_orderstatus", F.repeat("o_orderpriority", (F.col("o_orderkey") % 12).cast("int")))
    attrs = F.create_map(
        F.lit("UID"), r._uid("ORD", "o_orderkey"), F.lit("Name"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
        F.lit("Parent"), r._uid("CUS", "o_custkey"), F.lit("Notes"), F.when(F.col("o_orderkey") % 9 > 0, notes), F.lit("Empty"), F.lit(""))
    return r.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit("ORD").alias("sampletype"), title.alias("parent_assay"), attrs.alias("attrs"))


@book.query(f"WITH titles AS (SELECT DISTINCT {_TITLE} AS title FROM orders),\n{_RESOLVED}" + f"""
SELECT k, uid, 'ORD' AS sampletype, name, parent, CASE WHEN length(notes) > 80 THEN left(notes, 80) || '…' ELSE notes END AS notes_summary,
  resolved_title AS assay_titles, coalesce(assay_id::VARCHAR, '') AS assay_ids,
  '{{"UID":"' || uid || '","Name":"' || name || '","Parent":"' || parent || CASE WHEN notes <> '' THEN '","Notes":"' || notes ELSE '' END || '"}}' AS json_metadata
FROM (SELECT o_orderkey AS k, {r._U('ORD', 'o_orderkey')} AS uid, 'order ' || o_orderkey AS name, {r._U('CUS', 'o_custkey')} AS parent,
  CASE WHEN o_orderkey % 9 > 0 THEN 'status ' || o_orderstatus || ' ' || repeat(o_orderpriority, o_orderkey % 12) ELSE '' END AS notes,
  {_TITLE} AS title FROM orders) o JOIN resolved ON o.title IS NOT DISTINCT FROM resolved.title""")
def flat_rows(spark, sf):
    return flat.flat_rows(_records(spark, sf), r.assay_cache(spark), r.synonyms(spark))


@book.query(f"WITH titles AS (SELECT o_orderkey AS k, {_TITLE} AS title FROM orders),\n" + _RESOLVED.replace("SELECT t.title,", "SELECT t.k, t.title,", 1)
            + " SELECT k, title, resolved_title, assay_id, how FROM resolved")
def assay_resolution(spark, sf):
    titles = _records(spark, sf).select("k", F.col("parent_assay").alias("title"))
    return resolve.resolve_titles(titles, r.assay_cache(spark), r.synonyms(spark))


@book.query(f"WITH titles AS (SELECT DISTINCT {_TITLE} AS title FROM orders),\n{_RESOLVED} SELECT how, count(*) AS n_titles FROM resolved WHERE how <> 'blank' GROUP BY 1")
def assay_coverage(spark, sf):
    titles = _records(spark, sf).select(F.col("parent_assay").alias("title"))
    return resolve.assay_coverage(titles, r.assay_cache(spark), r.synonyms(spark))


@book.query(r.with_sql(*UPLOAD, r.ASSAYS_SQL) + """
SELECT DISTINCT title FROM (SELECT trim(unnest(string_split(assay_titles, ';'))) AS title FROM upload) WHERE title NOT IN (SELECT title FROM cache)""")
def uncached_titles(spark, sf):
    return resolve.uncached_titles(r.order_upload(spark, sf), r.assay_cache(spark))


def _assays(spark, sf):
    return r.table(spark, sf, "part").select(F.col("p_partkey").alias("assay_id"), F.col("p_name").alias("title"))


def _project(spark, sf):
    return r.table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("assay_id"))


_LINKED = "SELECT DISTINCT p_name AS title, p_partkey AS assay_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"


@book.query(f"SELECT title, min(assay_id) AS assay_id, count(*) AS n_ids FROM ({_LINKED}) GROUP BY title")
def assay_min_id(spark, sf):
    return resolve.lowest_ids(_assays(spark, sf), _project(spark, sf))


@book.query(f"SELECT title, assay_id, n_ids FROM (SELECT *, count(*) OVER (PARTITION BY title) AS n_ids FROM ({_LINKED})) WHERE n_ids > 1")
def assay_shared_titles(spark, sf):
    return resolve.shared_titles(_assays(spark, sf), _project(spark, sf))


_VERSIONED = """
versioned AS (SELECT o_orderkey AS k, 'T' || o_orderkey % 6 || CASE WHEN o_orderkey % 6 IN (1, 3, 5) AND o_orderkey % 4 = 1 THEN '-upload-new.xlsx'
  ELSE '-upload.xlsx' END AS file FROM orders)"""


def _versioned(spark, sf):
    k = F.col("o_orderkey")
    new = (k % 6).isin(1, 3, 5) & (k % 4 == 1)
    file = F.concat(F.lit("T"), (k % 6).cast("string"), F.when(new, "-upload-new.xlsx").otherwise("-upload.xlsx"))
    return r.table(spark, sf, "orders").select(k.alias("k"), file.alias("file"))


@book.query(f"WITH {_VERSIONED}" + """
SELECT k, file, left(file, 2) AS base FROM versioned v
WHERE contains(file, '-new') OR NOT EXISTS (SELECT 1 FROM versioned n WHERE contains(n.file, '-new') AND left(n.file, 2) = left(v.file, 2))""")
def version_preference(spark, sf):
    return flat.preferred_uploads(_versioned(spark, sf)).select("k", "file", "base")


@book.query(f"WITH {_VERSIONED} SELECT left(file, 2) AS arm, count(*) AS n_rows, count(DISTINCT file) AS n_files FROM versioned GROUP BY 1")
def arm_counts(spark, sf):
    return flat.arm_counts(_versioned(spark, sf).withColumn("arm", F.left("file", F.lit(2))))


@book.query(r.with_sql(*UPLOAD, r.TYPES_SQL) + """
SELECT CASE WHEN sampletype IN (SELECT sampletype FROM types) THEN 'upload' ELSE 'pending' END AS target, count(*) AS n_rows FROM upload GROUP BY 1""")
def routed_rows(spark, sf):
    up, pending = flat.route_pending(r.order_upload(spark, sf), r.catalogue(spark))
    both = up.select(F.lit("upload").alias("target")).union(pending.select(F.lit("pending").alias("target")))
    return both.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"))


@book.query(r.with_sql(*UPLOAD) + """
SELECT row_n, j_uid AS "UID", coalesce(j_name, '') AS "Name", coalesce(j_status, '') AS "Status", coalesce(j_clerk, '') AS "Clerk",
  coalesce(j_parent, '') AS "Parent", coalesce(j_notes, '') AS "Notes", coalesce(j_file, '') AS "File_PrimaryData",
  coalesce(j_link, '') AS "Link_PrimaryData", coalesce(j_sum, '') AS "Checksum_PrimaryData", coalesce(j_subject, '') AS "Subjet ID"
FROM parsed WHERE ok AND sampletype = 'ORD'""")
def template_samples(spark, sf):
    rows = _prepared(spark, sf).where("attrs IS NOT NULL")
    empty = local_table(spark, {"pos": None, "title": None, "field": None, "value": None}, [])
    return flat.four_tables("ORD", rows, r.catalogue(spark), empty, empty)["samples"]


_FIELDS = ["UID", "Name", "Status", "Clerk", "Parent", "Notes", "File_PrimaryData", "Link_PrimaryData", "Checksum_PrimaryData", "Subjet ID"]


@book.query(r.with_sql(*UPLOAD, r.ASSAYS_SQL, r.ONTOLOGY_SQL, r.values_sql("fields", ["pos", "field"], list(enumerate(_FIELDS)))) + """
SELECT 'instructions' AS sheet, field AS a, 'ORD::' || field AS b, 'Text' AS c, '' AS d, (SELECT count(*) FROM parsed WHERE ok AND sampletype = 'ORD') AS n_samples FROM fields
UNION ALL SELECT 'assay', 'ORD', '', title, 'child', (SELECT count(*) FROM parsed WHERE ok AND sampletype = 'ORD') FROM cache
UNION ALL SELECT 'ontology', field, value, '', '', (SELECT count(*) FROM parsed WHERE ok AND sampletype = 'ORD') FROM ontology""")
def template_tables(spark, sf):
    """All four tables of a template, written and read back; the samples are counted."""
    rows = _prepared(spark, sf).where("attrs IS NOT NULL")
    titles = r.assay_cache(spark).select(F.col("assay_id").alias("pos"), "title")
    made = flat.four_tables("ORD", rows, r.catalogue(spark), titles, r.ontology(spark).withColumn("pos", F.lit(0)))
    path = writers.write_four_tables(made, "ORD", scratch_path(spark, "template"))
    back = {name: spark.read.csv(f"{path}/{name}", header=True, escape='"', multiLine=True) for name in made}
    n = F.lit(back["samples"].count()).cast("bigint").alias("n_samples")
    cell = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    named = {"instructions": ["Field", "Database Field", "Field Type", "Ontology"], "assay": ["SampleType", "AssayType", "Assay", "Direction"],
             "ontology": ["Field", "Value", None, None]}
    parts = [back[sheet].select(F.lit(sheet).alias("sheet"), *[cell(c).alias(x) for x, c in zip("abcd", cols, strict=True)]) for sheet, cols in named.items()]
    return parts[0].union(parts[1]).union(parts[2]).select("*", n)


# --- identifiers, marks, rules ---------------------------------------------------------------------------------------

_ASKED = """
asked AS (SELECT CASE WHEN event_id % 3 = 0 THEN (event_id * 10 + 6)::VARCHAR WHEN event_id % 3 = 1 THEN 'ORD-240101TPC-' || event_id * 2
  ELSE 'NOPE-' || event_id END AS identifier FROM events)"""


def _asked(spark, sf):
    k = F.col("event_id")
    ident = F.when(k % 3 == 0, (k * 10 + 6).cast("string")).when(k % 3 == 1, t.mint_uid("ORD", r.LAB, r.DATE, k * 2)).otherwise(
        F.concat(F.lit("NOPE-"), k.cast("string")))
    return r.table(spark, sf, "events").select(ident.alias("identifier"))


@book.query(r.with_sql(r.NODES_SQL, _ASKED) + """
SELECT identifier, sample_id, uid FROM asked LEFT JOIN small_nodes ON identifier = uid OR identifier = sample_id::VARCHAR""")
def mixed_identifiers(spark, sf):
    return resolve.resolve_identifiers(_asked(spark, sf), r.nodes(spark, sf, lines=False).select("sample_id", "uid"))


@book.query(r.with_sql(r.NODES_SQL, r.ORDER_UPLOAD_SQL) + """
SELECT row_n, uid, CASE WHEN uid IN (SELECT uid FROM small_nodes WHERE sample_id % 3 = 0) THEN '[EXIST]' ELSE '[NEW]' END AS mark FROM upload""")
def existing_marks(spark, sf):
    master = r.nodes(spark, sf, lines=False).where("sample_id % 3 = 0")
    return resolve.mark_existing(r.order_upload(spark, sf).select("row_n", "uid"), master)


@book.query(r.with_sql(r.NODES_SQL, _ASKED) + """,
wanted AS (SELECT identifier FROM asked UNION ALL SELECT uid FROM nodes WHERE sampletype = 'D.LIN')
SELECT identifier, n.sample_id, n.uid FROM wanted JOIN nodes n ON identifier = n.uid
UNION ALL SELECT identifier, n.sample_id, n.uid FROM wanted JOIN nodes n ON identifier = n.sample_id::VARCHAR
UNION ALL SELECT identifier, NULL, NULL FROM wanted WHERE identifier NOT IN (SELECT uid FROM nodes)
  AND identifier NOT IN (SELECT sample_id::VARCHAR FROM nodes WHERE sample_id IS NOT NULL)""".replace(",\nwanted", ", wanted", 1))
def mixed_identifiers_all(spark, sf):
    """Identifiers of all kinds against the whole registry, every line by its uid."""
    lines = r.nodes(spark, sf).where("sampletype = 'D.LIN'").select(F.col("uid").alias("identifier"))
    return resolve.resolve_identifiers(_asked(spark, sf).union(lines), r.nodes(spark, sf).select("sample_id", "uid"))


@book.query(r.with_sql(r.NODES_SQL, r.ORDER_UPLOAD_SQL, r.LINE_UPLOAD_SQL) + """
SELECT row_n, uid, CASE WHEN uid IN (SELECT uid FROM nodes WHERE uid NOT LIKE '%2') THEN '[EXIST]' ELSE '[NEW]' END AS mark
FROM (SELECT row_n, uid FROM upload UNION ALL SELECT row_n, uid FROM line_upload)""")
def existing_marks_all(spark, sf):
    """Orders and lines against a master that has both."""
    rows = r.order_upload(spark, sf).select("row_n", "uid").union(r.line_upload(spark, sf).select("row_n", "uid"))
    return resolve.mark_existing(rows, r.nodes(spark, sf).where("uid NOT LIKE '%2'"))


@book.query(r.with_sql(r.NODES_SQL, r.ORDER_UPLOAD_SQL) + """
SELECT 'order' AS kind, row_n, u.uid, u.name FROM upload u SEMI JOIN nodes n ON u.sampletype = n.sampletype AND u.name = n.name
UNION ALL SELECT 'line', l_orderkey, 'new', 'line ' || l_linenumber FROM lineitem WHERE 'line ' || l_linenumber IN (SELECT name FROM nodes WHERE sampletype = 'D.LIN')""")
def names_in_use_all(spark, sf):
    """Names of orders and of lines against the whole registry."""
    orders = r.order_upload(spark, sf).select(F.lit("order").alias("kind"), "row_n", "uid", "name", "sampletype")
    lines = r.table(spark, sf, "lineitem").select(
        F.lit("line").alias("kind"), F.col("l_orderkey").alias("row_n"), F.lit("new").alias("uid"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"),
        F.lit("D.LIN").alias("sampletype"))
    return checks.names_in_use(orders.union(lines), r.nodes(spark, sf)).select("kind", "row_n", "uid", "name")


@book.query("""
WITH v AS (SELECT p_partkey AS k, lower(p_brand) || '-' || CASE WHEN p_partkey % 5 = 0 THEN 'MVN-only' ELSE p_name END AS device_id FROM part)
SELECT k, device_id, CASE WHEN regexp_matches(device_id, '^brand#1\\d') THEN 'CEL-1' WHEN regexp_matches(device_id, '^brand#\\d+-MVN-only$') THEN NULL
  WHEN regexp_matches(device_id, '^.*(ring|bolt)') THEN 'CEL-2'
  ELSE '*** PLACEHOLDER: no tumor-parent rule matched device_id=''' || device_id || ''' ***' END AS rule_parent FROM v""")
def rule_lookup(spark, sf):
    device = F.concat(F.lower("p_brand"), F.lit("-"), F.when(F.col("p_partkey") % 5 == 0, "MVN-only").otherwise(F.col("p_name")))
    rows = r.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), device.alias("device_id"))
    rules = [(r"brand#1\d", "CEL-1"), (r"^brand#\d+-MVN-only$", None), (r".*(ring|bolt)", "CEL-2")]
    return resolve.match_rules(rows, "device_id", rules)


@book.query(f"""
WITH v AS (SELECT c_custkey AS k, c_mktsegment AS name FROM customer)
SELECT k, name, CASE name WHEN 'MACHINERY' THEN 'CEL-1' WHEN 'BUILDING' THEN 'CEL-1' WHEN 'FURNITURE' THEN 'CEL-2' END AS existing_uid FROM v""")
def alias_lookup(spark, sf):
    rows = r.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name"))
    aliases = local_table(spark, {"name": None, "existing_uid": None}, [("MACHINERY", "CEL-1"), ("BUILDING", "CEL-1"), ("FURNITURE", "CEL-2")])
    return resolve.alias_uids(rows, aliases, "name").select("k", "name", "existing_uid")


@book.query("""
WITH typed AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '19-' ELSE '20-' END || c_custkey ||
    CASE WHEN c_custkey % 4 = 0 THEN '_Frzn' ELSE '' END AS mouse FROM customer),
known AS (SELECT CASE WHEN c_custkey % 5 < 2 THEN '19-' ELSE '21-' END || c_custkey AS id FROM customer WHERE c_custkey % 7 > 0),
tried AS (SELECT mouse, CASE i WHEN 0 THEN mouse WHEN 1 THEN replace(mouse, '_Frzn', '') ELSE (17 + i) || substr(replace(mouse, '_Frzn', ''), 3) END AS id, i
  FROM typed, (VALUES (0), (1), (2), (3), (4)) y(i))
SELECT k, mouse, (SELECT arg_min(tried.id, i) FROM tried WHERE tried.mouse = typed.mouse AND tried.id IN (SELECT id FROM known)) AS matched_id FROM typed""")
def repaired_ids(spark, sf):
    k = F.col("c_custkey")
    mouse = F.concat(F.when(k % 3 == 0, "19-").otherwise("20-"), k.cast("string"), F.when(k % 4 == 0, "_Frzn").otherwise(""))
    typed = r.table(spark, sf, "customer").select(k.alias("k"), mouse.alias("mouse"))
    known = r.table(spark, sf, "customer").where("c_custkey % 7 > 0").select(
        F.concat(F.when(k % 5 < 2, "19-").otherwise("21-"), k.cast("string")).alias("known_id"))
    return resolve.repair_ids(typed, known, "mouse", ["19", "20", "21"], ["_Frzn"]).select("k", "mouse", "matched_id")


# --- bulk load -------------------------------------------------------------------------------------------------------

_MERGE = """
stored AS (SELECT 'ORD-' || o_orderkey AS uid, 'ORD' AS sampletype, o_orderpriority AS name FROM orders WHERE o_orderkey % 3 > 0),
sent AS (SELECT 'ORD-' || o_orderkey AS uid, CASE WHEN o_orderkey % 31 = 0 THEN 'ORX' ELSE 'ORD' END AS sampletype, 'new ' || o_orderpriority AS name
  FROM orders WHERE o_orderkey % 2 = 0),
merged AS (SELECT uid, CASE WHEN n.uid IS NULL THEN 'kept' WHEN s.uid IS NULL THEN 'inserted' WHEN n.sampletype <> s.sampletype THEN 'conflict'
    ELSE 'updated' END AS outcome, s.sampletype AS st, n.sampletype AS nt, s.name AS sn, n.name AS nn
  FROM stored s FULL JOIN sent n USING (uid))"""


def _stored_and_sent(spark, sf):
    k = F.col("o_orderkey")
    uid = F.concat(F.lit("ORD-"), k.cast("string")).alias("uid")
    orders = r.table(spark, sf, "orders")
    stored = orders.where("o_orderkey % 3 > 0").select(uid, F.lit("ORD").alias("sampletype"), F.col("o_orderpriority").alias("name"))
    sent = orders.where("o_orderkey % 2 = 0").select(
        uid, F.when(k % 31 == 0, "ORX").otherwise("ORD").alias("sampletype"), F.concat(F.lit("new "), "o_orderpriority").alias("name"))
    return stored, sent


def _merged(spark, sf, update=True):
    return load.merge_load(*_stored_and_sent(spark, sf), update)


@book.query(f"WITH {_MERGE}" + """
SELECT uid, CASE WHEN outcome IN ('inserted', 'updated') THEN nt ELSE st END AS sampletype,
  CASE WHEN outcome IN ('inserted', 'updated') THEN nn ELSE sn END AS name, outcome FROM merged""")
def merge_load(spark, sf):
    return _merged(spark, sf)


@book.query(book.sql["merge_load"])
def ranged_load(spark, sf):
    """The same load into a table stored by uid ranges, read back from its files."""
    stored, sent = _stored_and_sent(spark, sf)
    held = loadtable.LoadTable.create(stored)
    outcomes = held.load(sent, "first", update_existing=True)
    return held.rows.join(outcomes, "uid", "left").select("uid", "sampletype", "name", F.coalesce("outcome", F.lit("kept")).alias("outcome"))


@book.query(f"WITH {_MERGE}" + """
SELECT count(*) FILTER (outcome <> 'kept') AS processed, count(*) FILTER (outcome = 'inserted') AS success,
  count(*) FILTER (outcome = 'updated') AS skipped, count(*) FILTER (outcome = 'conflict') AS failed, 0::BIGINT AS updated,
  0::BIGINT AS uids_generated FROM merged""")
def load_totals(spark, sf):
    return load.load_totals(_merged(spark, sf, update=False))


_REPEATS = """
stored AS (SELECT 'CUS-' || c_custkey AS uid, c_mktsegment AS name FROM customer WHERE c_custkey % 2 = 0),
sent AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'CUS-' || o_custkey END AS uid, o_orderpriority AS name, o_orderkey AS row_n FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY row_n) AS rn FROM sent),
first AS (SELECT * FROM ranked WHERE uid <> '' AND rn = 1),
lost AS (SELECT row_n, uid, CASE WHEN uid = '' THEN 'no_uid' ELSE 'repeated' END AS reason FROM ranked WHERE uid = '' OR rn > 1)"""


def _repeats(spark, sf):
    uid = lambda k: F.concat(F.lit("CUS-"), F.col(k).cast("string"))
    stored = r.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(
        uid("c_custkey").alias("uid"), F.lit("CUS").alias("sampletype"), F.col("c_mktsegment").alias("name"), F.lit(0).cast("bigint").alias("row_n"))
    sent = r.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(uid("o_custkey")).alias("uid"), F.lit("CUS").alias("sampletype"),
        F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("bigint").alias("row_n"))
    return stored, sent


@book.query(f"WITH {_REPEATS} SELECT * FROM lost")
def load_refused(spark, sf):
    return load.refused(_repeats(spark, sf)[1], ["row_n"]).select("row_n", "uid", "reason")


@book.query(f"WITH {_REPEATS}" + """
SELECT uid, CASE WHEN n.uid IS NULL THEN s.name ELSE n.name END AS name,
  CASE WHEN n.uid IS NULL THEN 'kept' WHEN s.uid IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM stored s FULL JOIN first n USING (uid)""")
def merge_repeats(spark, sf):
    return load.merge_load(*_repeats(spark, sf), True, order=["row_n"]).select("uid", "name", "outcome")


@book.query(f"WITH {_REPEATS}" + """
SELECT (SELECT count(*) FROM sent) AS processed, count(*) AS success, 0::BIGINT AS skipped, (SELECT count(*) FROM lost) AS failed,
  count(*) FILTER (uid IN (SELECT uid FROM stored)) AS updated, 0::BIGINT AS uids_generated FROM first""")
def load_totals_repeats(spark, sf):
    stored, sent = _repeats(spark, sf)
    return load.load_totals(load.merge_load(stored, sent, True, order=["row_n"]), lost=load.refused(sent, ["row_n"]))


@book.query(r.with_sql(*UPLOAD) + """
SELECT sampletype, count(*) AS n_rows, count(*) FILTER (contains(j_notes, 'TODO') OR contains(j_clerk, 'TODO')) AS n_own FROM parsed GROUP BY 1""")
def scientist_rows(spark, sf):
    return load.rows_of_scientist(_prepared(spark, sf), "TODO", ["Notes", "Clerk"])


# --- pages and slices ------------------------------------------------------------------------------------------------

@book.query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 200")
def paged_listing(spark, sf):
    return ranking.page(r.table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], 3, 100).select("o_orderkey", "o_custkey")


@book.query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 700")
def deep_page(spark, sf):
    return ranking.page(r.table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], 8, 100, shallow=0).select("o_orderkey", "o_custkey")


@book.query("SELECT o_orderkey, row_no FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders) WHERE row_no BETWEEN 50 AND 9000")
def row_slice(spark, sf):
    return ranking.row_slice(r.table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "50-9000").select("o_orderkey", "row_no")


@book.query("SELECT o_orderkey, row_no FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders) WHERE row_no IN (SELECT event_id + 1 FROM events)")
def row_list(spark, sf):
    wanted = r.table(spark, sf, "events").select((F.col("event_id") + 1).alias("n"))
    return ranking.row_slice(r.table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], rows=wanted).select("o_orderkey", "row_no")
