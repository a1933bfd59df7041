"""A sample registry over the star-schema test tables, in Spark and, side by side, in SQL for the oracle.

Types: REG, NAT, CUS, SUP, PRT, ORD and D.LIN; regions and parts are roots. Defects are injected by key arithmetic, so
both engines see the same ones. SQL fragments are `name AS (…)` items of a WITH clause.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions.layers import layer
from samplewright.functions.text import mint_uid
from samplewright.model import local_table
from samplewright.session import spread

LAB, DATE = "TPC", "240101"
ROOTS = ["REG", "PRT"]


# Given schemas save a job per read that would look them up in the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _uid(kind: str, *keys: str) -> Column:
    return mint_uid(kind, LAB, DATE, F.concat_ws("x", *[F.col(k).cast("string") for k in keys]))


def _cast(c: str) -> Column:
    return F.col(c).cast("string")


# --- samples ---------------------------------------------------------------------------------------------------------

def nodes(spark: SparkSession, sf: str, lines: bool = True) -> DataFrame:
    """All samples: (sample_id, uid, sampletype, name, parent). Line items have no numeric id."""
    def part(name, kind, key, label, parent, code):
        rows = table(spark, sf, name)
        return layer(
            spread(rows) if name == "orders" else rows, sample_id=F.col(key).cast("bigint") * 10 + code, uid=_uid(kind, key),
            name=label, parent=parent,
        ).select("sample_id", "uid", F.lit(kind).alias("sampletype"), "name", "parent")  # a filter by type leaves out whole tables

    out = part("region", "REG", "r_regionkey", F.col("r_name"), F.lit(""), 1)
    out = out.union(part("nation", "NAT", "n_nationkey", F.col("n_name"), _uid("REG", "n_regionkey"), 2))
    out = out.union(part("customer", "CUS", "c_custkey", F.col("c_name"), _uid("NAT", "c_nationkey"), 3))
    out = out.union(part("supplier", "SUP", "s_suppkey", F.col("s_name"), _uid("NAT", "s_nationkey"), 4))
    out = out.union(part("part", "PRT", "p_partkey", F.col("p_name"), F.lit(""), 5))
    out = out.union(part("orders", "ORD", "o_orderkey", F.concat(F.lit("order "), _cast("o_orderkey")),
                         _uid("CUS", "o_custkey"), 6))
    return out.union(line_nodes(spark, sf)) if lines else out


def line_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return layer(
        spread(table(spark, sf, "lineitem")), sample_id=F.lit(None).cast("bigint"),
        uid=_uid("D.LIN", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        name=F.concat(F.lit("line "), _cast("l_linenumber")),
        parent=F.concat(_uid("ORD", "l_orderkey"), F.lit("; "), _uid("PRT", "l_partkey")),
    ).select("sample_id", "uid", F.lit("D.LIN").alias("sampletype"), "name", "parent")


_U = lambda kind, key: f"'{kind}-{DATE}{LAB}-' || {key}"

NODES_SQL = f"""
small_nodes AS (
  SELECT r_regionkey::BIGINT * 10 + 1 AS sample_id, {_U('REG', 'r_regionkey')} AS uid, 'REG' AS sampletype,
         r_name AS name, '' AS parent FROM region
  UNION ALL SELECT n_nationkey::BIGINT * 10 + 2, {_U('NAT', 'n_nationkey')}, 'NAT', n_name, {_U('REG', 'n_regionkey')} FROM nation
  UNION ALL SELECT c_custkey * 10 + 3, {_U('CUS', 'c_custkey')}, 'CUS', c_name, {_U('NAT', 'c_nationkey')} FROM customer
  UNION ALL SELECT s_suppkey * 10 + 4, {_U('SUP', 's_suppkey')}, 'SUP', s_name, {_U('NAT', 's_nationkey')} FROM supplier
  UNION ALL SELECT p_partkey * 10 + 5, {_U('PRT', 'p_partkey')}, 'PRT', p_name, '' FROM part
  UNION ALL SELECT o_orderkey * 10 + 6, {_U('ORD', 'o_orderkey')}, 'ORD', 'order ' || o_orderkey, {_U('CUS', 'o_custkey')} FROM orders
),
nodes AS (
  SELECT * FROM small_nodes
  UNION ALL SELECT NULL, 'D.LIN-{DATE}{LAB}-' || l_orderkey || 'x' || l_linenumber || 'x' || l_partkey || 'x' || l_suppkey,
         'D.LIN', 'line ' || l_linenumber,
         {_U('ORD', 'l_orderkey')} || '; ' || {_U('PRT', 'l_partkey')} FROM lineitem
),
edges AS (
  SELECT DISTINCT uid AS child_uid, trim(p) AS parent_uid
  FROM (SELECT uid, unnest(string_split(parent, ';')) AS p FROM nodes) WHERE trim(p) <> ''
),
small_edges AS (
  SELECT DISTINCT uid AS child_uid, parent AS parent_uid FROM small_nodes WHERE parent <> ''
)"""


# --- uploads with defects --------------------------------------------------------------------------------------------

def _mod(key: str, n: int, rest: int = 0) -> Column:
    return F.pmod(F.col(key), F.lit(n)) == rest


def order_upload(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as flat upload rows with every kind of defect; `row_n` is unique.

    Cells are made in layers and the payload's text from them: one expression of everything becomes a method too long to be compiled.
    """
    k = "o_orderkey"
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    kind = F.when(_mod(k, 503, 7), "ORX").otherwise("ORD")
    uid = F.when(_mod(k, 997, 1), F.lit("")).when(_mod(k, 1009, 5), mint_uid("ORD", LAB, DATE, F.col(k) - 1)).otherwise(
        _uid("ORD", k))
    customer = _uid("CUS", "o_custkey")
    parent = (
        F.when(_mod(k, 101, 3) | _mod(k, 211, 4), F.lit(""))
        .when(_mod(k, 307, 8), F.lit("*** PLACEHOLDER: customer unknown ***")).otherwise(customer)
    )
    notes = (
        F.when(_mod(k, 13), "*** PLACEHOLDER: notes ***").when(_mod(k, 17), "TODO check TBD")
        .when(_mod(k, 19), "***PLACEHOLDER twice ***PLACEHOLDER").otherwise(F.concat(F.lit("priority "), "o_orderpriority"))
    )
    file = F.when(_mod(k, 23), "").when(_mod(k, 29), "*** PLACEHOLDER: file ***").otherwise(text("ord_", _cast(k), ".csv"))
    name = F.when(_mod(k, 1009, 6), F.col(k) - 1).otherwise(F.col(k)).cast("string")
    link = (
        F.when(_mod(k, 31), "").when(_mod(k, 5, 0), "https://zenodo.org/records/1/files/a.zip")
        .when(_mod(k, 5, 1), "https://OMERO.example.org/show").when(_mod(k, 5, 2), "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSM1")
        .when(_mod(k, 5, 3), "http://example.org/x").otherwise("local path")
    )
    clerk = F.when(_mod(k, 41), "").otherwise(text("clerk ", F.pmod(F.col(k), F.lit(7)).cast("string")))
    checksum = F.when(_mod(k, 37), "").otherwise(text("c", _cast(k)))
    made = layer(spread(table(spark, sf, "orders")), uid=uid, name=text("order ", name), customer=customer)
    made = layer(layer(made, parent=parent, notes=notes, clerk=clerk), file_cell=file, link=link, checksum=checksum)
    extra = F.when(_mod(k, 101, 3), text('"Parent":"', F.col("customer"), '",')).otherwise("")
    json = text(
        '{"UID":"', F.col("uid"), '","Name":"', F.col("name"), '",', extra, '"Status":"', F.col("o_orderstatus"), '","Clerk":"', F.col("clerk"),
        '","Notes":"', F.col("notes"), '","File_PrimaryData":"', F.col("file_cell"), '","Link_PrimaryData":"', F.col("link"),
        '","Checksum_PrimaryData":"', F.col("checksum"), '","Subjet ID":"', F.when(_mod(k, 89), "s").otherwise(""), '"}',
    )
    broken = F.when(_mod(k, 401, 9), F.left("json", F.lit(20))).when(_mod(k, 409, 10), F.lit("[1,2]")).when(
        _mod(k, 419, 11), F.lit("")).otherwise(F.col("json"))
    return layer(made, json=json).select(
        text("Arm", F.pmod(F.col(k), F.lit(4)).cast("string")).alias("arm"),
        text("file", F.pmod(F.col(k), F.lit(50)).cast("string"), ".xlsx").alias("file"),
        (F.col(k) + 2).alias("row_n"), "uid", kind.alias("sampletype"), "name", "parent",
        F.when(_mod(k, 3), "Short Read Sequencing; Cell Culture").when(_mod(k, 3, 1), "RNA extraction")
        .otherwise("Unlisted Assay").alias("assay_titles"), broken.alias("json_metadata"))


_J = lambda f: f"json_extract_string(json_metadata, '$.\"{f}\"')"

ORDER_UPLOAD_SQL = f"""
raw_upload AS (
  SELECT *, 'Arm' || (o_orderkey % 4) AS arm, 'file' || (o_orderkey % 50) || '.xlsx' AS file, o_orderkey + 2 AS row_n,
    CASE WHEN o_orderkey % 997 = 1 THEN '' WHEN o_orderkey % 1009 = 5 THEN 'ORD-{DATE}{LAB}-' || (o_orderkey - 1)
         ELSE {_U('ORD', 'o_orderkey')} END AS uid,
    CASE WHEN o_orderkey % 503 = 7 THEN 'ORX' ELSE 'ORD' END AS sampletype,
    'order ' || CASE WHEN o_orderkey % 1009 = 6 THEN o_orderkey - 1 ELSE o_orderkey END AS name,
    CASE WHEN o_orderkey % 101 = 3 OR o_orderkey % 211 = 4 THEN ''
         WHEN o_orderkey % 307 = 8 THEN '*** PLACEHOLDER: customer unknown ***' ELSE {_U('CUS', 'o_custkey')} END AS parent,
    CASE o_orderkey % 3 WHEN 0 THEN 'Short Read Sequencing; Cell Culture' WHEN 1 THEN 'RNA extraction'
         ELSE 'Unlisted Assay' END AS assay_titles,
    CASE WHEN o_orderkey % 13 = 0 THEN '*** PLACEHOLDER: notes ***' WHEN o_orderkey % 17 = 0 THEN 'TODO check TBD'
         WHEN o_orderkey % 19 = 0 THEN '***PLACEHOLDER twice ***PLACEHOLDER' ELSE 'priority ' || o_orderpriority END AS notes,
    CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN '*** PLACEHOLDER: file ***'
         ELSE 'ord_' || o_orderkey || '.csv' END AS file_cell,
    CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'https://zenodo.org/records/1/files/a.zip'
         WHEN 1 THEN 'https://OMERO.example.org/show' WHEN 2 THEN 'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSM1'
         WHEN 3 THEN 'http://example.org/x' ELSE 'local path' END END AS link
  FROM orders
),
json_upload AS (
  SELECT *, '{{"UID":"' || uid || '","Name":"' || name || '",' ||
    CASE WHEN o_orderkey % 101 = 3 THEN '"Parent":"' || {_U('CUS', 'o_custkey')} || '",' ELSE '' END ||
    '"Status":"' || o_orderstatus || '","Clerk":"' ||
    CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'clerk ' || (o_orderkey % 7) END || '","Notes":"' || notes ||
    '","File_PrimaryData":"' || file_cell || '","Link_PrimaryData":"' || link || '","Checksum_PrimaryData":"' ||
    CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'c' || o_orderkey END || '","Subjet ID":"' ||
    CASE WHEN o_orderkey % 89 = 0 THEN 's' ELSE '' END || '"}}' AS json_text FROM raw_upload
),
text_upload AS (
  SELECT *, CASE WHEN o_orderkey % 401 = 9 THEN left(json_text, 20) WHEN o_orderkey % 409 = 10 THEN '[1,2]'
                 WHEN o_orderkey % 419 = 11 THEN '' ELSE json_text END AS json_metadata FROM json_upload
),
upload AS (
  SELECT arm, file, row_n, uid, sampletype, name, parent, assay_titles, json_metadata,
         json_valid(json_metadata) AND json_type(CASE WHEN json_valid(json_metadata) THEN json_metadata ELSE '0' END) = 'OBJECT' AS ok
  FROM text_upload
),
parsed AS (
  SELECT u.*, CASE WHEN ok THEN {_J('UID')} END AS j_uid, CASE WHEN ok THEN {_J('Name')} END AS j_name,
    CASE WHEN ok THEN {_J('Parent')} END AS j_parent, CASE WHEN ok THEN {_J('Status')} END AS j_status,
    CASE WHEN ok THEN {_J('Clerk')} END AS j_clerk, CASE WHEN ok THEN {_J('Notes')} END AS j_notes,
    CASE WHEN ok THEN {_J('File_PrimaryData')} END AS j_file, CASE WHEN ok THEN {_J('Link_PrimaryData')} END AS j_link,
    CASE WHEN ok THEN {_J('Checksum_PrimaryData')} END AS j_sum, CASE WHEN ok THEN {_J('Subjet ID')} END AS j_subject
  FROM upload u
)"""


def line_upload(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as upload rows. Their UIDs repeat; `tie` orders rows that share a row number."""
    return layer(
        spread(table(spark, sf, "lineitem")), row_n=F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        tie=F.concat_ws("/", F.lpad(_cast("l_partkey"), 12, "0"), F.lpad(_cast("l_suppkey"), 12, "0"), F.lpad(
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0")),
        uid=_uid("D.LIN", "l_orderkey", "l_linenumber"), sampletype=F.lit("D.LIN"),
        parent=F.concat(_uid("ORD", "l_orderkey"), F.lit("; "), _uid("PRT", "l_partkey")),
    ).select("row_n", "tie", "uid", "sampletype", "parent")


LINE_UPLOAD_SQL = f"""
line_upload AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_n, lpad(l_partkey::VARCHAR, 12, '0') || '/' || lpad(l_suppkey::VARCHAR, 12, '0')
           || '/' || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0') AS tie,
         'D.LIN-{DATE}{LAB}-' || l_orderkey || 'x' || l_linenumber AS uid, 'D.LIN' AS sampletype,
         {_U('ORD', 'l_orderkey')} || '; ' || {_U('PRT', 'l_partkey')} AS parent
  FROM lineitem
)"""


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The master: regions, nations, suppliers, parts and six in seven customers."""
    kept = ~F.col("sampletype").isin("ORD") & ((F.col("sampletype") != "CUS") | F.expr("((sample_id - 3) div 10) % 7 <> 0"))
    return nodes(spark, sf, lines=False).where(kept).select("uid", "sampletype", "name")


BASELINE_SQL = """
baseline AS (
  SELECT uid, sampletype, name FROM small_nodes
  WHERE sampletype <> 'ORD' AND NOT (sampletype = 'CUS' AND ((sample_id - 3) // 10) % 7 = 0)
)"""


# --- lookup tables ---------------------------------------------------------------------------------------------------

_LIST = pa.list_(pa.string())
CATALOGUE = [
    ("REG", "Region", ["UID", "Name"], ["Notes"], [], "part of the world", "place"),
    ("NAT", "Nation", ["UID", "Name", "Parent"], ["Notes"], [], "a country", "place"),
    ("CUS", "Customer", ["UID", "Name", "Parent"], ["Notes"], ["Segment"], "a buyer", "party"),
    ("SUP", "Supplier", ["UID", "Name", "Parent"], ["Notes"], [], "a seller", "party"),
    ("PRT", "Part", ["UID", "Name"], ["Notes"], ["Brand"], "a good", "good"),
    ("ORD", "Order", ["UID", "Name", "Status", "Clerk"], ["Parent", "Notes"],
     ["File_PrimaryData", "Link_PrimaryData", "Checksum_PrimaryData"], "an order", "deal"),
    ("D.LIN", "Line", ["UID", "Parent"], ["Notes"], [], "an order line", "deal"),
]
ASSAYS = [("RNA Extraction", 61), ("Tissue Collection", 74), ("Short Read Sequencing", 64), ("Cell Culture", 85)]
SYNONYMS = [("RNA extraction", "RNA Extraction"), ("Unlisted Assay", "Gone Assay")]
ONTOLOGY = [("Status", "F"), ("Status", "O"), ("Clerk", "clerk 1"), ("Clerk", "clerk 2")]
ALLOWED = [("REG", "NAT", "Survey"), ("NAT", "CUS", "Census"), ("CUS", "ORD", "Sale"), ("ORD", "D.LIN", "Packing")]


def catalogue(spark: SparkSession) -> DataFrame:
    types = {"sampletype": None, "type_name": None, "required": _LIST, "standard": _LIST, "possible": _LIST,
             "description": None, "clade": None}
    return local_table(spark, types, CATALOGUE)


def catalogue_fields(spark: SparkSession) -> DataFrame:
    """(sampletype, field) for every defined field."""
    rows = [(t, f) for t, _, *lists, _, _ in CATALOGUE for part in lists for f in part]
    return local_table(spark, {"sampletype": None, "field": None}, rows)


def assay_cache(spark: SparkSession) -> DataFrame:
    return local_table(spark, {"title": None, "assay_id": pa.int64()}, ASSAYS)


def synonyms(spark: SparkSession) -> DataFrame:
    return local_table(spark, {"cited": None, "canonical": None}, SYNONYMS)


def ontology(spark: SparkSession) -> DataFrame:
    return local_table(spark, {"field": None, "value": None}, ONTOLOGY)


def allowed_edges(spark: SparkSession) -> DataFrame:
    return local_table(spark, {"parent_type": None, "child_type": None, "assay": None}, ALLOWED)


def values_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A lookup table as a WITH item."""
    lit = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


FIELDS_SQL = values_sql(
    "fields", ["sampletype", "field"], [(t, f) for t, _, *lists, _, _ in CATALOGUE for part in lists for f in part])
TYPES_SQL = values_sql("types", ["sampletype"], [(r[0],) for r in CATALOGUE])
ASSAYS_SQL = values_sql("cache", ["title", "assay_id"], ASSAYS)
SYNONYMS_SQL = values_sql("synonyms", ["cited", "canonical"], SYNONYMS)
ONTOLOGY_SQL = values_sql("ontology", ["field", "value"], ONTOLOGY)
ALLOWED_SQL = values_sql("allowed", ["parent_type", "child_type", "assay"], ALLOWED)


def with_sql(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
