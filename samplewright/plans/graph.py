"""Lineage, relational division, cycle checks and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.model import local_table
from samplewright.operators import checks, lineage, load, ranking, resolve, search, textindex
from samplewright.plans import registry as r
from samplewright.plans.base import Book
from samplewright.session import cut, stored

book = Book()
REC = r.with_sql(r.NODES_SQL, recursive=True)


def _edges(spark, sf):
    return stored(lineage.lineage_edges(r.nodes(spark, sf)), "edges")


def _closed(start: str, direction: str) -> str:
    near, far = ("child_uid", "parent_uid") if direction == "up" else ("parent_uid", "child_uid")
    return REC + f", c(uid) AS (SELECT uid FROM nodes WHERE {start} UNION SELECT {far} FROM edges JOIN c ON {near} = c.uid)\n"


@book.query(_closed("sampletype = 'D.LIN' AND ends_with(uid, '7')", "up") + "SELECT split_part(uid, '-', 1) AS sampletype, uid FROM c")
def closure_up(spark, sf):
    nodes = r.nodes(spark, sf)
    starts = nodes.where("sampletype = 'D.LIN' AND uid LIKE '%7'").select("uid")
    return lineage.closure(starts, _edges(spark, sf), "up").select(t.uid_type("uid").alias("sampletype"), "uid")


@book.query(_closed("uid = 'REG-240101TPC-1'", "down") + "SELECT split_part(uid, '-', 1) AS sampletype, count(*) AS n FROM c GROUP BY 1")
def closure_down(spark, sf):
    starts = r.nodes(spark, sf, lines=False).where("uid = 'REG-240101TPC-1'").select("uid")
    below = lineage.closure(starts, _edges(spark, sf), "down")
    return below.groupBy(t.uid_type("uid").alias("sampletype")).agg(F.count(F.lit(1)).alias("n"))


@book.query(_closed("uid = 'CUS-240101TPC-7'", "down") + "SELECT DISTINCT split_part(uid, '-', 1) AS sampletype FROM c WHERE uid <> 'CUS-240101TPC-7'")
def child_types(spark, sf):
    nodes = r.nodes(spark, sf)
    return lineage.child_types(nodes.where("uid = 'CUS-240101TPC-7'").select("uid"), _edges(spark, sf), nodes)


_TREES = REC + """,
asked AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'SUP-240101TPC-' || s_suppkey WHEN 1 THEN (s_suppkey * 10 + 4)::VARCHAR ELSE 'NOPE-' || s_suppkey END AS input_id FROM supplier
  UNION ALL SELECT c_custkey, 'CUS-240101TPC-' || c_custkey FROM customer WHERE c_custkey % 100 = 0),
res AS (SELECT input_id, uid FROM asked LEFT JOIN small_nodes ON input_id = uid OR input_id = sample_id::VARCHAR),
up(i, uid) AS (SELECT input_id, uid FROM res WHERE uid IS NOT NULL UNION SELECT i, parent_uid FROM edges JOIN up ON child_uid = up.uid),
down(i, uid) AS (SELECT input_id, uid FROM res WHERE uid IS NOT NULL UNION SELECT i, child_uid FROM edges JOIN down ON parent_uid = down.uid),
members AS (SELECT * FROM up UNION SELECT * FROM down),
rels AS (SELECT a.i, child_uid, parent_uid FROM edges JOIN members a ON child_uid = a.uid JOIN members b ON parent_uid = b.uid AND a.i = b.i)
""".replace(",\nasked", ", asked", 1)


def _asked(spark, sf):
    k = F.col("s_suppkey")
    ident = F.when(k % 3 == 0, t.mint_uid("SUP", r.LAB, r.DATE, k)).when(k % 3 == 1, (k * 10 + 4).cast("string")).otherwise(
        F.concat(F.lit("NOPE-"), k.cast("string")))
    cus = r.table(spark, sf, "customer").where("c_custkey % 100 = 0").select(t.mint_uid("CUS", r.LAB, r.DATE, F.col("c_custkey")))
    return r.table(spark, sf, "supplier").select(ident.alias("identifier")).union(cus)


@book.query(_TREES + """
SELECT input_id, uid AS resolved_id, (SELECT count(*) FROM members WHERE i = input_id) AS total_nodes,
  (SELECT count(*) FROM rels WHERE i = input_id) AS total_rels, CASE WHEN uid IS NULL THEN 'identifier not found' END AS warning FROM res""")
def batch_trees(spark, sf):
    return lineage.batch_trees(_asked(spark, sf), r.nodes(spark, sf), _edges(spark, sf))


def _tree_inputs(spark, sf):
    nodes = r.nodes(spark, sf)
    asked = resolve.resolve_identifiers(_asked(spark, sf), nodes).where("uid IS NOT NULL")
    return nodes, _edges(spark, sf), asked.select(F.col("identifier").alias("input_id"), "uid")


def _trees(spark, sf):
    return lineage.tree(*_tree_inputs(spark, sf))


@book.query(_TREES + "SELECT i AS input_id, m.uid, sampletype, replace(parent, ' ', '') AS parents FROM members m JOIN nodes n ON m.uid = n.uid")
def tree_nodes(spark, sf):
    nodes, _ = _trees(spark, sf)
    return nodes.select("input_id", "uid", "sampletype", F.array_join("parent_uids", ";").alias("parents"))


@book.query(_TREES + "SELECT i AS input_id, child_uid, parent_uid FROM rels")
def tree_rels(spark, sf):
    return _trees(spark, sf)[1]


@book.query(_TREES + """
SELECT input_id, uid FROM (SELECT i AS input_id, uid, row_number() OVER (PARTITION BY i ORDER BY uid) AS n FROM members) WHERE n BETWEEN 11 AND 20""")
def tree_page(spark, sf):
    return lineage.Trees(*_tree_inputs(spark, sf)).page(2, 10)


_LABEL = "CASE split_part(child_uid, '-', 1) WHEN 'D.LIN' THEN 'Packing' WHEN 'ORD' THEN 'Sale' ELSE 'Survey' END"


def _labelled(spark, sf):
    kind = t.uid_type("child_uid")
    label = F.when(kind == "D.LIN", "Packing").when(kind == "ORD", "Sale").otherwise("Survey")
    return lineage.lineage_edges(r.nodes(spark, sf)).withColumn("assay_title", label)


@book.query(r.with_sql(r.NODES_SQL) + f"""
SELECT DISTINCT p.sampletype AS source, c.sampletype AS target, {_LABEL} AS annotation FROM edges
JOIN nodes c ON child_uid = c.uid JOIN nodes p ON parent_uid = p.uid""")
def type_edges(spark, sf):
    return lineage.type_edges(_labelled(spark, sf), r.nodes(spark, sf))


_STUDIES = [(1, "Beta"), (1, "Alpha"), (2, "Alpha"), (2, "Alpha")]
_CONTEXT = [("Packing", 1, "put in a box"), ("Sale", 2, "sold")]


@book.query(r.with_sql(r.NODES_SQL, r.values_sql("studies", ["assay_id", "study_title"], _STUDIES), r.values_sql("ctx", ["annotation", "assay_id", "description"], _CONTEXT)) + f"""
SELECT source, target, annotation, assay_id::VARCHAR AS internal_assay_id,
  (SELECT string_agg(DISTINCT study_title, '; ' ORDER BY study_title) FROM studies s WHERE s.assay_id = ctx.assay_id) AS study_titles, description
FROM (SELECT DISTINCT split_part(parent_uid, '-', 1) AS source, split_part(child_uid, '-', 1) AS target, {_LABEL} AS annotation FROM edges) LEFT JOIN ctx USING (annotation)""")
def edge_attributes(spark, sf):
    import pyarrow as pa

    studies = local_table(spark, {"assay_id": pa.int64(), "study_title": None}, _STUDIES)
    context = local_table(spark, {"annotation": None, "assay_id": pa.int64(), "description": None}, _CONTEXT)
    return lineage.enrich_edges(lineage.uid_type_edges(_labelled(spark, sf), "assay_title"), context, studies)


@book.query(r.with_sql(r.NODES_SQL, r.values_sql("cat", ["node", "description", "clade", "metadata_fields"],
                       [(c[0], c[5], c[6], "; ".join(dict.fromkeys([*c[2], *c[3], *c[4]]))) for c in r.CATALOGUE])) + """
SELECT node, description, clade, metadata_fields, count(uid) AS n_samples FROM cat LEFT JOIN nodes ON node = sampletype GROUP BY ALL""")
def type_nodes(spark, sf):
    used = r.nodes(spark, sf).groupBy(F.col("sampletype").alias("node")).agg(F.count(F.lit(1)).alias("n_samples"))
    return lineage.type_nodes(r.catalogue(spark)).join(used, "node", "left").fillna(0, ["n_samples"])


@book.query(REC + """, below(top, uid) AS (SELECT parent_uid, child_uid FROM edges UNION SELECT top, child_uid FROM below JOIN edges ON parent_uid = below.uid)
SELECT uid, sampletype FROM nodes WHERE sampletype IN ('NAT', 'CUS') AND uid IN (
  SELECT top FROM below WHERE split_part(uid, '-', 1) IN ('ORD', 'D.LIN') GROUP BY top HAVING count(DISTINCT split_part(uid, '-', 1)) = 2)""")
def parents_by_child_types(spark, sf):
    nodes = r.nodes(spark, sf)
    edges = stored(lineage.lineage_edges(nodes, ["sampletype"]), "edges")
    found = lineage.parents_with_all_types(edges, nodes, ["ORD", "D.LIN"], ["NAT", "CUS"], typed="sampletype")
    return found.select("uid", "sampletype")


@book.query(r.with_sql(r.NODES_SQL) + """
SELECT parent_uid, count(*) AS n_children FROM edges WHERE parent_uid NOT IN (
  SELECT uid FROM nodes WHERE NOT (sampletype = 'CUS' AND ((sample_id - 3) // 10) % 7 = 0)) GROUP BY 1""")
def orphans(spark, sf):
    nodes = r.nodes(spark, sf)
    held = nodes.where("NOT (sampletype = 'CUS' AND ((sample_id - 3) div 10) % 7 = 0)")
    return lineage.orphans(lineage.lineage_edges(nodes), held)


# Suppliers in rings: each cites the next of its block of five, the last one the first; every seventh block is open. Parts
# hang below them, and one part in fifty cites itself.
_RINGS = """
ring AS (
  SELECT 'S' || s_suppkey AS child_uid, 'S' || (s_suppkey // 5 * 5 + (s_suppkey + 1) % 5) AS parent_uid FROM supplier
  WHERE NOT (s_suppkey // 5 % 7 = 0 AND s_suppkey % 5 = 4)
  UNION SELECT 'P' || p_partkey, 'S' || (p_partkey % (SELECT count(*) FROM supplier)) FROM part
  UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION SELECT 'P' || p_partkey, 'P' || p_partkey FROM part WHERE p_partkey % 50 = 0)"""


def _rings(spark, sf):
    sup, part = r.table(spark, sf, "supplier"), r.table(spark, sf, "part")
    n = sup.count()
    name = lambda p, c: F.concat(F.lit(p), F.expr(c).cast("string"))
    return (
        sup.where("NOT ((s_suppkey div 5) % 7 = 0 AND s_suppkey % 5 = 4)").select(
            name("S", "s_suppkey").alias("child_uid"), name("S", "s_suppkey div 5 * 5 + (s_suppkey + 1) % 5").alias("parent_uid"))
        .union(part.select(name("P", "p_partkey"), name("S", f"p_partkey % {n}")))
        .union(sup.select(name("S", "s_suppkey"), name("N", "s_nationkey")))
        .union(part.where("p_partkey % 50 = 0").select(name("P", "p_partkey"), name("P", "p_partkey")))
    )


@book.query(f"""WITH RECURSIVE {_RINGS},
r(a, b) AS (SELECT child_uid, parent_uid FROM ring UNION SELECT a, parent_uid FROM r JOIN ring ON b = child_uid),
looped AS (SELECT DISTINCT a AS uid FROM r WHERE a = b)
SELECT l.uid, max(m.uid) AS cycle_id FROM looped l JOIN looped m ON EXISTS (SELECT 1 FROM r WHERE a = l.uid AND b = m.uid)
  AND EXISTS (SELECT 1 FROM r WHERE a = m.uid AND b = l.uid) GROUP BY 1""")
def cycles(spark, sf):
    return lineage.cycle_nodes(_rings(spark, sf))


@book.query(f"""WITH RECURSIVE {_RINGS},
r(a, b) AS (SELECT child_uid, parent_uid FROM ring UNION SELECT a, parent_uid FROM r JOIN ring ON b = child_uid)
SELECT (SELECT count(DISTINCT parent_uid)::BIGINT FROM ring WHERE parent_uid NOT IN (SELECT child_uid FROM ring)) AS n_orphans,
  (SELECT count(DISTINCT a)::BIGINT FROM r WHERE a = b) AS n_in_cycles, FALSE AS valid""")
def dag_check(spark, sf):
    edges = _rings(spark, sf)
    return lineage.dag_check(edges, edges.select(F.col("child_uid").alias("uid")).distinct())


@book.query(REC + """, r(a, b) AS (SELECT child_uid, parent_uid FROM edges UNION SELECT a, parent_uid FROM r JOIN edges ON b = child_uid),
found AS (SELECT (SELECT count(DISTINCT parent_uid) FROM edges WHERE parent_uid NOT IN (SELECT uid FROM nodes)) AS n_orphans,
  (SELECT count(DISTINCT a) FROM r WHERE a = b) AS n_in_cycles)
SELECT *, n_orphans = 0 AND n_in_cycles = 0 AS valid FROM found""")
def dag_check_registry(spark, sf):
    return lineage.dag_check(_edges(spark, sf), r.nodes(spark, sf))


# --- retrieval and search --------------------------------------------------------------------------------------------

_A_FIFTH = """
asked AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'CUS-240101TPC-' || c_custkey ELSE 'NOPE' || c_custkey END AS identifier FROM customer WHERE c_custkey % 10 < 2),"""
_ALL_ASKED = """
asked AS (SELECT 'CUS-240101TPC-' || c_custkey AS identifier FROM customer UNION ALL SELECT (p_partkey * 10 + 5)::VARCHAR FROM part
  UNION ALL SELECT 'NOPE' || s_suppkey FROM supplier),"""
_SEARCHED = """
starts AS (SELECT identifier, uid FROM asked LEFT JOIN small_nodes ON uid = identifier),
up(uid) AS (SELECT uid FROM starts WHERE uid IS NOT NULL UNION SELECT parent_uid FROM edges JOIN up ON child_uid = up.uid),
down(uid) AS (SELECT uid FROM starts WHERE uid IS NOT NULL UNION SELECT child_uid FROM edges JOIN down ON parent_uid = down.uid),
found AS (SELECT split_part(uid, '-', 1) AS sampletype, uid, NOT (uid IN (SELECT uid FROM up)) AS is_child FROM (SELECT * FROM up UNION SELECT * FROM down)
  WHERE uid IN (SELECT uid FROM nodes))
"""
_SEARCHED_SMALL = _SEARCHED.replace("LEFT JOIN small_nodes ON uid = identifier", "LEFT JOIN small_nodes ON uid = identifier OR sample_id::VARCHAR = identifier")
_FOUND = REC + "," + _A_FIFTH + _SEARCHED
_FOUND_ALL = REC + "," + _ALL_ASKED + _SEARCHED_SMALL


def _some_customers(spark, sf):
    k = F.col("c_custkey")
    ident = F.when(k % 2 == 0, t.mint_uid("CUS", r.LAB, r.DATE, k)).otherwise(F.concat(F.lit("NOPE"), k.cast("string")))
    return r.table(spark, sf, "customer").where("c_custkey % 10 < 2").select(ident.alias("identifier"))


def _all_identifiers(spark, sf):
    """Every customer by uid, every part by number, and a miss per supplier."""
    customers = r.table(spark, sf, "customer").select(t.mint_uid("CUS", r.LAB, r.DATE, F.col("c_custkey")).alias("identifier"))
    parts = r.table(spark, sf, "part").select((F.col("p_partkey") * 10 + 5).cast("string"))
    return customers.union(parts).union(r.table(spark, sf, "supplier").select(F.concat(F.lit("NOPE"), F.col("s_suppkey").cast("string"))))


def _found(spark, sf, wanted=_some_customers):
    asked = wanted(spark, sf)
    asked = cut(resolve.resolve_identifiers(asked, r.nodes(spark, sf, lines=False)))
    found = lineage.full_lineage(asked.where("uid IS NOT NULL").select("uid"), _edges(spark, sf))
    found = found.join(r.nodes(spark, sf).select("uid").hint("merge"), "uid", "left_semi")  # a cited parent without a row is no sample
    return found.select("uid", "direction", t.uid_type("uid").alias("sampletype")), asked


@book.query(_FOUND + "SELECT sampletype, count(*) AS n_samples, count(*) FILTER (is_child) AS n_children FROM found GROUP BY 1")
def retrieve_groups(spark, sf):
    return load.retrieve_groups(_found(spark, sf)[0])


@book.query(_FOUND + """SELECT count(*) AS total_samples, count(DISTINCT sampletype) AS total_sample_types, count(*) FILTER (is_child) AS total_children,
  (SELECT count(*) FROM starts WHERE uid IS NULL) AS failed_uids FROM found""")
def retrieve_totals(spark, sf):
    return load.retrieve_totals(*_found(spark, sf))


@book.query(_FOUND_ALL + "SELECT sampletype, count(*) AS n_samples, count(*) FILTER (is_child) AS n_children FROM found GROUP BY 1")
def retrieve_all_groups(spark, sf):
    """A retrieval that starts from every customer and every part."""
    return load.retrieve_groups(_found(spark, sf, _all_identifiers)[0])


@book.query(_FOUND_ALL + """SELECT count(*) AS total_samples, count(DISTINCT sampletype) AS total_sample_types, count(*) FILTER (is_child) AS total_children,
  (SELECT count(*) FROM starts WHERE uid IS NULL) AS failed_uids FROM found""")
def retrieve_all_totals(spark, sf):
    return load.retrieve_totals(*_found(spark, sf, _all_identifiers))


def _searchable(spark, sf):
    return checks.prepare(r.order_upload(spark, sf)).where("attrs IS NOT NULL")


@book.query(r.with_sql(r.ORDER_UPLOAD_SQL) + """
SELECT row_n, uid FROM parsed WHERE ok AND sampletype = 'ORD' AND (contains(lower(json_extract_string(json_metadata, '$."Notes"')), 'urgent')
  AND contains(lower(json_extract_string(json_metadata, '$."Notes"')), '1-'))""")
def advanced_search(spark, sf):
    return search.advanced_search(_searchable(spark, sf), ["URGENT", "1-"], ["ORD"], ["Notes"], text_logic="AND").select("row_n", "uid")


@book.query(r.with_sql(r.ORDER_UPLOAD_SQL) + """
SELECT row_n, uid FROM parsed WHERE ok AND list_contains(list_transform(json_extract_string(json_metadata, ['$."UID"', '$."Name"', '$."Parent"', '$."Status"', '$."Clerk"',
  '$."Notes"', '$."File_PrimaryData"', '$."Link_PrimaryData"', '$."Checksum_PrimaryData"', '$."Subjet ID"']), lambda x: lower(x)), 'clerk 3')""")
def search_any_exact(spark, sf):
    return search.advanced_search(_searchable(spark, sf), ["Clerk 3"], match="EXACT").select("row_n", "uid")


@book.query(r.with_sql(r.ORDER_UPLOAD_SQL) + """
SELECT row_n, uid FROM parsed WHERE ok AND ((contains(lower(j_notes), 'todo') AND contains(lower(j_clerk), 'todo')) OR (contains(lower(j_notes), 'clerk') AND contains(lower(j_clerk), 'clerk'))
   OR (contains(lower(j_notes), 'r') AND contains(lower(j_clerk), 'r')))""")
def search_attribute_and(spark, sf):
    return search.advanced_search(
        _searchable(spark, sf), ["todo", "clerk", "r"], (), ["Notes", "Clerk"], attribute_logic="AND").select("row_n", "uid")


_SEARCHES = ["advanced_search", "search_any_exact", "search_attribute_and"]
_AFTER_WITH = {name: book.sql[name].removeprefix(r.with_sql(r.ORDER_UPLOAD_SQL)) for name in _SEARCHES}


@book.query(r.with_sql(r.ORDER_UPLOAD_SQL) + "\nUNION ALL ".join(f"SELECT '{name}' AS search, row_n, uid FROM ({sql})" for name, sql in _AFTER_WITH.items()))
def indexed_search(spark, sf):
    """The three searches above through one index; the third has a text too short for it."""
    index = textindex.TextIndex.build(_searchable(spark, sf))
    found = [index.search(["URGENT", "1-"], ["ORD"], ["Notes"], text_logic="AND"), index.search(["Clerk 3"], match="EXACT"),
             index.search(["todo", "clerk", "r"], (), ["Notes", "Clerk"], attribute_logic="AND")]
    named = [f.select(F.lit(name).alias("search"), "row_n", "uid") for name, f in zip(_SEARCHES, found, strict=True)]
    return named[0].union(named[1]).union(named[2])


@book.query(r.with_sql(r.ORDER_UPLOAD_SQL) + """
SELECT row_n, uid FROM parsed WHERE ok AND contains(lower(j_status), 'f') ORDER BY row_n LIMIT 100 OFFSET 100""")
def paged_search(spark, sf):
    hits = search.advanced_search(_searchable(spark, sf), ["F"], (), ["Status"])
    return ranking.page(hits, ["row_n"], 2, 100).select("row_n", "uid")
