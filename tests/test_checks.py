"""Row checks over several files, where row numbers start anew."""

from samplewright.operators import checks, filetree, resolve

UPLOAD = "uid string, sampletype string, json_metadata string, parent string, row_n int, file string, arm string"


def rows_of(spark, rows):
    return checks.prepare(spark.createDataFrame(rows, UPLOAD))


def test_repeats_across_files_and_dispositions_per_file(spark):
    full = '{"Name": "%s", "File_PrimaryData": "f", "Link_PrimaryData": "l", "Checksum_PrimaryData": "c"}'
    rows = rows_of(spark, [
        ("U-1", "MUS", full % "a", None, 2, "one", "A"), ("U-1", "MUS", full % "b", None, 2, "two", "B"),
        ("U-2", "MUS", "no json", None, 3, "one", "A"), ("U-3", "MUS", full % "c", None, 3, "two", "B")])
    again = checks.duplicate_uids(rows).collect()
    assert [(r.file, r.row_n, r.first_file) for r in again] == [("two", 2, "one")]
    catalogue = spark.createDataFrame([("MUS", ["Name"])], "sampletype string, required array<string>")
    issues = checks.all_issues(rows, catalogue, None, roots=["MUS"])
    assert {(r.code, r.file, r.row_n) for r in issues.collect() if r.severity == checks.HARD} == {("duplicate_uid", "two", 2), ("bad_json", "one", 3)}
    got = {(r.arm, r.disposition): r.n_rows for r in checks.dispositions(rows, issues).collect()}
    assert got == {("A", "CLEAN"): 1, ("A", "HARD_REJECT"): 1, ("B", "CLEAN"): 1, ("B", "HARD_REJECT"): 1}


def test_rules_match_from_the_start_only(spark):
    df = spark.createDataFrame([("b1",), ("xb",), ("a1",)], "device_id string")
    got = {r.device_id: r.rule_parent for r in resolve.match_rules(df, "device_id", [("^a|b", "P")]).collect()}
    assert got["a1"] == got["b1"] == "P" and got["xb"].startswith("***")


def test_manifest_order_goes_by_path_parts(spark):
    files = spark.createDataFrame([("Figure 3/a b.oib", 1), ("Figure 3/a/z.oib", 1)], "path string, length bigint")
    rows = filetree.build_manifest(files.selectExpr("path", "length", "timestamp'2020-01-01' AS mtime")).orderBy("id").collect()
    assert [r.original_path for r in rows] == ["Figure 3/a/z.oib", "Figure 3/a b.oib"]


def test_examples_come_from_every_blocker_code(spark):
    import __spark_entry__ as entry
    from samplewright.model import BLOCKERS

    rows = entry.queries()["blocker_examples"](spark, "/root/testdata/sf0.001").collect()
    seen = {r.code for r in rows}
    there = {r.code for r in entry.queries()["issue_rollup"](spark, "/root/testdata/sf0.001").where("is_blocker").collect()}
    assert seen == there <= set(BLOCKERS) and {"duplicate_uid", "duplicate_name", "parent_uid_not_found"} & seen


UPLOAD_KIND = "arm string, file string, row_n bigint, uid string, sampletype string, parent string, assay_titles string, json_metadata string"


def test_dispositions_tell_files_and_reasons_apart(spark):
    ok = '"Link_PrimaryData":"l","Checksum_PrimaryData":"c"'
    rows = spark.createDataFrame([
        ("A", "1.xlsx", 2, "U1", "T", "", "Known", '{"File_PrimaryData":"f",' + ok + "}"),
        ("A", "2.xlsx", 2, "U2", "T", "", "Known; Odd", '{"File_PrimaryData":"f","Notes":"*** PLACEHOLDER: x","Link_PrimaryData":"l"}'),
        ("A", "2.xlsx", 3, "U3", "T", "gone", "Alias", '{"Notes":"n",' + ok + "}"),
        ("B", "1.xlsx", 3, "U4", "T", None, None, '{"File_PrimaryData":"*** PLACEHOLDER: f ***",' + ok + "}"),
        ("B", "1.xlsx", 4, None, "T", None, "", None)], UPLOAD_KIND)
    issues = spark.createDataFrame([
        ("parent_uid_not_found", 2, "2.xlsx", 3), ("bad_json", 2, "2.xlsx", 3), ("missing_required", 0, "1.xlsx", 2), ("missing_uid", 2, "1.xlsx", 4)],
        "code string, severity int, file string, row_n bigint")
    cache = spark.createDataFrame([("Known", 1)], "title string, assay_id bigint")
    synonyms = spark.createDataFrame([("Alias", "Known"), ("Odd", "Nowhere")], "cited string, canonical string")
    found = checks.disposition_rows(checks.prepare(rows), issues, cache, synonyms)
    got = {(r["file"], r["row_n"]): (r["arm"], r["uid"], r["disposition"], r["reasons"]) for r in found.collect()}
    assert got == {
        ("1.xlsx", 2): ("A", "U1", "CLEAN", []),
        ("2.xlsx", 2): ("A", "U2", "SOFT_FLAG", ["Checksum_PrimaryData blank", "PLACEHOLDER marker in metadata", "assay_id unresolved"]),
        ("2.xlsx", 3): ("A", "U3", "HARD_REJECT", ["bad_json", "dangling Parent UID", "missing File_PrimaryData"]),
        ("1.xlsx", 3): ("B", "U4", "SOFT_FLAG", ["PLACEHOLDER marker in File_PrimaryData"]),
        ("1.xlsx", 4): ("B", None, "HARD_REJECT", ["missing File_PrimaryData", "missing_uid"])}
    counted = {(r["arm"], r["disposition"], r["reason"]): r["n_rows"] for r in checks.disposition_reasons(found).collect()}
    assert counted["B", "HARD_REJECT", "missing_uid"] == 1 and len(counted) == 9 and ("A", "CLEAN", None) not in counted
    bare = checks.disposition_rows(checks.prepare(rows), issues)
    assert {r["uid"]: r["reasons"] for r in bare.collect()}["U2"] == ["Checksum_PrimaryData blank", "PLACEHOLDER marker in metadata"]


def test_structure_of_a_batch(spark):
    heads = spark.createDataFrame([
        ("good", ["uid", "Parent ", "SAMPLETYPE", "json_metadata", ""]), ("twice", ["uid", "UID ", "parent", "sampletype", "json_metadata", "", ""]),
        ("short", ["uid", None, "sampletype"])], "file string, header array<string>")
    rows = spark.createDataFrame([
        ("good", "T", {"Name": "x"}), ("twice", "T", {"Name": "x", "Odd": "y"}), ("twice", "T", {"Odd": "z"}), ("short", "S", None)],
        "file string, sampletype string, attrs map<string,string>")
    fields = spark.createDataFrame([("T", "Name")], "sampletype string, field string")
    got = {r["file"]: tuple(r)[1:] for r in checks.batch_structure(heads, rows, fields).collect()}
    assert got == {"good": (0, 0, 0, True), "twice": (0, 1, 1, False), "short": (2, 0, 0, False), None: (2, 1, 1, False)}
    alone = checks.batch_structure(heads.where("file = 'good'"), rows.where("file = 'good'"), fields).collect()
    assert [r["valid"] for r in alone] == [True, True]
    assert [tuple(r) for r in checks.batch_structure(heads.limit(0), rows.limit(0), fields).collect()] == [(None, 0, 0, 0, True)]


def test_the_last_value_of_a_repeated_key_counts(spark):
    from samplewright.functions import text as t

    texts = ['{"a":"1","b":"2","a":"3"}', '{"a":"1","a":null}', '{"a":{"a":1},"b":[1],"a":"x"}', '{"a":1} x', "[]", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, j string").select("i", t.payload("j").alias("m"))
    assert [r["m"] for r in df.orderBy("i").collect()] == [{"a": "3", "b": "2"}, {"a": None}, {"a": "x", "b": "[1]"}, None, None, None, None]


def test_first_seen_keys_are_reduced_before_any_sort(spark):
    """Keys in the order of their first row and place; all cells go into a hash table, none into a sort."""
    from samplewright.operators import flat

    maps = [(3, "map('a', '1', 'b', '2')"), (2, "map('c', '1', 'b', '2')"), (5, "map('z', '1', 'a', '1')"), (2, "map('d', 'x')")]
    rows = spark.sql(" UNION ALL ".join(f"SELECT {n}L AS row_n, {m} AS attrs" for n, m in maps))
    seen = flat._first_seen(rows)
    assert {r["field"]: tuple(r["at"]) for r in seen.collect()} == {"a": (3, 0), "b": (2, 1), "c": (2, 0), "d": (2, 0), "z": (5, 0)}
    steps = [line for line in seen._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(" in line]
    assert "HashAggregate(" in steps[-1]


def counted(rows):
    """The rows, and a counter of how many of them were read."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(read, rows.schema), seen


def test_payloads_are_read_once_for_dispositions_and_parents(spark):
    from samplewright.operators import resolve

    rows = spark.createDataFrame([
        ("A", "1.xlsx", 2, "U1", "T", "U2; gone", "Known", "{}"), ("A", "1.xlsx", 3, " U2", "T", "old", "Odd", "{}")], UPLOAD_KIND)
    cache = spark.createDataFrame([("Known", 1)], "title string, assay_id bigint")
    synonyms = spark.createDataFrame([("Alias", "Known")], "cited string, canonical string")
    issues = spark.createDataFrame([("bad_json", 2, "1.xlsx", 2)], "code string, severity int, file string, row_n bigint")
    once, seen = counted(rows)
    found = checks.disposition_rows(checks.prepare(once), issues, cache, synonyms).collect()
    assert {r["uid"]: "bad_json" in r["reasons"] for r in found} == {"U1": True, " U2": False} and seen.value == 2
    once, seen = counted(rows)
    baseline = spark.createDataFrame([("old", "T", "x")], "uid string, sampletype string, name string")
    got = {r["parent_uid"]: r["status"] for r in resolve.resolve_parents(checks.prepare(once), baseline).collect()}
    assert got == {"U2": "intra", "gone": "missing", "old": "baseline"} and seen.value == 2
