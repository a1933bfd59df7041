import glob
import gzip
import io
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.operators import filetree
from samplewright.plans import trees
from samplewright.plans.files import render_workbook
from samplewright.session import scratch_path
from samplewright.sinks import writers
from samplewright.sources import files, sheets, tables

SAMPLE = {
    "Samples": [["UID", "Name", "Parent"], ["RNA-260527ABC-1", "A1_tube1", "TIS-250218ABC-1"], ["RNA-260527ABC-2", "A1_tube2", "TIS-250218ABC-1"]],
    "Instructions": [["Field", "Type", "Description"]],
}


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def workbook(tabs):
    path = folder()
    with open(f"{path}/sample.xlsx", "wb") as f:
        f.write(render_workbook(tabs))
    with open(f"{path}/~$sample.xlsx", "wb") as f:
        f.write(b"lock")
    return path


def test_profile_of_the_sample_workbook(spark):
    got = {r["sheet"]: (r["n_rows"], r["n_cols"], r["headers"]) for r in sheets.profile(sheets.read_workbooks(spark, workbook(SAMPLE))).collect()}
    assert got == {"Samples": (3, 3, "UID, Name, Parent"), "Instructions": (1, 3, "Field, Type, Description")}


def test_rows_headers_gaps_and_numbers(spark):
    tabs = {"A": [["UID", None, "n", "n"], ["x", "free", 5, 6], [None, None, None, None], ["", "long inline text <&>", None, 7]]}
    rows = sheets.sheet_rows(sheets.read_workbooks(spark, workbook(tabs))).orderBy("row_n").collect()
    assert rows[0]["attrs"] == {"UID": "x", "_col1": "free", "n": "6"}
    assert [r["row_n"] for r in rows if r["attrs"]] == [2, 4]
    assert rows[-1]["attrs"]["_col1"] == "long inline text <&>"


def test_cells_of_odd_kinds(spark):
    """Shared strings with runs, booleans, stored formula values, rows and cells without references."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="b"><v>1</v></c></row>'
                   '<row r="4"><c r="B4" t="str"><f>A1</f><v>calc</v></c><c r="D4"><v>2.50</v></c><c r="E4"><v>3.0</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("x", out.getvalue())], "path string, content binary")
    got = [(r["row_n"], r["values"]) for r in sheets.scan_workbooks(df).orderBy("row_n").collect()]
    assert got == [(1, ["rich", "True"]), (4, [None, "calc", None, "2.50", "3"])]


def test_pick_sheet_falls_back(spark):
    cells = sheets.read_workbooks(spark, workbook({"First": [["UID"], ["a"]], "Other": [["UID"], ["b"]]}))
    assert [r["values"][0] for r in sheets.pick_sheet(cells).where("row_n > 1").collect()] == ["a"]
    assert [r["values"][0] for r in sheets.pick_sheet(cells, "Other").where("row_n > 1").collect()] == ["b"]
    assert sheets.pick_sheet(cells, "Missing").count() == 0


def test_flat_upload_with_aliases(spark):
    tabs = {"Samples": [[" UID ", "Sample_Type", "JsonMetadata", "parent"], ["u1", "RNA", "{}", "p"], [None] * 4]}
    rows = sheets.flat_upload(sheets.read_workbooks(spark, workbook(tabs))).collect()
    assert [(r["row_n"], r["uid"], r["sampletype"], r["json_metadata"], r["parent"]) for r in rows] == [(2, "u1", "RNA", "{}", "p")]


def test_empty_uid_list_is_one_newline(spark):
    path = writers.write_uid_list(spark.createDataFrame([], "uid string"), scratch_path(spark, "uids"))
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
    assert text == "\n"


def test_uid_list_parts_are_in_order(spark):
    uids = spark.range(1000).select(F.concat(F.lit("A-"), F.col("id").cast("string")).alias("uid"))
    path = writers.write_uid_list(uids.union(uids), scratch_path(spark, "uids"))
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
    assert text.split() == sorted(f"A-{i}" for i in range(1000))


def test_gzip_merge_keeps_source_order(spark):
    lines = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("big").alias("output"), (F.col("id") % 7).alias("source_no"), F.col("id").alias("line_no"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).repartition(5)
    path = writers.merge_to_gzip(lines, scratch_path(spark, "merge"), rows_per_part=700)
    for name, keep in (("small", lambda i: i % 3 == 0), ("big", lambda i: i % 3)):
        parts = sorted(glob.glob(f"{path}/output={name}/*.gz"))
        text = gzip.decompress(b"".join(open(f, "rb").read() for f in parts)).decode()
        assert text.split("\n")[:-1] == [f"line {i}" for i in sorted((i for i in range(6000) if keep(i)), key=lambda i: (i % 7, i))]
    assert len(glob.glob(f"{path}/output=big/*.gz")) > 2


def test_listing_and_checksums(spark):
    root = folder()
    os.makedirs(f"{root}/Figure 3/d")
    for name, body in (("Figure 3/a b.oib", b"abc"), ("Figure 3/d/x.txt", b"")):
        with open(f"{root}/{name}", "wb") as f:
            f.write(body)
    listing = files.list_files(spark, root)
    assert {(r["path"], r["length"]) for r in listing.collect()} == {("Figure 3/a b.oib", 3), ("Figure 3/d/x.txt", 0)}
    plan = spark.createDataFrame(
        [("Figure 3/a b.oib", "", "omero", ""), ("Figure 3/gone", "", "omero", ""), ("Figure 3/d/x.txt", "", "skip", "why")],
        "original_path string, md5 string, target_storage string, skip_reason string")
    digests = files.file_digests(spark, root, filetree.to_hash(plan))
    got = {r["original_path"]: (r["md5"], r["skip_reason"]) for r in filetree.add_checksums(plan, digests).collect()}
    assert got["Figure 3/a b.oib"] == ("900150983cd24fb0d6963f7d28e17f72", "")
    assert got["Figure 3/gone"] == ("", "md5 failed: file not readable") and got["Figure 3/d/x.txt"] == ("", "why")


def test_missing_and_broken_caches_are_empty(spark):
    root = folder()
    with open(f"{root}/bad.json", "w") as f:
        f.write("{oops")
    with open(f"{root}/good.json", "w") as f:
        f.write('{"project_id": "1", "assay_id_by_title": {"A": 3}}')
    assert tables.read_assay_cache(spark, f"{root}/none.json")[1] == "no cache"
    assert tables.read_assay_cache(spark, f"{root}/bad.json")[0].count() == 0
    assert tables.read_assay_cache(spark, f"{root}/good.json")[0].collect() == [("A", 3)]


def test_a_written_cache_is_read_back(spark):
    path = f"{folder()}/cache"
    for project, title in (("P1", "A"), ("P2", "B")):
        ids = spark.createDataFrame([(title, 7, 2)], "title string, assay_id bigint, n_ids bigint")
        writers.write_assay_cache(ids, project, "2024-01-01T00:00:00Z", path)
    assert [tables.read_assay_cache(spark, path, p)[0].collect() for p in ("P1", "P2", "P3")] == [[("A", 7)], [("B", 7)], []]
    assert tables.read_assay_cache(spark, f"{path}/none", "P1")[1] == "no cache"


def test_line_breaks_in_manifest_cells_come_back(spark):
    columns = tables.MANIFEST_COLUMNS
    note = 'two\nlines, "quoted"'
    rows = spark.createDataFrame([[note, *["x"] * (len(columns) - 1)]], list(columns))
    got = tables.read_manifest(spark, writers.write_manifest(rows, f"{folder()}/manifest")).collect()
    assert [r[columns[0]] for r in got] == [note]


def test_surplus_cells_and_a_missing_first_row(spark):
    book = {"A": [["UID"], ["x", "beyond"]]}
    assert sheets.sheet_rows(sheets.read_workbooks(spark, workbook(book))).first()["attrs"] == {"UID": "x", "_col1": "beyond"}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="str"><v>UID</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("x", out.getvalue())], "path string, content binary")
    assert [(r["row_n"], r["attrs"]) for r in sheets.sheet_rows(sheets.scan_workbooks(df)).collect()] == [(2, {"_col0": "UID"})]


def test_headers_that_fold_into_one_are_a_finding(spark):
    book = {"Samples": [["uid", "UID ", "Name"], ["a", "b", "n"], ["c", None, "m"]]}
    cells = sheets.read_workbooks(spark, workbook(book))
    assert [(r["uid"], r["name"]) for r in sheets.flat_upload(cells).orderBy("row_n").collect()] == [("b", "n"), ("c", "m")]
    assert [(r["sheet"], r["header"], r["n"]) for r in sheets.duplicate_headers(cells).collect()] == [("Samples", "uid", 2)]


def test_documents_of_the_catalogue_and_the_edges(spark):
    root = folder()
    with open(f"{root}/types.json", "w") as f:
        f.write('[{"SampleType": "RNA", "Name": "Rna", "Required Metadata": "UID, Name,", "Other": 1}]')
    with open(f"{root}/edges.json", "w") as f:
        f.write('{"fetched_at": "x", "connections": [{"assay": "A", "parent_type": "P", "child_type": "C"}]}')
    with open(f"{root}/pages.json", "w") as f:
        f.write('[{"data": [{"id": "4", "attributes": {"title": "T"}}, {"id": "5", "attributes": {}}], "links": {"next": null}}]')
    row = tables.sample_type(tables.read_catalogue(spark, f"{root}/types.json"), "RNA").first()
    assert row["required"] == ["UID", "Name"] and row["standard"] == []
    assert tables.read_allowed_edges(spark, f"{root}/edges.json").first()["child_type"] == "C"
    assert tables.read_assay_pages(spark, f"{root}/pages.json").collect() == [(4, "T")]


def test_roster_order_across_files(spark):
    root = folder()
    for name, line in (("a.txt", "GSM1 x_D7\n# note\n" + "GSM9 pad_D8\n" * 50), ("b.txt", "GSM2 y_D7\n")):
        with open(f"{root}/{name}", "w") as f:
            f.write(line)
    roster = tables.read_roster(spark, root).withColumn("id", t.roster_id("title"))
    from samplewright.operators.backfill import roster_map

    assert {r["sample_id"]: r["accession"] for r in roster_map(roster).collect()} == {"D7": "GSM2", "D8": "GSM9"}


def test_guard(spark):
    plan = spark.createDataFrame([(1, "ok"), (2, "bad")], "i int, state string")
    assert not writers.guarded_write(plan, "state = 'bad'", scratch_path(spark, "g"), write=True)
    good = plan.where("state = 'ok'")
    assert not writers.guarded_write(good, "state = 'bad'", scratch_path(spark, "g"))
    path = scratch_path(spark, "g")
    assert writers.guarded_write(good, "state = 'bad'", path, write=True) and spark.read.parquet(path).count() == 1


def test_four_tables_written(spark):
    import pyarrow as pa

    from samplewright.model import local_table
    from samplewright.operators.flat import four_tables, route_pending

    lists = pa.list_(pa.string())
    catalogue = local_table(
        spark, {"sampletype": None, "required": lists, "standard": lists, "possible": lists}, [("OOC", ["UID", "Name"], ["Notes"], ["Type"])])
    samples = spark.createDataFrame(
        [(2, "OOC", {"UID": "a", "Zeta": "z", "Name": "n"}), (3, "OOC", {"UID": "b", "Extra": "e"}), (4, "CEL", {"UID": "c"})],
        "row_n int, sampletype string, attrs map<string,string>")
    assays = local_table(spark, {"pos": pa.int32(), "title": None}, [(0, "Imaging")])
    ontology = local_table(spark, {"pos": pa.int32(), "field": None, "value": None}, [(0, "Type", "x"), (1, "Type", "y")])
    tables_ = four_tables("OOC", samples, catalogue, assays, ontology)
    assert tables_["samples"].columns == ["row_n", "UID", "Name", "Notes", "Type", "Zeta", "Extra"]
    assert [tuple(r) for r in tables_["samples"].orderBy("row_n").collect()] == [(2, "a", "n", "", "", "z", ""), (3, "b", "", "", "", "", "e")]
    assert [r["Database Field"] for r in tables_["instructions"].collect()][:2] == ["OOC::UID", "OOC::Name"]
    base = writers.write_four_tables(tables_, "OOC", scratch_path(spark, "four"))
    back = spark.read.csv(f"{base}/assay", header=True).first()
    assert (back["SampleType"], back["Assay"], back["Direction"]) == ("OOC", "Imaging", "child")
    up, pending = route_pending(samples, catalogue)
    a, b = writers.write_routed(up.drop("attrs"), pending.drop("attrs"), scratch_path(spark, "routed"))
    assert spark.read.parquet(a).count() == 2 and spark.read.parquet(b).first()["sampletype"] == "CEL"


def test_deposit_document(spark):
    root = folder()
    with open(f"{root}/d.json", "w") as f:
        f.write('{"samples": [{"*title": "t", "raw_files": ["a", "b"]}, {"*title": "u", "raw_files": []}], "paired_end_experiments": [{"file name 1": "x"}]}')
    from samplewright.operators.deposit import deposit_table, paired_table

    samples, pairs = tables.read_deposit(spark, f"{root}/d.json")
    wide = deposit_table(samples, ["pos"]).orderBy("pos").collect()
    assert (wide[0]["*raw file"], wide[0]["raw file"], wide[1]["*raw file"]) == ("a", "b", None)
    assert tuple(paired_table(pairs).first()) == ("x", None, None, None)


def test_the_active_sheet_stands_in_for_samples(spark):
    def opened_at(tab, names):
        made = zipfile.ZipFile(io.BytesIO(render_workbook({n: [["UID"], [f"{n}-1"]] for n in names})))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for item in made.namelist():
                data = made.read(item)
                if item == "xl/workbook.xml" and tab is not None:
                    data = data.replace(b"<sheets>", b'<bookViews><workbookView activeTab="%d"/></bookViews><sheets>' % tab)
                z.writestr(item, data)
        return bytearray(out.getvalue())

    books = [("two", opened_at(1, "AB")), ("none", opened_at(None, "AB")), ("named", opened_at(0, ["A", "Samples"]))]
    cells = sheets.scan_workbooks(spark.createDataFrame(books, "path string, content binary"))
    got = {r["file"]: r["sheet"] for r in sheets.pick_sheet(cells).where("row_n = 2").collect()}
    assert got == {"two": "B", "none": "A", "named": "Samples"}
    assert {r["sheet"] for r in sheets.pick_sheet(cells, "A").collect()} == {"A"}

def test_a_listing_is_read_once_and_shared_targets_are_right(spark):
    """The rules of a listing run once per file, whichever of its paths is looked up."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plan = spark.createDataFrame(
        [("1", "a", "t", "zenodo", 5), ("2", "b", "t", "zenodo", 6), ("3", "c", "u", "omero", 7), ("4", "d", "", "skip", 8)],
        "id string, original_path string, target_relpath string, target_storage string, size_bytes bigint")
    disk = spark.createDataFrame([("a", 5), ("t", 6), ("c", 7)], "path string, length bigint").mapInArrow(counted, "path string, length bigint")
    got = {r["id"]: (r["dst_length"], r["status"]) for r in filetree.verify_disk(plan, disk).collect()}
    assert got == {"1": (6, "size_drift"), "2": (6, "ok"), "3": (None, "not_moved")}
    assert seen.value == 3


def test_disk_checks_run_the_path_rules_once(spark):
    """Plan and listing of the disk queries come from a written plan, not from the orders again."""
    for made in (trees._disk, trees._whole_disk):
        for part in made(spark, "/root/testdata/sf0.001"):
            assert all("/plan-" in path for path in part.inputFiles())


def test_consolidation_reads_written_records(spark, monkeypatch):
    """Rows and counts come from records that were written once, so workbooks are parsed once."""
    from samplewright.plans import files as plans

    taken, real = [], plans.flat.flat_rows
    monkeypatch.setattr(plans.flat, "flat_rows", lambda records, *rest: taken.append(records) or real(records, *rest))
    plans.consolidate(spark, "/root/testdata/sf0.001")
    paths = taken[0].inputFiles()
    assert len(paths) and all("/records-" in path for path in paths)
