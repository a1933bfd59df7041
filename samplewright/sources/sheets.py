"""Workbooks as one long table of rows.

`cells` has one row per sheet row: (file, sheet, sheet_pos, row_n, header array, values array, active). Row 1 is the header; `active`
marks the sheet that the workbook opens with.
A workbook is read by the task that holds the file; tasks hand rows on in batches, so a large sheet is never one
Python object.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.functions.layers import layer
from samplewright.operators.flat import first_assay
from samplewright.session import cut

CELLS_SCHEMA = (
    "file string, sheet string, sheet_pos int, row_n bigint, header array<string>, values array<string>, active boolean"
)
_ARROW = pa.schema([
    ("file", pa.string()), ("sheet", pa.string()), ("sheet_pos", pa.int32()), ("row_n", pa.int64()),
    ("header", pa.list_(pa.string())), ("values", pa.list_(pa.string())), ("active", pa.bool_()),
])
_BATCH = 4096


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    """0-based column of a cell reference such as `AB12`."""
    n = 0
    for ch in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _texts(archive: zipfile.ZipFile, name: str) -> list[str]:
    """The shared strings of a workbook; rich text runs are joined, phonetic hints left out."""
    out, run, hint = [], [], 0
    if name not in archive.namelist():
        return out
    for event, el in iterparse(archive.open(name), ("start", "end")):
        tag = _local(el.tag)
        if tag == "rPh":
            hint += 1 if event == "start" else -1
        elif event == "end" and tag == "t" and not hint:
            run.append(el.text or "")
        elif event == "end" and tag == "si":
            out.append("".join(run))
            run = []
            el.clear()
    return out


def _sheet_parts(archive: zipfile.ZipFile) -> list[tuple[str, str, bool]]:
    """(sheet name, part name, active) in workbook order."""
    rels = {}
    for _, el in iterparse(archive.open("xl/_rels/workbook.xml.rels")):
        if _local(el.tag) == "Relationship":
            target = el.get("Target")
            rels[el.get("Id")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
    sheets, active = [], 0
    for _, el in iterparse(archive.open("xl/workbook.xml")):
        if _local(el.tag) == "sheet":
            rid = next(v for k, v in el.attrib.items() if _local(k) == "id")
            sheets.append((el.get("name"), rels[rid]))
        elif _local(el.tag) == "workbookView":
            active = int(el.get("activeTab") or 0)
    return [(*sheet, i == active) for i, sheet in enumerate(sheets)]


def _number(text: str) -> str:
    """A numeric cell as text: whole numbers without a decimal point."""
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() and abs(value) < 2**53 else text


def _sheet_rows(archive: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list]]:
    """(row number, values) of a sheet. Gaps in rows and columns are kept; formulas give their stored value."""
    number, row = 0, {}
    kind, at, value, inline, data = None, 0, None, [], None
    for event, el in iterparse(archive.open(part), ("start", "end")):
        tag = _local(el.tag)
        if event == "start":
            if tag == "sheetData":
                data = el
            elif tag == "row":
                number, row = int(el.get("r") or number + 1), {}
            elif tag == "c":
                kind, value, inline = el.get("t"), None, []
                at = _column(el.get("r")) if el.get("r") else len(row)
        elif tag == "v":
            value = el.text
        elif tag == "t":
            inline.append(el.text or "")
        elif tag == "c":
            if kind == "s" and value is not None:
                row[at] = shared[int(value)]
            elif kind == "inlineStr":
                row[at] = "".join(inline)
            elif value is not None:
                row[at] = {"1": "True", "0": "False"}.get(value, value) if kind == "b" else (
                    value if kind in ("str", "e") else _number(value))
        elif tag == "row":
            yield number, [row.get(i) for i in range(max(row, default=-1) + 1)]
            data.clear()


def _workbook_batches(name: str, content: bytes, sheets: Sequence[str] | None) -> Iterator[pa.RecordBatch]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = _texts(archive, "xl/sharedStrings.xml")
        for pos, (sheet, part, active) in enumerate(_sheet_parts(archive)):
            if sheets is not None and sheet not in sheets:
                continue
            header, rows = None, []
            for row_n, values in _sheet_rows(archive, part, shared):
                if header is None:
                    header = values if row_n == 1 else []  # a sheet without row 1 has no header
                rows.append((name, sheet, pos, row_n, header, values, active))
                if len(rows) == _BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def scan_workbooks(files: DataFrame, sheets: Sequence[str] | None = None) -> DataFrame:
    """All rows of all sheets of `files(path, content)`, or of the named sheets only."""
    wanted = None if sheets is None else tuple(sheets)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from _workbook_batches(path, content.as_py(), wanted)

    return files.select("path", "content").mapInArrow(read, CELLS_SCHEMA)


def read_workbooks(spark: SparkSession, path: str | list[str], sheets: Sequence[str] | None = None) -> DataFrame:
    """Workbooks under a folder; lock files (`~…`) are left out."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    )
    return scan_workbooks(files.where(~F.regexp_extract("path", r"([^/]*)$", 1).startswith("~")), sheets)


def _names() -> Column:
    return F.transform("header", lambda h, i: F.coalesce(
        F.when(h != "", h), F.concat(F.lit("_col"), i.cast("string"))))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Data rows with `attrs`: header → value, blank headers as `_colN`, empty cells left out. The last of two equal
    headers wins. Cells past the last header are `_colN` too."""
    pairs = F.zip_with(_names(), "values", lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    named = F.transform(pairs, lambda x, i: F.struct(
        F.coalesce(x["k"], F.concat(F.lit("_col"), i.cast("string"))).alias("k"), x["v"].alias("v")))
    full = F.filter(named, lambda x: x["v"].isNotNull())
    return layer(
        cells.where("row_n > 1"), "file", "sheet", "sheet_pos", "row_n", attrs=F.map_from_entries(_last_of_each(full)))


def _last_of_each(pairs: Column) -> Column:
    """Key-value pairs without those whose key comes again later. Only a row that has a key twice is searched for it."""
    def pick(held: Column) -> Column:
        keys = F.transform(held, lambda x: x["k"])
        last = F.filter(held, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), held).otherwise(last)

    return F.get(F.transform(F.array(pairs), pick), F.lit(0))  # `pairs` is worked out once


def duplicate_headers(cells: DataFrame) -> DataFrame:
    """Findings (file, sheet, header, n): headers that a sheet has more than once, case and outer blanks aside."""
    heads = cells.groupBy("file", "sheet").agg(F.first("header").alias("header"))
    each = heads.select("file", "sheet", F.explode("header").alias("header")).select("file", "sheet", F.lower(t.norm("header")).alias("header"))
    return each.where("header <> ''").groupBy("file", "sheet", "header").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sheet_headers(cells: DataFrame, sheet: str = "Samples") -> DataFrame:
    """(file, header) of one sheet of every workbook."""
    return cells.where(F.col("sheet") == sheet).groupBy("file").agg(F.first("header").alias("header"))


def pick_sheet(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """Per file the named sheet, or else `Samples`, or else the active one; rows with a blank first cell are dropped."""
    if sheet is not None:
        picked = cells.where(F.col("sheet") == sheet)
    else:
        rank = F.struct(F.when(F.col("sheet") == "Samples", 0).when(F.col("active"), 1).otherwise(2), F.col("sheet_pos"))
        best = cells.groupBy("file").agg(F.min_by("sheet_pos", rank).alias("sheet_pos"))
        picked = cells.join(best, ["file", "sheet_pos"], "left_semi").select(*cells.columns)
    first = F.get("values", F.lit(0))
    return picked.where((F.col("row_n") == 1) | (first.isNotNull() & (first != "")))


def four_sheet_records(files: DataFrame) -> DataFrame:
    """Template files `(path, content)` as records (file, row_n, sampletype, parent_assay, attrs).

    The short Instructions and Assay sheets are read on their own, so the long Samples sheet is parsed once. Blank rows
    and cells are dropped.
    """
    heads = cut(scan_workbooks(files, ["Instructions", "Assay"]).where("row_n > 1"))
    field = F.get("values", F.lit(1))
    types = (
        heads.where((F.col("sheet") == "Instructions") & (F.coalesce(field, F.lit("")) != ""))
        .groupBy("file").agg(F.min_by(F.split_part(field, F.lit("::"), F.lit(1)), "row_n").alias("sampletype"))
    )
    assays = first_assay(heads.where("sheet = 'Assay'"))
    rows = layer(sheet_rows(scan_workbooks(files, ["Samples"])), "file", "row_n", attrs=t.drop_blank("attrs"))
    return rows.where("size(attrs) > 0").join(types, "file", "left").join(assays, "file", "left").select(
        "file", "row_n", "sampletype", F.coalesce("parent_assay", F.lit("")).alias("parent_assay"), "attrs")


def uid_cells(cells: DataFrame) -> DataFrame:
    """The UID column of every sheet that has one, whatever the case of its header: (file, sheet, row_n, uid)."""
    at = F.array_position(F.transform("header", lambda h: F.lower(t.norm(h))), "uid")
    uid = F.when(at > 0, F.get("values", (at - 1).cast("int")))
    return cells.where("row_n > 1").select("file", "sheet", "row_n", t.filled(uid).alias("uid")).where("uid IS NOT NULL")


def master_uids(cells: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Distinct UIDs of a master; without a master the set is empty."""
    if cells is None:
        return spark.createDataFrame([], "uid string")
    at = F.array_position("header", "UID")
    uid = F.when(at > 0, F.get("values", (at - 1).cast("int")))
    return cells.where("row_n > 1").select(t.filled(uid).alias("uid")).where("uid IS NOT NULL").distinct()


def flat_upload(cells: DataFrame) -> DataFrame:
    """Rows of flat upload sheets as named columns, row numbers as in the file; all-empty rows are dropped.

    Headers that differ only in case or outer blanks are one column, the last filled cell wins; `duplicate_headers` reports them."""
    rows = sheet_rows(cells.where("sheet = 'Samples'")).where("size(attrs) > 0")
    low = F.transform(F.map_entries("attrs"), lambda x: F.struct(F.lower(t.norm(x["key"])).alias("k"), x["value"].alias("v")))
    rows = rows.withColumn("attrs", F.map_from_entries(_last_of_each(low)))
    get = lambda c, alias=None: F.coalesce(*[t.attr("attrs", n) for n in ([c] + ([alias] if alias else []))])
    return rows.select(
        "file", "row_n", get("uid").alias("uid"), get("sampletype", "sample_type").alias("sampletype"),
        get("name").alias("name"), get("parent").alias("parent"), get("assay_titles").alias("assay_titles"),
        get("assay_ids", "assayids").alias("assay_ids"), get("json_metadata", "jsonmetadata").alias("json_metadata"),
    )


def profile(cells: DataFrame) -> DataFrame:
    """Per sheet: rows including the header, widest row, header list; a header without text is None."""
    return cells.groupBy("file", "sheet").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("values")).alias("n_cols"),
        F.array_join(F.transform(F.first("header"), lambda h: F.coalesce(F.when(h != "", h), F.lit("None"))), ", ").alias("headers"),
    )
