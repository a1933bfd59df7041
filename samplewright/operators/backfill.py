"""Filling link and accession columns, with exact counts of what changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.operators.ranking import last_by
from samplewright.operators.skew import lookup_join


def with_column_if_absent(rows: DataFrame, column: str) -> DataFrame:
    """A link column that a sheet does not have yet is added empty."""
    return rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast("string"))


def changed(old: Column | str, new: Column | str) -> Column:
    """1 when a cell changes, nulls compared as values."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return (~as_col(old).eqNullSafe(as_col(new))).cast("int")


def match_members(members: DataFrame, index: DataFrame, sheets: DataFrame) -> DataFrame:
    """Archive members against the file index: matched, no_curation_match or no_sheet.

    `members(zip_name, filename)`, `index(filename, sampletype, uid)`, `sheets(sampletype)` with an upload sheet.
    """
    held = sheets.select("sampletype", F.lit(True).alias("_sheet")).distinct()
    found = lookup_join(lookup_join(members, index, "filename", "left"), held, "sampletype", "left")
    state = F.when(F.col("uid").isNull(), "no_curation_match").when(F.col("_sheet"), "matched").otherwise("no_sheet")
    return found.select("zip_name", "filename", "sampletype", "uid", state.alias("state"))


def archive_links(matched: DataFrame, record: str) -> DataFrame:
    """One link per (sampletype, uid): the last archive by name wins."""
    hit = matched.where("state = 'matched'")
    last = hit.groupBy("sampletype", "uid").agg(F.max("zip_name").alias("zip_name"))
    return last.select("sampletype", "uid", t.archive_url(record, "zip_name").alias("url"))


def backfill_by_uid(rows: DataFrame, links: DataFrame, column: str = "link_primarydata") -> DataFrame:
    """Set the link of every row whose (type, uid) has one; `touched` and `changed` say what happened to a row."""
    rows = with_column_if_absent(rows, column)
    new = F.coalesce("url", column)
    key = F.concat_ws("\x1f", "sampletype", "uid").alias("_key")
    found = lookup_join(rows.select("*", key), links.select(key, "url"), "_key", "left")
    return found.select(
        *[c for c in rows.columns if c != column], new.alias(column),
        F.col("url").isNotNull().alias("touched"), changed(column, new).alias("changed"),
    )


def image_links(images: DataFrame, order: list[str]) -> DataFrame:
    """filename → link: the last listing of a name wins; detail page first, show page as the fallback."""
    last = last_by(images.where(F.col("filename") != ""), ["filename"], order, ["web_url", "show_url"])
    return last.select("filename", t.pick_link("web_url", "show_url").alias("url")).where("url IS NOT NULL")


def backfill_by_name(rows: DataFrame, links: DataFrame, file_column: str, column: str = "link_primarydata") -> DataFrame:
    """Set the link of every row whose file name has one. Hot file names are spread over tasks."""
    rows = with_column_if_absent(rows, column)
    keyed = rows.withColumn("_file", t.filled(file_column))
    new = F.coalesce("url", column)
    found = lookup_join(keyed, links.withColumnRenamed("filename", "_file"), "_file", "left")
    return found.select(
        *[c for c in rows.columns if c != column], new.alias(column),
        F.col("url").isNotNull().alias("touched"), changed(column, new).alias("changed"),
    )


def roster_map(roster: DataFrame) -> DataFrame:
    """Roster lines to (sample_id, accession): the last line of an id wins; `n_lines` > 1 marks repeats."""
    ids = roster.withColumn("sample_id", t.roster_id("title")).where("sample_id IS NOT NULL")
    return ids.groupBy("sample_id").agg(
        F.max_by("accession", "line_no").alias("accession"), F.count(F.lit(1)).alias("n_lines")
    )


def roster_misses(roster: DataFrame) -> DataFrame:
    """Roster lines without a sample id."""
    return roster.where(t.roster_id("title").isNull())


def spatial_part(roster: DataFrame) -> DataFrame:
    """The part of a bulk roster that can stand in for a spatial one."""
    return roster.where(F.col("sample_id").rlike(r"^D\d{2}-\d{4}"))


def patch_accessions(
    rows: DataFrame, roster: DataFrame, prefix: str, id_column: str, pattern: str,
    link_column: str = "link_primarydata", accession_column: str | None = "accession",
) -> DataFrame:
    """Set link (and accession) from the roster by the id found in a cell.

    `state` is patched / no_id / not_in_roster / out_of_scope; `changed` counts the cells of the row that change.
    """
    rows = with_column_if_absent(rows, link_column)
    if accession_column:
        rows = with_column_if_absent(rows, accession_column)
    scope = F.coalesce(t.has_type("uid", [prefix]), F.lit(False))
    keyed = rows.withColumn("_id", F.when(scope, t.first_hit(id_column, pattern)))
    entries = roster.select(F.col("sample_id").alias("_id"), F.col("accession").alias("_acc"))
    found = lookup_join(keyed, entries, "_id", "left")
    new = {link_column: F.coalesce(t.accession_url("_acc"), link_column)}
    if accession_column:
        new[accession_column] = F.coalesce("_acc", accession_column)
    state = (
        F.when(~scope, "out_of_scope").when(F.col("_id").isNull(), "no_id").when(F.col("_acc").isNull(), "not_in_roster")
        .otherwise("patched")
    )
    moved = sum((changed(c, n) for c, n in new.items()), F.lit(0))
    return found.select(
        *[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], state.alias("state"), moved.alias("changed")
    )


def patch_constant(rows: DataFrame, prefix: str, column: str, value: str) -> DataFrame:
    """Set one value in all rows of a type; `changed` marks the cells that differ."""
    rows = with_column_if_absent(rows, column)
    scope = F.coalesce(t.has_type("uid", [prefix]), F.lit(False))
    new = F.when(scope, F.lit(value)).otherwise(F.col(column))
    return rows.select(
        *[new.alias(c) if c == column else F.col(c) for c in rows.columns], changed(column, new).alias("changed")
    )


def patch_report(patched: DataFrame) -> DataFrame:
    """Rows and changed cells per state of a patch."""
    return patched.groupBy("state").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("changed").alias("n_changed"))
