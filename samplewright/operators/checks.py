"""Quality checks. Every finding is a row: (code, severity, row_n, uid, sampletype, detail).

All checks that need one row only are made in a single pass over the upload; the rest are joins or windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.functions.layers import layer
from samplewright.model import (
    BLOCKERS, FLAT_REQUIRED, HARD, INFO, PLACEHOLDER_MARKERS, ROOT_TYPES, SOFT, SURPRISE_SENTINELS,
)
from samplewright.operators.ranking import first_rows, later_rows
from samplewright.operators.resolve import missing_parents, resolve_titles
from samplewright.operators.skew import lookup_join
from samplewright.session import cut, stored

ISSUE_COLUMNS = ["code", "severity", "row_n", "uid", "sampletype", "detail"]


def prepare(rows: DataFrame) -> DataFrame:
    """Check the columns and parse each payload once, into `attrs`."""
    lost = [c for c in FLAT_REQUIRED if c not in rows.columns]
    if lost:
        raise ValueError(f"required columns missing: {', '.join(lost)}")
    return layer(rows, attrs=t.payload("json_metadata"))


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _issue(when: Column, code: str, severity: int, detail: Column) -> Column:
    return F.when(
        when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))
    )


def _with_findings(rows: DataFrame, catalogue: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Add `findings`, the array of everything one row and its type decide. One pass, one small join."""
    known = catalogue.select(F.col("sampletype").alias("_type"), F.lit(True).alias("_known"), "required")
    df = rows.join(known, F.col("sampletype") == F.col("_type"), "left")
    row, uid, st = F.col("row_n"), F.col("uid"), F.col("sampletype")
    blank_json, no_uid = t.is_blank("json_metadata"), t.is_blank("uid")
    rootless = ~F.coalesce(st.isin(*roots), F.lit(False))
    no_parent = t.parent_cell("parent", "attrs").isNull()
    gaps = F.filter(
        F.coalesce("required", F.array().cast("array<string>")),
        lambda f: (f != "UID") & t.is_blank(F.try_element_at("attrs", f)),
    )
    single = F.array(
        _issue(no_uid, "missing_uid", HARD, _text("row ", row)),
        _issue(F.col("_known").isNull(), "unknown_sampletype", HARD, _text("row ", row, ": ", st)),
        _issue(~blank_json & F.col("attrs").isNull(), "bad_json", HARD, _text("row ", row, " (", uid, ")")),
        _issue(blank_json & rootless, "missing_json_metadata", HARD, _text("row ", row, " (", uid, ", ", st, ")")),
        _issue(no_parent & rootless, "blank_parent_nonroot", HARD,
               _text("row ", row, " (", uid, ", sampletype ", st, ") has no Parent")),
    )
    required = F.transform(
        gaps, lambda f: F.struct(F.lit("missing_required").alias("code"), F.lit(INFO).alias("severity"), f.alias("detail"))
    )
    return df.withColumn("findings", F.concat(F.filter(single, lambda x: x.isNotNull()), required))


def row_key(df: DataFrame) -> list[str]:
    """What tells the rows of an upload apart: row numbers start anew in every file."""
    return [c for c in ("file", "row_n") if c in df.columns]


def _issue_columns(rows: DataFrame) -> list[str]:
    return [*ISSUE_COLUMNS, *(["file"] if "file" in rows.columns else [])]


def _exploded(df: DataFrame) -> DataFrame:
    return df.select(*row_key(df), "uid", "sampletype", F.inline("findings")).select(*_issue_columns(df))


def row_issues(rows: DataFrame, catalogue: DataFrame, roots: Sequence[str] = ROOT_TYPES) -> DataFrame:
    """All findings that one row and its type decide, one per row. `rows` comes from `prepare`."""
    return _exploded(_with_findings(rows, catalogue, roots))


def duplicate_uids(rows: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Second and later rows of a UID, with the first row's number and type. The order is by file, if there is one, and row."""
    order = order or row_key(rows)
    named = rows.withColumn("uid", t.filled("uid")).where(F.col("uid").isNotNull())
    return later_rows(named, ["uid"], list(order), ["sampletype"])


def duplicate_names(rows: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Second and later rows of a name within its type. The name is the payload's."""
    order = order or row_key(rows)
    named = rows.withColumn("name", F.col("attrs").getItem("Name")) if "attrs" in rows.columns else rows
    return later_rows(named.where(~t.is_blank("name")), ["sampletype", "name"], list(order))


def unknown_types(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    return rows.join(catalogue.select("sampletype"), "sampletype", "left_anti")


def required_gaps(issues: DataFrame) -> DataFrame:
    """Rows blank per (type, required field)."""
    gaps = issues.where(F.col("code") == "missing_required")
    return gaps.groupBy("sampletype", F.col("detail").alias("field")).agg(F.count(F.lit(1)).alias("n_blank"))


def all_issues(
    rows: DataFrame, catalogue: DataFrame, baseline: DataFrame | None, roots: Sequence[str] = ROOT_TYPES,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The full issue table of an upload prepared by `prepare`. Rows that carry a `file` have it in their issues too.

    The payloads are read once: keys, parent cell, name and row findings go to a slim table without payloads, and all
    checks across rows work on that.
    """
    order = order or row_key(rows)
    keep = [*row_key(rows), "uid", "sampletype"]
    slim = cut(_with_findings(rows, catalogue, roots).select(
        *dict.fromkeys([*keep, *order]), t.parent_cell("parent", "attrs").alias("parent"),
        t.attr("attrs", "Name").alias("name"), "findings",
    ))
    dup = duplicate_uids(slim.select(*dict.fromkeys([*keep, *order])), order).select(
        F.lit("duplicate_uid").alias("code"), F.lit(HARD).alias("severity"), *keep,
        _text(F.col("uid"), " appears in row ", F.col("row_n"), " AND row ", F.col("first_row_n"), " (sampletype ",
              F.col("first_sampletype"), ")").alias("detail"),
    )
    names = duplicate_names(slim.select(*dict.fromkeys([*keep, *order, "name"])), order).select(
        F.lit("duplicate_name").alias("code"), F.lit(HARD).alias("severity"), *keep,
        _text("sampletype ", F.col("sampletype"), ", name '", F.col("name"), "' reseen in row ", F.col("row_n")).alias(
            "detail"),
    )
    lost = missing_parents(slim, baseline, keep).select(
        F.lit("parent_uid_not_found").alias("code"), F.lit(HARD).alias("severity"), *keep,
        _text("row ", F.col("row_n"), " ", F.col("uid"), " (", F.col("sampletype"), ") → Parent '", F.col("parent_uid"),
              "' not in upload or baseline").alias("detail"),
    )
    parts = [_exploded(slim), dup, names, lost]
    return reduce(DataFrame.unionByName, [p.select(*_issue_columns(rows)) for p in parts])


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Findings per code, and whether the code blocks the upload."""
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n_issues")).withColumn(
        "is_blocker", F.col("code").isin(*BLOCKERS)
    )


def issue_examples(issues: DataFrame, k: int = 10) -> DataFrame:
    """The first `k` findings per code."""
    return first_rows(issues, ["code"], ["row_n", "uid", "detail"], k)


def type_counts(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows per type against `expected(sampletype, expected)`, over all types of either side, and a total.

    Counts are taken first; the join meets one row per type.
    """
    actual = rows.groupBy("sampletype").agg(F.count(F.lit(1)).alias("actual"))
    both = actual.join(expected, "sampletype", "full_outer").select(
        "sampletype", F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
        F.col("expected").cast("bigint").alias("expected"),
    )
    status = F.when(F.col("expected").isNull(), "unexpected").when(
        F.col("actual") == F.col("expected"), "ok").otherwise("mismatch")
    total = both.agg(F.sum("actual").alias("actual"), F.sum("expected").alias("expected")).select(
        F.lit("TOTAL").alias("sampletype"), "actual", "expected"
    )
    return both.withColumn("status", status).unionByName(
        total.withColumn("status", F.when(F.col("actual") == F.col("expected"), "ok").otherwise("mismatch"))
    )


def verdict(issues: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: pass / count mismatch / blockers, with the exit code 0 only when nothing blocks."""
    blocked = issues.agg(
        F.count_if(F.col("code").isin(*BLOCKERS)).alias("n_blockers"), F.lit(True).alias("counts_ok")
    )
    matched = counts.where("sampletype <> 'TOTAL'").agg(
        F.lit(0).cast("bigint").alias("n_blockers"),
        F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("counts_ok"),
    )
    both = blocked.union(matched).agg(
        F.sum("n_blockers").alias("n_blockers"), F.bool_and("counts_ok").alias("counts_ok")
    )
    return both.select(
        "n_blockers", "counts_ok",
        F.when(F.col("n_blockers") > 0, "blockers").when(F.col("counts_ok"), "pass").otherwise("count_mismatch").alias(
            "verdict"),
        F.when(F.col("n_blockers") > 0, 1).otherwise(0).alias("exit_code"),
    )


def marker_counts(rows: DataFrame) -> DataFrame:
    """Occurrences of each placeholder marker and rows that hold each surprise sentinel. One pass, one output row each."""
    json = "json_metadata"
    sums = {m: F.sum(t.marker_count(json, m)) for m in PLACEHOLDER_MARKERS}
    sums |= {f"surprise:{s}": F.count_if(t.sentinel_flag(json, s)) for s in SURPRISE_SENTINELS}
    wide = rows.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"c{i}") for i, c in enumerate(sums.values())])
    pairs = F.array(*[
        F.struct(F.lit(k).alias("marker"), F.col(f"c{i}").alias("n")) for i, k in enumerate(sums)
    ])
    return wide.select(F.inline(pairs))


def file_column_flags(rows: DataFrame, column: str = "File_PrimaryData") -> DataFrame:
    """A blank file cell is a hard fault, a placeholder in it a soft one."""
    cell = t.attr("attrs", column)
    return rows.withColumn(
        "file_flag", F.when(t.is_blank(cell), HARD).when(t.holds_any(cell), SOFT).otherwise(INFO)
    )


def dispositions(
    rows: DataFrame, issues: DataFrame, group: str = "arm",
    soft_columns: Sequence[str] = ("Link_PrimaryData", "Checksum_PrimaryData"),
) -> DataFrame:
    """CLEAN / SOFT_FLAG / HARD_REJECT per row, the worst finding wins; counted per group.

    `rows` is prepared and carries `row_n`, and `file` if it comes from several, as its key. Issue severities are brought
    down to one row per upload row before the join.
    """
    key = [c for c in row_key(rows) if c in issues.columns]
    worst = issues.groupBy(*key).agg(F.max("severity").alias("_worst"))
    soft = reduce(lambda a, b: a | b, [t.is_blank(t.attr("attrs", c)) for c in soft_columns])
    own = file_column_flags(rows).select(
        group, *[c for c in key if c != group], F.greatest("file_flag", F.when(soft, SOFT).otherwise(INFO)).alias("_own")
    )
    level = F.greatest("_own", F.coalesce("_worst", F.lit(INFO)))
    word = F.when(level == HARD, "HARD_REJECT").when(level == SOFT, "SOFT_FLAG").otherwise("CLEAN")
    return own.join(worst, key, "left").groupBy(group, word.alias("disposition")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


#: Words of the report for some codes; other codes stand for themselves. Fixed values.
REASONS = {"parent_uid_not_found": "dangling Parent UID", "unknown_sampletype": "pending-schema type"}
_LEVELS = {HARD: "HARD_REJECT", SOFT: "SOFT_FLAG", INFO: "CLEAN"}


def _own_reasons(soft_columns: Sequence[str], file_column: str) -> Column:
    """What a row's payload alone says, as (severity, reason)."""
    cell = t.attr("attrs", file_column)
    rest = F.filter(F.map_values(F.map_filter("attrs", lambda k, _: k != file_column)), lambda v: t.holds_any(v))
    say = lambda when, level, text: F.when(when, F.struct(F.lit(level).alias("severity"), F.lit(text).alias("reason")))
    found = [
        say(t.is_blank(cell), HARD, f"missing {file_column}"), say(t.holds_any(cell), SOFT, f"PLACEHOLDER marker in {file_column}"),
        say(F.size(rest) > 0, SOFT, "PLACEHOLDER marker in metadata"),
        *[say(t.is_blank(t.attr("attrs", c)), SOFT, f"{c} blank") for c in soft_columns],
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def unresolved_assays(rows: DataFrame, cache: DataFrame, synonyms: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows that cite an assay title without an id, once each. Distinct titles are resolved; few are left over as a rule."""
    cited = rows.select(*keep, F.explode(F.array_distinct(t.split_list("assay_titles"))).alias("title"))
    lost = resolve_titles(cited.select("title").distinct(), cache, synonyms).where("how = 'unresolved'").select("title")
    return lookup_join(cited, lost, "title", "left_semi").select(*keep).distinct()


def disposition_rows(
    rows: DataFrame, issues: DataFrame, cache: DataFrame | None = None, synonyms: DataFrame | None = None, group: str = "arm",
    file_column: str = "File_PrimaryData", soft_columns: Sequence[str] = ("Link_PrimaryData", "Checksum_PrimaryData"),
) -> DataFrame:
    """Every upload row with its disposition and why: (group, file, row_n, uid, disposition, reasons).

    The worst finding decides. `reasons` are the findings of that severity, each once and in order: what has to be mended before
    the row moves up. Rows of several files are told apart by (file, row_n). With `cache` and `synonyms`, an assay title
    without an id is a soft flag. Payloads are read once: what they say is written, and rows and the other findings are one table with
    one aggregate; a row has as many findings as there are rules.
    """
    key = row_key(rows)
    named = [*dict.fromkeys([group, *key])]
    finding = lambda level, text: [F.lit(level).alias("severity"), F.lit(text).cast("string").alias("reason")]
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in dict.fromkeys([group, "uid"]) if c not in key]
    one = lambda level, text: F.array(F.struct(*finding(level, text))).alias("_found")
    titles = ["assay_titles"] if cache is not None and synonyms is not None else []
    held = stored(rows.select(*dict.fromkeys([*named, "uid", *titles]), _own_reasons(soft_columns, file_column).alias("_found")), "own")
    base = held.select(*dict.fromkeys([*named, "uid"]), "_found")
    said = F.coalesce(*[F.when(F.col("code") == c, F.lit(words)) for c, words in REASONS.items()], F.col("code"))
    found = issues.where(F.col("severity") > INFO).select(
        *key, *blank, F.array(F.struct("severity", said.alias("reason"))).alias("_found"))
    parts = [base, found]
    if titles:
        lost = unresolved_assays(held, cache, synonyms, key)
        parts.append(lost.select(*key, *blank, one(SOFT, "assay_id unresolved")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    each = every.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in dict.fromkeys([group, "uid"]) if c not in key],
        F.array_distinct(F.flatten(F.collect_list("_found"))).alias("_found"))
    each = layer(each, _level=F.coalesce(F.array_max(F.transform("_found", lambda x: x["severity"])), F.lit(INFO)))
    mine = F.transform(F.filter("_found", lambda x: x["severity"] == F.col("_level")), lambda x: x["reason"])
    word = F.coalesce(*[F.when(F.col("_level") == level, w) for level, w in _LEVELS.items()])
    return each.select(*dict.fromkeys([group, *key, "uid"]), word.alias("disposition"), F.array_sort(mine).alias("reasons"))


def disposition_reasons(found: DataFrame, group: str = "arm") -> DataFrame:
    """Rows per (group, disposition, reason) of `disposition_rows`; a row with two reasons counts for both, a clean one for none."""
    each = found.select(group, "disposition", F.explode("reasons").alias("reason"))
    return each.groupBy(group, "disposition", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def attribute_names(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Payload keys the type does not define. Distinct (type, key) pairs are judged, rows are only counted."""
    keys = rows.select("sampletype", F.explode(F.map_keys("attrs")).alias("field"))
    counted = keys.groupBy("sampletype", "field").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(fields.select("sampletype", "field"), ["sampletype", "field"], "left_anti").select(
        F.lit("VALIDATION_ATTRIBUTE_NAME").alias("type"),
        F.concat(F.lit("'"), "field", F.lit("' is not a defined attribute for SampleType '"), "sampletype",
                 F.lit("'")).alias("message"),
        "n_rows",
    )


def ontology_violations(rows: DataFrame, ontology: DataFrame) -> DataFrame:
    """Values of controlled fields that the vocabulary `ontology(field, value)` does not hold, per file."""
    fields = ontology.select("field").distinct()
    cells = rows.select("file", F.explode("attrs").alias("field", "value")).where(~t.is_blank("value"))
    used = cells.join(fields, "field", "left_semi").groupBy("file", "field", "value").agg(
        F.count(F.lit(1)).alias("n_rows"))
    return used.join(ontology.select("field", "value").distinct(), ["field", "value"], "left_anti")


def rejected_files(rows: DataFrame, ontology: DataFrame) -> DataFrame:
    """Every file with its verdict: one violation rejects the file."""
    bad = ontology_violations(rows, ontology).groupBy("file").agg(F.count(F.lit(1)).alias("n_bad"))
    return rows.select("file").distinct().join(bad, "file", "left").select(
        "file", F.coalesce("n_bad", F.lit(0)).cast("bigint").alias("n_bad"), F.col("n_bad").isNotNull().alias("rejected")
    )


def names_in_use(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (type, name) is already taken."""
    return rows.join(existing.select("sampletype", "name").distinct(), ["sampletype", "name"], "left_semi")


def literal_violations(rows: DataFrame, literals: dict[str, list[str]]) -> DataFrame:
    """Deposit cells that differ from the literals a form accepts; case and words count."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value"), (~F.col(f"`{f}`").isin(*ok)).alias("bad"))
        for f, ok in literals.items()
    ])
    cells = rows.select(F.inline(pairs)).where("bad")
    return cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def edge_violations(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Parent and child types that the table of allowed edges does not connect."""
    pairs = edges.groupBy("parent_type", "child_type").agg(F.count(F.lit(1)).alias("n_edges"))
    return pairs.join(allowed.select("parent_type", "child_type").distinct(), ["parent_type", "child_type"], "left_anti")


def structure_check(
    rows: DataFrame, fields: DataFrame, columns: Sequence[str] = FLAT_REQUIRED, headers: Sequence[str] | None = None
) -> DataFrame:
    """Whether a batch is well-formed, per file: required columns there, no header twice, attribute names defined."""
    heads = list(headers if headers is not None else rows.columns)
    low = [h.strip().lower() for h in heads]
    broken = sum(c not in low for c in columns) + len({h for h in low if low.count(h) > 1})
    keys = rows.select("file", "sampletype", F.explode(F.map_keys("attrs")).alias("field"))
    counted = keys.groupBy("file", "sampletype", "field").agg(F.count(F.lit(1)).alias("n"))
    bad = counted.join(fields.select("sampletype", "field").distinct(), ["sampletype", "field"], "left_anti")
    per_file = bad.groupBy("file").agg(F.count(F.lit(1)).alias("n_names"))
    n = (F.coalesce("n_names", F.lit(0)) + broken).cast("bigint")
    return rows.select("file").distinct().join(per_file, "file", "left").select(
        "file", n.alias("n_errors"), (n == 0).alias("valid")
    )


def header_faults(headers: DataFrame, columns: Sequence[str] = FLAT_REQUIRED) -> DataFrame:
    """(file, n_missing, n_repeated) of `headers(file, header array)`: required columns a file lacks, and names it has more than once,
    case and outer blanks aside."""
    low = F.filter(F.transform("header", lambda h: F.lower(t.norm(h))), lambda h: h != "")
    named = headers.select("file", low.alias("low"))
    lost = sum((F.when(F.array_contains("low", c), 0).otherwise(1) for c in columns), F.lit(0))
    again = F.size(F.filter(F.array_distinct("low"), lambda h: F.size(F.filter("low", lambda x: x == h)) > 1))
    return named.select("file", lost.cast("bigint").alias("n_missing"), again.cast("bigint").alias("n_repeated"))


def batch_structure(headers: DataFrame, rows: DataFrame, fields: DataFrame, columns: Sequence[str] = FLAT_REQUIRED) -> DataFrame:
    """Whether every file of a batch is well-formed, and the batch as a whole: (file, n_missing, n_repeated, n_names, valid).

    `headers(file, header)` has the header of every file, `rows` the prepared rows; `n_names` counts distinct payload keys that
    their type does not define. The row with a null file is the batch: sums over its files, valid if all of them are.
    """
    keys = rows.select("file", "sampletype", F.explode(F.map_keys("attrs")).alias("field")).groupBy("file", "sampletype", "field").agg(
        F.count(F.lit(1)).alias("n"))
    bad = keys.join(fields.select("sampletype", "field").distinct(), ["sampletype", "field"], "left_anti")
    names = bad.groupBy("file").agg(F.count(F.lit(1)).alias("n_names"))
    per = header_faults(headers, columns).join(names, "file", "left").withColumn("n_names", F.coalesce("n_names", F.lit(0)).cast("bigint"))
    per = per.withColumn("valid", F.col("n_missing") + F.col("n_repeated") + F.col("n_names") == 0)
    whole = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_missing", "n_repeated", "n_names")],
                    F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"))
    return per.unionByName(whole.select(F.lit(None).cast("string").alias("file"), "*"))


def error_groups(errors: DataFrame) -> DataFrame:
    """Errors that share (type, message): how many, and on how many distinct rows and uids."""
    return errors.groupBy("type", "message").agg(
        F.count(F.lit(1)).alias("n_errors"), F.count_distinct(*row_key(errors)).alias("n_rows"),
        F.count_distinct(t.filled("uid")).alias("n_uids"),
    )


def error_members(errors: DataFrame) -> DataFrame:
    """The distinct affected rows behind each group, one per row; whole-file errors have none."""
    return errors.where(F.col("row_n").isNotNull()).select("type", "message", *row_key(errors), "uid").distinct()
