"""Resolution by join: parents, assays, files, rules, identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.operators.ranking import first_by
from samplewright.operators.skew import among, lookup_join
from samplewright.session import stored


def known_uids(upload: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(uid, origin): 0 when the upload holds it, 1 when only the baseline does. One row per uid."""
    own = upload.select(t.filled("uid").alias("uid"), F.lit(0).alias("origin"))
    if baseline is not None:
        own = own.union(baseline.select(t.filled("uid").alias("uid"), F.lit(1).alias("origin")))
    return own.where(F.col("uid").isNotNull()).groupBy("uid").agg(F.min("origin").alias("origin"))


def parent_refs(rows: DataFrame, keep: Sequence[str] = ("row_n", "uid", "sampletype")) -> DataFrame:
    """One row per cited parent; placeholder parents are left out. Reads `parent` and, if there, `attrs`."""
    cell = t.parent_cell("parent", "attrs") if "attrs" in rows.columns else t.filled("parent")
    return rows.select(*keep, F.explode(t.split_list(cell)).alias("parent_uid")).where(~t.holds_any("parent_uid"))


def _cited(rows: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(uids and cited parents of the rows, one row per citation), read from one written table, so that payloads are parsed once."""
    cell = t.parent_cell("parent", "attrs") if "attrs" in rows.columns else t.filled("parent")
    parents = F.filter(t.split_list(cell), lambda p: ~t.holds_any(p))
    held = stored(rows.select(*dict.fromkeys([*keep, "uid"]), parents.alias("_cited")), "cited")
    return held, held.select(*keep, F.explode("_cited").alias("parent_uid"))


def _status() -> Column:
    return F.when(F.col("origin") == 0, "intra").when(F.col("origin") == 1, "baseline").otherwise("missing")


def _status_of(refs: DataFrame, rows: DataFrame, baseline: DataFrame | None) -> DataFrame:
    side = lambda uid, n, origin: (
        uid.alias("parent_uid"), F.lit(n).cast("bigint").alias("n"), F.lit(origin).cast("int").alias("origin"))
    both = refs.select(*side(F.col("parent_uid"), 1, None)).union(rows.select(*side(t.filled("uid"), 0, 0)))
    if baseline is not None:
        both = both.union(baseline.select(*side(t.filled("uid"), 0, 1)))
    known = both.where(F.col("parent_uid").isNotNull()).groupBy("parent_uid").agg(
        F.sum("n").alias("n_refs"), F.min("origin").alias("origin"))
    return known.where("n_refs > 0").select("parent_uid", "n_refs", _status().alias("status"))


def parent_status(rows: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(parent_uid, n_refs, status) for every distinct cited parent.

    Citations and known uids are one table with one aggregate: one shuffle, after a combine in which a hub parent is one row.
    """
    return _status_of(parent_refs(rows, ()), rows, baseline)


def resolve_parents(rows: DataFrame, baseline: DataFrame | None, keep=("row_n", "uid", "sampletype")) -> DataFrame:
    """Every cited parent with its status intra / baseline / missing; the upload wins over the baseline. Payloads are read once:
    uids and citations are written, then tallied and joined from there."""
    held, refs = _cited(rows, keep)
    return lookup_join(refs, _status_of(refs, held, baseline), "parent_uid", count="n_refs")


def parent_tally(rows: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Count of citations per status."""
    return parent_status(rows, baseline).groupBy("status").agg(F.sum("n_refs").alias("n_refs"))


def missing_parents(rows: DataFrame, baseline: DataFrame | None, keep=("row_n", "uid", "sampletype")) -> DataFrame:
    """The citations whose parent is neither in the upload nor in the baseline. Few parents are missing as a rule,
    and then the rows are not shuffled."""
    held, refs = _cited(rows, keep)
    lost = _status_of(refs, held, baseline).where("status = 'missing'").drop("status")
    return lookup_join(refs, lost, "parent_uid", count="n_refs")


def resolve_titles(titles: DataFrame, cache: DataFrame, synonyms: DataFrame, title: str = "title") -> DataFrame:
    """Assay titles to ids in two steps: the cited title itself, else its synonym, else the cited title without an id.

    `cache(title, assay_id)` and `synonyms(cited, canonical)` hold one row per key. Adds `resolved_title`, `assay_id`
    and `how` = direct / synonym / unresolved / blank.
    """
    hit = cache.select(F.col("title").alias("_t1"), F.col("assay_id").alias("_id1"))
    via = (
        synonyms.join(cache.select(F.col("title").alias("canonical"), F.col("assay_id").alias("_id2")), "canonical")
        .select(F.col("cited").alias("_t2"), F.col("canonical").alias("_canonical"), "_id2")
    )
    cited = F.coalesce(F.col(title), F.lit(""))
    return (
        titles.join(hit, F.col(title) == F.col("_t1"), "left").join(via, F.col(title) == F.col("_t2"), "left")
        .select(
            *titles.columns,
            F.when(F.col("_id1").isNotNull(), cited).otherwise(F.coalesce("_canonical", cited)).alias("resolved_title"),
            F.coalesce("_id1", "_id2").alias("assay_id"),
            F.when(cited == "", "blank").when(F.col("_id1").isNotNull(), "direct")
            .when(F.col("_id2").isNotNull(), "synonym").otherwise("unresolved").alias("how"),
        )
    )


def assay_coverage(titles: DataFrame, cache: DataFrame, synonyms: DataFrame) -> DataFrame:
    """How the distinct cited titles resolve: one row per outcome."""
    cited = titles.select("title").where(~t.is_blank("title")).distinct()
    return resolve_titles(cited, cache, synonyms).groupBy("how").agg(F.count(F.lit(1)).alias("n_titles"))


def uncached_titles(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct titles cited in upload sheets that the cache does not hold."""
    cited = rows.select(F.explode(t.split_list("assay_titles")).alias("title")).distinct()
    return cited.join(cache.select("title"), "title", "left_anti")


def lowest_ids(assays: DataFrame, project: DataFrame) -> DataFrame:
    """Title → lowest id among the assays of a project, with the number of ids that share the title."""
    linked = assays.where(~t.is_blank("title")).join(project.select("assay_id").distinct(), "assay_id", "left_semi")
    return linked.groupBy("title").agg(
        F.min("assay_id").alias("assay_id"), F.count_distinct("assay_id").alias("n_ids")
    )


def shared_titles(assays: DataFrame, project: DataFrame) -> DataFrame:
    """The ids behind every title that several assays of the project share, one row each."""
    linked = assays.where(~t.is_blank("title")).join(project.select("assay_id").distinct(), "assay_id", "left_semi")
    ids = linked.select("title", "assay_id").distinct()
    several = ids.groupBy("title").agg(F.count(F.lit(1)).alias("n_ids")).where("n_ids > 1")
    return lookup_join(ids, several.withColumn("_n", F.col("n_ids")), "title", count="_n")


def file_index(rows: DataFrame, order: Sequence[str] = ("sheet_pos", "row_n")) -> DataFrame:
    """(filename, sampletype, uid): the first row that names a file as its primary data."""
    named = rows.withColumn("filename", t.filled("file_primarydata")).where(F.col("filename").isNotNull())
    return first_by(named, ["filename"], list(order), ["sampletype", "uid"])


def match_rules(df: DataFrame, key: str, rules: Sequence[tuple[str, str | None]], name: str = "rule_parent") -> DataFrame:
    """First matching rule wins. A rule may say "no parent" (None); no rule at all gives a placeholder.

    `rules` are (pattern, parent) pairs in order of precedence. They are few and given in code, so they become one
    `when` chain: no join at all. Patterns match from the start of the text.
    """
    anchored = lambda p: "^(?:" + p + ")"  # noqa: E731  also for `^a|b`, whose second half would match anywhere
    chain = None
    for pattern, parent in rules:
        fits = F.col(key).rlike(anchored(pattern))
        value = F.lit(parent).cast("string")
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    miss = F.concat(
        F.lit("*** PLACEHOLDER: no tumor-parent rule matched device_id='"), F.col(key), F.lit("' ***")
    )
    return df.withColumn(name, chain.otherwise(miss) if chain is not None else miss)


def resolve_identifiers(ids: DataFrame, samples: DataFrame) -> DataFrame:
    """UIDs and numeric ids, mixed, to samples. Adds `sample_id` and `uid`, both null when unknown.

    Samples that are not asked for are sifted out where they lie. The others are merged, never broadcast: files of keys are small beside the uids made from them, so the size that the planner
    guesses from the files may let a table of millions of uids pass for a small one, and a broadcast is built on the driver.
    """
    key = t.norm("identifier")
    asked = ids.withColumn("_num", F.when(key.rlike(r"^\d+$"), key.try_cast("bigint"))).withColumn(
        "_uid", F.when(F.col("_num").isNull(), key)
    )
    by_id = samples.select(F.col("sample_id").cast("bigint").alias("_num"), F.col("uid").alias("_uid_a"))
    by_uid = samples.select(F.col("uid").alias("_uid"), F.col("sample_id").alias("_id_b"), F.lit(True).alias("_held"))
    n = ids.count()
    by_id, by_uid = (among(by, key, asked, n).hint("merge") for by, key in ((by_id, "_num"), (by_uid, "_uid")))
    # Each kind meets its own key only, so no null key gathers the other kind in one task.
    numbers = asked.where("_num IS NOT NULL").join(by_id, "_num", "left").select(
        *ids.columns, F.when(F.col("_uid_a").isNotNull(), F.col("_num")).alias("sample_id"), F.col("_uid_a").alias("uid"))
    names = asked.where("_uid IS NOT NULL").join(by_uid, "_uid", "left").select(
        *ids.columns, F.col("_id_b").alias("sample_id"), F.when(F.col("_held"), F.col("_uid")).alias("uid"))  # a sample need not have a number
    kind = dict(samples.select("sample_id", "uid").dtypes)
    blank = asked.where("_num IS NULL AND _uid IS NULL").select(
        *ids.columns, *[F.lit(None).cast(kind[c]).alias(c) for c in ("sample_id", "uid")])
    return numbers.unionAll(names).unionAll(blank)


def alias_uids(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Existing UIDs by name; several spellings may share one UID. `aliases(name, existing_uid)`."""
    return rows.join(aliases.withColumnRenamed("name", key), key, "left")


def mark_existing(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Mark each row `[EXIST]` or `[NEW]` against the master table. Rows without a uid are new and take no part in the join."""
    held = master.select(t.filled("uid").alias("uid"), F.lit(True).alias("_held")).where("uid IS NOT NULL").distinct()
    blank = t.is_blank("uid")
    met = rows.where(~blank).join(held, "uid", "left").select(
        *rows.columns, F.when(F.col("_held"), "[EXIST]").otherwise("[NEW]").alias("mark"))
    return met.unionAll(rows.where(blank).withColumn("mark", F.lit("[NEW]")))


def repair_ids(rows: DataFrame, known: DataFrame, key: str, years: list[str], suffixes: list[str]) -> DataFrame:
    """Match hand-typed ids: as typed, then without suffix noise, then with a sibling year; the best hit wins.

    `known(known_id)` holds distinct ids. Each row has as many candidates as there are years, no more.
    """
    tried = rows.select(key).distinct().select(
        key, F.posexplode(t.candidate_ids(key, years, suffixes)).alias("_rank", "known_id")
    )
    best = tried.join(known.select("known_id").distinct(), "known_id").groupBy(key).agg(
        F.min_by("known_id", "_rank").alias("matched_id"), F.min("_rank").alias("match_rank")
    )
    return rows.join(best, key, "left")
