"""SimHash document fingerprints, and a search for all fingerprints within a Hamming radius.

Everything here is DataFrame expressions. A text's terms are exploded and every term votes, with its weight, on each of the 64
bits of the fingerprint. Two bits share a long: the votes on bit k and bit k + 32 are the low and the high half of one sum, so
32 plain `sum` aggregates, combined before the shuffle, hold all votes. A term's weight is at most its length and a text has
less than 2^31 characters, so no half can run over.

Defined cases: a null text is the empty text; a text without terms has fingerprint 0; texts with fewer words than a shingle
has are one term; repeated terms vote again; equal texts have equal fingerprints whatever else the rows hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.llm.common import bucket_count, bucket_of, cut_points, texts
from samplewright.session import cut

BITS = 64
RADIUS = 3
_BLANKS = "\t\n\x0b\f\r "
_SPLIT = r"[\x20\x09-\x0D]+"
_PAIR = (1 << 32) + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs without blanks; an empty array if there are none."""
    bare = F.btrim(F.translate(text, UPPER, LOWER), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def term_rows(df: DataFrame, keys: Sequence[str], text: str, shingle: int) -> DataFrame:
    """One row per shingle: `keys` and `term`. A text without words gives one row with an empty term."""
    split = df.select(*keys, words(F.col(text)).alias("_words"))
    n = F.size("_words")
    lanes = [F.slice("_words", i + 1, n - (shingle - 1)).alias(f"w{i}") for i in range(shingle)]
    short = F.array(F.struct(F.array_join("_words", " ").alias("w0"), *[F.lit(None).cast("string").alias(f"w{i}") for i in range(1, shingle)]))
    rows = split.select(*keys, F.when(n >= shingle, F.arrays_zip(*lanes)).otherwise(short).alias("_rows"))
    # `_rows` is never empty. The outer form keeps the optimizer from filtering on its size, which would split the text again.
    return rows.select(*keys, F.inline_outer("_rows")).select(*keys, F.concat_ws(" ", *[f"w{i}" for i in range(shingle)]).alias("term"))


def flat_weight(term: Column) -> Column:
    """Each term has one vote."""
    return F.when(term == "", 0).otherwise(1).cast("bigint")


def length_weight(term: Column) -> Column:
    """Long terms are rare terms: a term has a vote per character, 16 at most."""
    return F.least(F.char_length(term), F.lit(16)).cast("bigint")


def fingerprints(df: DataFrame, keys: Sequence[str], text: str, shingle: int = 3, weight=flat_weight) -> DataFrame:
    """`keys` (which must tell the rows apart) and `fingerprint`, a bigint. A bit is set if over half of the votes set it."""
    h = F.xxhash64("term")
    ballots = term_rows(df, keys, text, shingle).select(*keys, h.alias("_h"), weight(F.col("term")).alias("_w"))
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_PAIR)) * F.col("_w")).alias(f"_s{k}") for k in range(32)]
    votes = ballots.groupBy(*keys).agg(F.sum("_w").alias("_total"), *sums)

    def bit(k: int) -> Column:
        half = F.shiftrightunsigned(f"_s{k % 32}", 32) if k >= 32 else F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(half * 2 > F.col("_total"), F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))

    return votes.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(BITS)]).alias("fingerprint"))


def as_hex(fingerprint: Column) -> Column:
    """Sixteen lowercase hex digits, the highest bit first."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits: 1 for equal fingerprints, about 0.5 for unrelated ones."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def _with_edits(docs: DataFrame, shingle: int, weight) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the fingerprints of the text, the edited text and the next text, as bigints.

    The next document is the one with the next doc_id (null ids first; equal ids by text); after the last comes the first. The
    rows are dealt into ordered id buckets in one shuffle, which all later steps reuse. Each bucket also gets a copy of the
    first row of the bucket after it, so no window reaches over a bucket's end. Repeated rows follow one another.
    """
    docs = texts(docs)
    cuts = cut_points(docs, "doc_id", bucket_count(docs))
    ids = docs.select("doc_id", bucket_of(F.col("doc_id"), cuts).alias("bucket"))
    # One row per bucket: bounded by the number of cut points.
    heads = ids.groupBy("bucket").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("head"),
                                      F.max(F.col("doc_id").isNull()).alias("none")).orderBy("bucket").collect()
    rank = {row["bucket"]: i for i, row in enumerate(heads)}
    before = [heads[rank[b] - 1]["bucket"] if b in rank else 0 for b in range(len(cuts) + 1)]
    first = [heads[rank[b]]["head"] if b in rank and not heads[rank[b]]["none"] else None for b in range(len(cuts) + 1)]
    bucket = bucket_of(F.col("doc_id"), cuts)
    placed = docs.withColumn("_b", bucket)
    own = F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("ghost"))
    lent = F.struct(F.get(F.lit(before).cast("array<int>"), F.col("_b")).alias("bucket"), F.lit(1).alias("ghost"))
    is_head = F.col("doc_id").eqNullSafe(F.get(F.lit(first).cast("array<bigint>"), F.col("_b")))
    dealt = placed.select("doc_id", "text", F.inline(F.when(is_head, F.array(own, lent)).otherwise(F.array(own))))
    dealt = dealt.repartitionById(len(cuts) + 1, "bucket")  # one task per bucket; hashed, some tasks would get several
    order = W.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    pairs = dealt.select(
        "bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("_next"))
    n = F.char_length("text").cast("bigint")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    pairs = pairs.withColumn("n_chars", n).withColumn("_edited", F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), quarter)))
    pairs = pairs.withColumn("edited_sha256", F.sha2(F.encode("_edited", "UTF-8"), 256))
    keys = ["bucket", "at", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = pairs.select(*keys, F.inline_outer(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("body")))))
    found = fingerprints(both, [*keys, "side"], "body", shingle, weight)
    side = [F.max(F.when(F.col("side") == i, F.col("fingerprint"))).alias(name) for i, name in enumerate(("plain", "changed"))]
    rows = found.groupBy(*keys).agg(*side)
    rows = rows.withColumn("_next", F.lead("plain").over(W.partitionBy("bucket").orderBy("at")))
    return rows.where("ghost = 0").select("doc_id", "n_chars", "edited_sha256", "plain", "changed", F.col("_next").alias("following"))


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("plain")).alias("fingerprint"), as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("plain"), F.col("changed")).alias("near_edited"), likeness(F.col("plain"), F.col("following")).alias("near_next"), *more)


def edited(docs: DataFrame, shingle: int = 2, weight=length_weight) -> DataFrame:
    """Fingerprints of every text, of the text with its last quarter replaced by the start of the next document, and likenesses."""
    return _shown(_with_edits(docs, shingle, weight))


def edited_and_searched(docs: DataFrame, radius: int = RADIUS, every: int = 50, shingle: int = 2, weight=length_weight) -> DataFrame:
    """The rows of `edited`, and `n_within`: for a doc_id divisible by `every`, the number of other rows whose fingerprint is
    within `radius` bits of the row's own, copies included; null for all other rows, and for a null doc_id.

    The fingerprints are written once, and rows with equal ones are one row of the search with their number.
    """
    rows = cut(_with_edits(docs, shingle, weight))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    classes = rows.groupBy(F.col("plain").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.max(asked).alias("asked"))
    found = count_within(classes.where("asked").select("fingerprint"), classes.select("fingerprint", "n"), radius)
    joined = rows.join(found.withColumnRenamed("query", "plain"), "plain", "left")
    return _shown(joined.withColumn("n_within", F.when(asked, F.col("n_within") - 1)), "n_within")


def block_tables(radius: int, blocks: int | None = None) -> list[tuple[int, int]]:
    """Masks of the permuted tables: the fingerprint is cut into `blocks` runs of bits, and each table keeps all but `radius`
    of them. Two fingerprints within the radius agree on at least one table's kept bits."""
    blocks = blocks or radius + 2
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    mask = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(t, signed(sum(mask[b] for b in kept))) for t, kept in enumerate(combinations(range(blocks), blocks - radius))]


def keyed(df: DataFrame, masks: Sequence[tuple[int, int]]) -> DataFrame:
    """The rows of `df`, each once per table; the permuted key is the kept bits."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for t, m in masks])
    return df.select("*", F.inline(tables))


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """All pairs (query, fingerprint, distance) of distinct fingerprints within the radius; both tables have a `fingerprint`.

    Exact at every size: nothing is capped. Copies are reduced first, so a group of equal documents is one row here; join the
    result to the documents by fingerprint. A query's own fingerprint is among its results if the index holds it.
    """
    masks = block_tables(radius, blocks)
    q = keyed(queries.where("fingerprint is not null").select("fingerprint").distinct(), masks).withColumnRenamed("fingerprint", "query")
    x = keyed(index.where("fingerprint is not null").select("fingerprint").distinct(), masks)
    apart = distance(F.col("query"), F.col("fingerprint"))
    return q.join(x, ["t", "key"]).select("query", "fingerprint", apart.alias("distance")).where(F.col("distance") <= radius).distinct()


def count_within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int | None = None, run: int = 1024) -> DataFrame:
    """`query` and `n_within`: for each distinct fingerprint of `queries`, the sum of `n` over all fingerprints of `index`
    (distinct `fingerprint`, `n`) within the radius. Queries without any are left out.

    The same search as `within_radius`, but no pair becomes a row: of a key that many fingerprints share, runs of about `run` of
    them meet each query as one array, in as many tasks as there are runs. A pair that agrees on the kept bits of several
    tables counts in the first. Only keys that a query has are shuffled a second time.
    """
    masks = block_tables(radius, blocks)
    at = ["t", "key"]
    q = cut(keyed(queries.where("fingerprint is not null").select("fingerprint").distinct(), masks)).withColumnRenamed("fingerprint", "query")
    hit = cut(keyed(index.where("fingerprint is not null").select("fingerprint", "n"), masks).join(q.select(*at).distinct(), at, "left_semi"))
    large = hit.groupBy(*at).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > run)
    part = F.pmod(F.xxhash64("fingerprint"), F.coalesce(F.ceil(F.col("size") / run), F.lit(1))).alias("part")
    runs = hit.join(large, at, "left").select(*at, "fingerprint", "n", part).groupBy(*at, "part").agg(
        F.collect_list(F.struct("fingerprint", "n")).alias("members"))
    kept = F.lit([mask for _, mask in masks])

    def near(member: Column) -> Column:
        differ = member["fingerprint"].bitwiseXOR(F.col("query"))
        seen = F.exists(F.slice(kept, F.lit(1), F.col("t")), lambda mask: differ.bitwiseAND(mask) == 0)
        return (F.bit_count(differ) <= radius) & ~seen

    total = F.aggregate(F.filter("members", near), F.lit(0).cast("bigint"), lambda sum_, member: sum_ + member["n"])
    return q.join(runs, at).select("query", total.alias("n")).groupBy("query").agg(F.sum("n").alias("n_within"))
