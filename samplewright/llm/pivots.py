"""SimHash near-duplicates, linked with tables of Hamming distances to reference fingerprints.

Every distinct fingerprint gets its distances to a fixed set of references (pivots). By the triangle inequality two
fingerprints within `radius` differ by at most `radius` in every coordinate, so a pair with a larger difference anywhere is
discarded unseen. To avoid looking at all pairs, the references come in families: one centre, and for each of four blocks
of 16 bits, references that differ from the centre inside that block only. The difference of the distances to such a
reference and to the centre depends on the block alone. Two differing bits touch at most two blocks, so any linked pair has
equal differences throughout some two blocks; those differences are the join key. The survivors are verified bit by bit.

A key shared by very many fingerprints would mean a square of pairs. Keys with more than `dense` of them take another exact way:
two fingerprints are within 2 bits if and only if some value is within 1 bit of both, so each emits its 65 neighbours and is
tied to the smallest fingerprint that emits the same one. No pair is lost and rows stay linear in the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import texts
from samplewright.llm.components import components
from samplewright.llm.simhash import as_hex, distance, fingerprints
from samplewright.session import cut

BLOCKS = 4
WIDTH = 16
RADIUS = 2
PER_BLOCK = 12
FREE = 15
_MULTIPLIER = 0x9E3779B97F4A7C15


def _random_bits(n: int, seed: int) -> list[int]:
    """`n` words of 64 bits from a counter, always the same."""
    out, x = [], seed
    for _ in range(n):
        x = (x + _MULTIPLIER) & ((1 << 64) - 1)
        y = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
        y = (y ^ (y >> 27)) * 0x94D049BB133111EB & ((1 << 64) - 1)
        out.append(y ^ (y >> 31))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(per_block: int = PER_BLOCK, free: int = FREE, seed: int = 11) -> tuple[int, list[list[int]], list[int]]:
    """The centre, the references of each block, and references that differ anywhere."""
    centre, *rest = _random_bits(1 + BLOCKS * per_block + free, seed)
    low = (1 << WIDTH) - 1
    family = [[centre ^ ((word & low) << (WIDTH * b)) for word in rest[b * per_block:(b + 1) * per_block]] for b in range(BLOCKS)]
    return centre, family, rest[BLOCKS * per_block:]


def distance_table(fps: DataFrame) -> DataFrame:
    """`fingerprint`, `near` (distances to the free references) and `d0` … `d3` (differences within each block)."""
    centre, family, free = pivots()
    to = lambda p: distance(F.col("fingerprint"), F.lit(_signed(p)))
    base = fps.select("fingerprint", to(centre).alias("_centre"))
    return base.select(
        "fingerprint", F.array(*[to(p).cast("tinyint") for p in [centre, *free]]).alias("near"),
        *[F.xxhash64(*[(to(p) - F.col("_centre")).cast("tinyint") for p in block]).alias(f"d{b}") for b, block in enumerate(family)])


def farthest(a: Column, b: Column) -> Column:
    """The largest coordinate difference of two rows of the distance table."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def links(fps: DataFrame, dense: int = 64) -> DataFrame:
    """Links (a > b) that join every two fingerprints within two bits into one component. `fps` has distinct `fingerprint`s.

    Outside dense keys these are all pairs within two bits; in dense keys they are enough of them to connect the same rows.
    """
    held = cut(distance_table(fps))
    tables = F.array(*[
        F.struct(F.xxhash64(F.lit(t), f"d{i}", f"d{j}").alias("key")) for t, (i, j) in enumerate(combinations(range(BLOCKS), 2))])
    keyed = held.select("fingerprint", "near", F.inline(tables))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    few = shared.where(F.col("n") <= dense)
    other = few.select("key", F.col("fingerprint").alias("b"), F.col("near").alias("_near"))
    sparse = (
        few.join(other, "key").where(F.col("fingerprint") > F.col("b"))
        .where(farthest(F.col("near"), F.col("_near")) <= RADIUS)
        .where(distance(F.col("fingerprint"), F.col("b")) <= RADIUS)
        .select(F.col("fingerprint").alias("a"), "b"))
    many = shared.where(F.col("n") > dense).select("fingerprint").distinct()
    around = F.array(F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    spots = many.select("fingerprint", F.explode(around).alias("spot"))
    least = spots.groupBy("spot").agg(F.min("fingerprint").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    crowd = spots.join(least, "spot").where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return sparse.unionAll(crowd).distinct()


def grouped(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, `mark` (a hash of the text), fingerprint, component_id and the `keep`er of its
    component: the smallest doc_id there (nulls last), and of its texts the one with the smallest mark."""
    rows = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("_row"))
    held = cut(fingerprints(rows, ["_row", "doc_id", "mark"], "text", shingle).select("doc_id", "mark", "fingerprint"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    classes = cut(held.groupBy("fingerprint").agg(first.alias("keep")))
    linked = components(links(classes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    rooted = classes.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("keep").alias("least")), "root").select("fingerprint", F.col("least").alias("keep"))
    return held.join(named, "fingerprint").withColumn("component_id", F.col("keep.doc_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable by links.

    Texts without words have fingerprint 0 and are linked like any other. Equal texts are one fingerprint from the start, so
    a large group of copies costs one row in the linking. Rows with a null doc_id are kept; they never name a component
    unless it holds no other (it is null then).
    """
    return grouped(docs, shingle).select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of `docs`, one per component: the one with the smallest doc_id. Of rows that repeat both its id and its text
    one stays. All columns are kept as they are, whatever their names."""
    found = grouped(docs, shingle)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("mark") == F.col("keep.mark")))).distinct()
    none, same = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    keys = ["_sw_none", "_sw_id", "_sw_mark"]
    gone = gone.select(none.alias(keys[0]), same.alias(keys[1]), F.col("mark").alias(keys[2]))
    tagged = docs.withColumns({keys[0]: none, keys[1]: same, keys[2]: F.xxhash64(F.coalesce("text", F.lit("")))})
    return tagged.join(gone, keys, "left_anti").dropDuplicates(keys).select(*docs.columns)
