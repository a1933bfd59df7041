"""Phrase collocations by SON partitioning.

The documents of each language are dealt into a few shards. Every shard is mined completely, first words, then pairs, then all
longer phrases, at a support lowered in proportion to its share of the language's text: a phrase that reaches the support in the language reaches the lowered
one in some shard, because the lowered supports, each rounded up, add up to less than the support plus the number of shards. The
phrases frequent in any shard are the candidates, and one pass over all texts counts every candidate exactly.

A shard is a share of the documents, not a task: its texts are read by as many tasks as there are, and its counts meet in a
shuffle by (language, shard, phrase). So the number of shards stays small at every size. With a shard per task the lowered support
would be one on any large table, and nothing would be pruned.

While a shard is mined, a phrase goes by a hash, hashes are shuffled in packed runs, and what is frequent is handed to the tasks as
a bit set of at most 2^30 bits. Two phrases that share a hash or a bit only make a candidate more. The counts of the last pass are kept by the words
themselves, so the result does not depend on hashes.

Defined cases: a null text is empty, a null language is `und`; empty texts and pieces have no words; repeated rows count each
time; a text of any length is read whole; an empty table gives no rows; a null or repeated doc_id only decides on a shard; columns
other than doc_id, text and lang are left behind. Phrases with equal score and count are ranked by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import bucket_of, cut_points
from samplewright.llm.words import portions
from samplewright.operators.ranking import first_rows
from samplewright.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, salted_join
from samplewright.session import cut

SUPPORT = 30
LONGEST = 4
SHARDS = 4
TOP = 2000
COVER = (80, 100)
SCALE = 2_000_000
MOST_BITS = 30
PORTION = 2 << 20
PHRASE_PORTION = 1 << 20  # of the last pass, which makes texts of all phrases: in a table of copies every phrase is frequent
ROWS = 1 << 16  # rows of a batch that a task passes on at most
HELD = 2_000_000  # hashes and counts that a task holds before it passes them on
BUCKET = 15  # Spark's bitmap functions cut a bit set into rows of 2^15 bits

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = _BLANK
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a portion of texts: index into `names`, text number and piece number of each."""

    names: pa.LargeStringArray
    at: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def run(self, length: int) -> np.ndarray:
        """Positions from which `length` words follow one another in one piece."""
        last = np.arange(max(0, len(self.at) - length + 1))
        return last[self.piece[last] == self.piece[last + length - 1]]


def split(texts: pa.Array) -> Words:
    """Words of all texts, found on their bytes: every sign that parts words or pieces is one byte in UTF-8."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    kind = _CLASS[data]
    inside = kind == _WORD
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    tails = bounds[1:][bounds[1:] > 0] - 1
    opens[heads], closes[tails] = inside[heads], inside[tails]
    start = np.flatnonzero(opens)
    offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(closes) + 1 - start)))
    text = np.searchsorted(bounds, start, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == _BREAK), start) + text
    letters = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    coded = words.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, piece)


def _portions(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Portions of texts of about `size` bytes, `PORTION` if not given; a text longer than a portion comes in several rows, parted at a sign between pieces, so that no phrase is
    cut. Only a piece that is itself longer stays whole."""
    size = size or PORTION
    for batch in portions(batches, "text", size):
        if batch.num_rows > 1 or batch.column("text").nbytes <= 2 * size:
            yield batch
            continue
        data = np.frombuffer(batch.column("text")[0].as_buffer(), np.uint8)
        breaks = np.flatnonzero(_CLASS[data] == _BREAK) + 1
        at = 0
        while at < len(data):
            stop = int(np.searchsorted(breaks, at + size))
            end = int(breaks[stop]) if stop < len(breaks) else len(data)
            text = pa.array([data[at:end].tobytes().decode("utf-8", "surrogatepass")], pa.string())
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)
            at = end


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))


def _longer(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its first words and its last word."""
    h = (head ^ (head >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class BitSet:
    """Which of 2^bits hash prefixes occur."""

    bits: int
    data: bytes

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return (np.frombuffer(self.data, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_set(rows: DataFrame, key: Column) -> BitSet:
    """The bit set of a 64-bit key: 16 bits a row, at least 2^15 and at most 2^30 bits. Its rows of 4 KB are all that reaches
    the driver, 128 MB at most."""
    bits = min(MOST_BITS, max(BUCKET, ceil(log2(16 * max(rows.count(), 1)))))
    at = F.shiftrightunsigned(key, 64 - bits) + 1
    packed = rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("set"))
    data = bytearray(1 << (bits - 3))
    for row in packed.toLocalIterator():
        data[(row["bucket"] - 1) << (BUCKET - 3):row["bucket"] << (BUCKET - 3)] = row["set"]
    return BitSet(bits, bytes(data))


def _walk(words: Words, seed: np.ndarray, sets: list[BitSet], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length, the positions of the phrases whose parts, one word shorter, may be frequent, and the phrases' hashes.

    `sets` tells what is frequent of the first lengths; of longer ones every phrase met so far may be."""
    word = h = _hashes(words.names)[words.at]
    may, known = np.arange(len(word)), None
    for length in range(1, longest + 1):
        if length > 1:
            may = words.run(length)
            may = may[known[may] & known[may + 1]]
            longer = np.zeros_like(word)
            longer[may] = _longer(h[may], word[may + length - 1])
            h = longer
        yield length, may, h[may]
        known = np.zeros(len(word), bool)
        known[may] = sets[length - 1].holds(h[may] ^ seed[may]) if length <= len(sets) else True


@dataclass(frozen=True)
class Packing:
    """How hashes travel: their first `bits` bits, in runs by their first `head` bits, each run sorted and written as differences."""

    bits: int
    head: int

    def pack(self, h: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(run, differences, counts) of sorted different hashes. A run's differences are as wide as its largest."""
        run = (h >> np.uint64(64 - self.head)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        low = h >> np.uint64(64 - self.bits)
        gaps = np.diff(low, prepend=np.uint64(0))
        gaps[heads] = low[heads] - (run[heads].astype(np.uint64) << np.uint64(self.bits - self.head))
        for at, end in zip(heads.tolist(), [*heads[1:].tolist(), len(h)], strict=True):
            yield int(run[at]), _narrow(gaps[at:end]), _narrow(n[at:end].astype(np.uint64))

    def unpack(self, run: int, gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        low = np.cumsum(_widened(gaps), dtype=np.uint64) + (np.uint64(run) << np.uint64(self.bits - self.head))
        return low << np.uint64(64 - self.bits), _widened(counts).astype(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """A byte that tells the width, then every value in so many bytes."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widened(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8)[1:].reshape(-1, data[0])
    whole = np.zeros((len(parts), 8), np.uint8)
    whole[:, :data[0]] = parts
    return whole.view("<u8").ravel()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order and the sums of their counts."""
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h, n = h[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[heads], np.add.reduceat(n, heads)


def _shard_counts(lengths: range, sets, packing: Packing):
    """(lang, shard, seed, text) to packed counts of the phrases of the given lengths: (lang, shard, run, gaps, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sets.value if sets else []
        kept = np.uint64((1 << 64) - (1 << (64 - packing.bits)))
        held: dict[tuple, list] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, shard), parts in held.items():
                rows = list(packing.pack(*(_summed(parts) if len(parts) > 1 else parts[0])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows), pa.string()), pa.array([shard] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                     pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "shard", "run", "gaps", "counts"])
            held.clear()

        for batch in _portions(batches):
            words = split(batch.column("text"))
            _, first, group = np.unique(batch.column("seed").to_numpy(), return_index=True, return_inverse=True)
            seed = batch.column("seed").to_numpy().view(np.uint64)[words.text]
            langs, shards = batch.column("lang").take(pa.array(first)).to_pylist(), batch.column("shard").take(pa.array(first)).to_pylist()
            for length, at, h in _walk(words, seed, known, lengths[-1]):
                if length not in lengths:
                    continue
                of = group[words.text[at]]
                order = np.argsort(of, kind="stable")
                for g, part in zip(*_segments(of[order], h[order] & kept), strict=True):
                    part.sort()
                    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    held.setdefault((langs[g], shards[g]), []).append((part[heads], np.diff(np.append(heads, len(part)))))
                    size += len(heads)
            if size > HELD:
                for key, parts in held.items():
                    held[key] = [_summed(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if 2 * size > HELD:
                    yield from told()
                    size = 0
        yield from told()
    return run


def _frequent(shards: int, support: int, packing: Packing):
    """Packed counts of one language and run to (lang, shard, h) of what is frequent in a shard and may reach the support."""
    def run(table: pa.Table) -> pa.Table:
        least = table.column("least")[0].as_py()
        found = [[] for _ in range(shards)]
        at = table.column("run")[0].as_py()
        for shard, gaps, counts in zip(*(table.column(c).to_pylist() for c in ("shard", "gaps", "counts")), strict=True):
            found[shard].append(packing.unpack(at, gaps, counts))
        every = [_summed(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for parts in found]
        h = np.unique(np.concatenate([e[0] for e in every]))
        most, over = np.zeros(len(h), np.int64), []
        for (own, n), low in zip(every, least, strict=True):
            # A phrase not counted in a shard has a part that is rare there: it has fewer occurrences than the lowered support.
            here = np.full(len(h), low - 1)
            here[np.searchsorted(h, own)] = n
            most += here
            over.append(np.isin(h, own[n >= low], assume_unique=True))
        shard, place = np.nonzero(np.array(over) & (most >= support))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(place), pa.string()), "shard": pa.array(shard.astype(np.int32)),
                         "h": pa.array(h[place].view(np.int64))})
    return run


def _segments(code: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The codes of a sorted array, and the values of each."""
    if not len(code):
        return code, []
    heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[heads], np.split(values, heads[1:])


def _exact_counts(sets, longest: int):
    """(lang, seed, text) to (lang, size, phrase, n) of the candidates in each portion; size 0 has the number of words.

    Inside a portion a phrase is known by the number of its first words and its last word, so no two are taken for one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates = sets.value
        for batch in _portions(batches, PHRASE_PORTION):
            words = split(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text]
            seed = batch.column("seed").to_numpy().view(np.uint64)[words.text]
            word = _hashes(words.names)[words.at]
            names = langs.dictionary
            total = np.bincount(lang, minlength=len(names))
            yield _counted(names, np.arange(len(names)), 0, pa.array([""] * len(names), pa.large_string()), total)
            h, number, known = word, lang, np.ones(len(word), bool)
            for size in range(1, longest + 1):
                may = words.run(size)
                if size > 1:
                    may = may[known[may] & known[may + 1]]
                    longer = np.zeros_like(word)
                    longer[may] = _longer(h[may], word[may + size - 1])
                    h = longer
                may = may[candidates.holds(h[may] ^ seed[may])]
                pair = number[may] * len(words.names) + words.at[may + size - 1]
                _, first, back, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                known, numbered = np.zeros(len(word), bool), np.zeros(len(word), np.int64)
                known[may], numbered[may] = True, back
                number = numbered
                for some in range(0, len(first), ROWS):
                    at = may[first[some:some + ROWS]]
                    parts = [words.names.take(pa.array(words.at[at + j])) for j in range(size)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
                    yield _counted(names, lang[at], size, phrase, n[some:some + ROWS])
    return run


def _counted(langs: pa.Array, lang: np.ndarray, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(lang)).cast(pa.string()), pa.array(np.full(len(lang), size, np.int32)), phrase.cast(pa.string()), pa.array(n.astype(np.int64))],
        ["lang", "size", "phrase", "n"])


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """lang, shard, text. Shards are ranges of doc_id: tables are mostly laid out by id, so a task meets few shards and counts
    each word of its texts once."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return ids.select("lang", bucket_of(F.col("doc_id"), cut_points(ids, "doc_id", shards)).alias("shard"), "text")


def lowered_supports(dealt: DataFrame, support: int, shards: int) -> DataFrame:
    """`lang`, its `size` in bytes, and `least`: for each shard, support x (its share of the bytes), rounded up, and at least one."""
    share = dealt.groupBy("lang", "shard").agg(F.sum(F.octet_length("text").cast("decimal(20,0)")).alias("size"))
    by_shard = share.groupBy("lang").agg(F.sum("size").alias("_all"), F.map_from_entries(F.collect_list(F.struct("shard", "size"))).alias("_sizes"))
    here = F.coalesce(F.try_element_at("_sizes", F.col("_s")), F.lit(0))
    rows = by_shard.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    least = F.when(F.col("_all") > 0, F.greatest(F.lit(1), F.ceil(here * support / F.col("_all")))).otherwise(1).cast("bigint")
    gathered = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(F.col("_s"), least.alias("v")))).alias("_l"), F.max("_all").alias("size"))
    return gathered.select("lang", F.transform("_l", lambda x: x["v"]).alias("least"), "size")


def frequent_in_a_shard(dealt: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> list[DataFrame]:
    """Written tables (lang, shard, h) of all phrases that reach their shard's lowered support and may reach the support in the
    language: of single words, of pairs, and of all longer ones, which one pass counts together where all their pairs are frequent."""
    spark = dealt.sparkSession
    least = cut(lowered_supports(dealt, support, shards))
    size = least.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("lang") + 8 * shards + 64).alias("bytes"), F.sum("size").alias("text")).first()
    small = size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    packing = packing_for(int(size["text"] or 0))
    keyed = dealt.select("lang", "shard", F.xxhash64("lang", "shard").alias("seed"), "text")
    found: list[DataFrame] = []
    sets: list[BitSet] = []
    for lengths in (range(1, 2), range(2, 3), range(3, longest + 1)):
        shared = spark.sparkContext.broadcast(list(sets)) if sets else None
        packed = keyed.mapInArrow(_shard_counts(lengths, shared, packing), "lang string, shard int, run int, gaps binary, counts binary")
        # One row per language: broadcast within a checked size, else hot languages are salted.
        slim = least.select("lang", "least")
        known = packed.join(F.broadcast(slim), "lang") if small else salted_join(packed, slim, "lang")
        found.append(cut(known.groupBy("lang", "run").applyInArrow(_frequent(shards, support, packing), "lang string, shard int, h bigint")))
        if shared:
            shared.destroy()  # the counts are written; the workers go on to the next pass without these sets
        if lengths[-1] < 3:
            sets.append(bit_set(found[-1], F.col("h").bitwiseXOR(F.xxhash64("lang", "shard"))))
    return found


def packing_for(size: int) -> Packing:
    """Hashes get as many bits as tell the phrases of `size` bytes of text apart, with eleven to spare. Eight runs at least, and one
    per 4 MB of text, so that a run's counts are few enough to be summed in one place."""
    return Packing(min(64, max(32, size.bit_length() + 11)), min(30, max(3, (size >> 22).bit_length())))


def exact_counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, size, phrase, n): every phrase of up to `longest` words with n >= support occurrences; size 0 is all words."""
    if longest < 3:
        raise ValueError("phrases of up to three words at least")
    dealt, candidates = _dealt(docs, shards), None
    for part in frequent_in_a_shard(dealt, support, longest, shards):
        part = part.select("lang", "h").distinct()
        candidates = part if candidates is None else candidates.unionAll(part)
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(candidates, F.col("h").bitwiseXOR(F.xxhash64("lang"))))
    keyed = dealt.select("lang", F.xxhash64("lang").alias("seed"), "text")
    counted = keyed.mapInArrow(_exact_counts(shared, longest), "lang string, size int, phrase string, n bigint")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= support))


def _wide(n: str) -> Column:
    return F.col(n).cast("decimal(20,0)")


def weakness() -> Column:
    """Score of a cut: twice the share of `a` in `l` + `r`, in millionths, rounded down."""
    return F.expr(f"cast(cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")


def _key(phrase: Column | str) -> Column:
    """Language and phrase as one text: a phrase has no line break, so the last one parts the two."""
    return F.concat("lang", F.lit("\n"), phrase)


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, top: int = TOP) -> DataFrame:
    """The first `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    `a` counts the phrase, `l` and `r` the parts of its weakest cut, `n` all words of the language. A phrase goes if a longer
    one that holds it has at least four fifths of its count.
    """
    counts = cut(exact_counts(docs, support, longest, shards))
    phrases = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    known = counts.where(f"size between 1 and {longest - 1}")
    known = known.select(_key("phrase").alias("part"), F.col("n").alias("f"))

    def text(at: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", at, length), " ")

    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "size", "a", "words", k)
    cuts = cuts.select("lang", "phrase", "a", "k", _key(text(F.lit(1), F.col("k"))).alias("first"),
                       _key(text(F.col("k") + 1, F.col("size") - F.col("k"))).alias("rest"))
    both = salted_join(cuts, known.toDF("first", "l"), "first")
    both = salted_join(both, known.toDF("rest", "r"), "rest")
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(weakness().alias("score"), "k", "l", "r")).alias("cut"))

    lengths = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length")
    inner = phrases.where("size > 2").select("lang", "words", "size", F.col("a").alias("longer"), lengths)
    inner = inner.select("lang", "words", "longer", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("at"))
    inner = inner.groupBy("lang", text(F.col("at"), F.col("length")).alias("phrase")).agg(F.max("longer").alias("longer"))
    covered = F.coalesce(_wide("longer") * COVER[1] >= _wide("a") * COVER[0], F.lit(False))
    open_ = weakest.join(inner, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "cut.*")

    ranked = first_rows(open_, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], top)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
