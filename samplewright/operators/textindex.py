"""An inverted index over sample payloads: trigram posting lists per attribute.

A search first intersects the posting lists of its texts' trigrams, then checks the cells of the rows that are left with the same
condition that a scan would use, so index and scan give the same rows. A text of one or two characters has no trigram; a search
that cannot be narrowed by the others falls back on the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.operators.search import advanced_search
from samplewright.session import scratch_path

GRAM = 3
RUN = 1 << 14  # a frequent trigram has a list per run of row numbers, which are less than this apart
_LISTS = pa.schema([("attr", pa.string()), ("gram", pa.string()), ("run", pa.int64()), ("at", pa.list_(pa.int16()))])


def grams(text: str) -> list[str]:
    """Different trigrams of a text in lower case, as the index has them."""
    low = text.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


class TextIndex:
    """Written once, used by any number of searches. `rows` has the indexed rows, numbered; `lists` the posting lists."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        self.lists = spark.read.parquet(f"{path}/lists")
        self.slots = spark.read.parquet(f"{path}/slots").first()["slots"]

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, slots: int | None = None) -> TextIndex:
        """Index `rows(attrs map, …)`. Lists are laid out by a hash of their trigram in `slots` folders, so a search opens as many
        folders as it has trigrams at most."""
        spark = rows.sparkSession
        path = path or scratch_path(spark, "text-index")
        slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
        held = spark.read.parquet(f"{path}/rows")  # the numbers must not be drawn again
        low = F.transform(F.map_values("attrs"), lambda v: F.lower(v))
        lists = held.select("_id", F.map_keys("attrs").alias("keys"), low.alias("lows")).mapInArrow(
            _posted, "attr string, gram string, run bigint, at array<smallint>")
        placed = lists.withColumn("slot", _slot(F.col("gram"), slots))
        placed.repartition("slot").sortWithinPartitions("slot", "gram", "attr", "run").write.partitionBy("slot").parquet(f"{path}/lists")
        spark.range(1).select(F.lit(slots).alias("slots")).write.parquet(f"{path}/slots")
        return cls(spark, path)

    def _holding(self, text: str, attributes: Sequence[str]) -> DataFrame:
        """(attr, _id) of the cells that hold every trigram of a text: the lists of one run meet in one row."""
        wanted = grams(text)
        spark = self.lists.sparkSession
        slots = [r["s"] for r in spark.range(1).select(F.explode(F.lit(wanted)).alias("g")).select(
            F.explode(F.array(_slot(F.col("g"), self.slots))).alias("s")).distinct().collect()]  # one per trigram of the search
        lists = self.lists.where(F.col("slot").isin(slots) & F.col("gram").isin(wanted))
        if attributes:
            lists = lists.where(F.col("attr").isin(*attributes))
        met = lists.groupBy("attr", "run").agg(F.collect_list("at").alias("_lists")).where(F.size("_lists") == len(wanted))
        both = F.reduce(F.slice("_lists", F.lit(2), F.size("_lists")), F.get("_lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return met.select("attr", "run", F.explode(both).alias("_at")).select("attr", (F.col("run") + F.col("_at")).alias("_id"))

    def _rows_with(self, text: str, attributes: Sequence[str], logic: str) -> DataFrame:
        cells = self._holding(text, attributes)
        if attributes and logic == "AND" and len(set(attributes)) > 1:
            several = cells.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
            return several.where(F.col("n") == len(set(attributes))).select("_id")
        return cells.select("_id").distinct()

    def candidates(self, texts: Sequence[str], attributes: Sequence[str], attribute_logic: str, text_logic: str) -> DataFrame | None:
        """Numbers of the rows that may match, or None if every row may."""
        long = [t for t in texts if len(t.lower()) >= GRAM]
        if not long or (text_logic == "OR" and len(long) < len(texts)):
            return None
        found = [self._rows_with(t, attributes, attribute_logic) for t in long]
        if text_logic == "AND":
            return reduce(lambda a, b: a.join(b, "_id", "left_semi"), found)
        return reduce(DataFrame.union, found).distinct()

    def search(
        self, texts: Sequence[str], sampletypes: Sequence[str] = (), attributes: Sequence[str] = (), match: str = "PARTIAL",
        attribute_logic: str = "OR", text_logic: str = "OR",
    ) -> DataFrame:
        """The rows that `advanced_search` would give, found through the index."""
        near = self.candidates(texts, attributes, attribute_logic, text_logic)
        rows = self.rows if near is None else self.rows.join(near, "_id", "left_semi")
        return advanced_search(rows, texts, sampletypes, attributes, match, attribute_logic, text_logic).drop("_id")


def _slot(gram: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists (attr, gram, run, at) of rows (_id, keys, lows). A run is named by its first row and lies in one batch, so its lists
    are whole without a shuffle of single posts; `at` are the distances of its rows from the first one."""
    for batch in batches:
        ids, start = batch.column("_id").to_numpy(), 0
        while start < len(ids):
            out = np.flatnonzero((ids[start:] < ids[start]) | (ids[start:] - ids[start] >= RUN))
            stop = start + int(out[0]) if len(out) else len(ids)
            part = batch.slice(start, stop - start)
            yield from _lists_of_run(ids[start:stop], part.column("keys"), part.column("lows"))
            start = stop


def _lists_of_run(ids: np.ndarray, keys: pa.ListArray, lows: pa.ListArray) -> Iterator[pa.RecordBatch]:
    per_row = pc.list_value_length(lows).fill_null(0).to_numpy()
    at = np.repeat((ids - ids[0]).astype(np.int16), per_row)
    attrs, texts = keys.flatten().dictionary_encode(), lows.flatten().fill_null("")
    names, attr = attrs.dictionary, attrs.indices.to_numpy()
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    # Code points of all texts one after another; a trigram is three of them in one number.
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    for i, name in enumerate(names.to_pylist()):
        mine = np.flatnonzero((attr == i) & (sizes >= GRAM))
        if not len(mine):
            continue
        count = sizes[mine] - (GRAM - 1)
        ends = np.cumsum(count)
        first = np.arange(ends[-1]) + np.repeat(begins[mine] - (ends - count), count)
        gram = codes[first] << 42 | codes[first + 1] << 21 | codes[first + 2]
        order = np.argsort(gram, kind="stable")  # rows stay in order
        gram, rows = gram[order], np.repeat(at[mine], count)[order]
        fresh = np.append(True, (gram[1:] != gram[:-1]) | (rows[1:] != rows[:-1]))
        gram, rows = gram[fresh], rows[fresh]
        heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        named = gram[heads]
        text = np.stack([named >> 42, named >> 21 & 0x1FFFFF, named & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        n = len(heads)
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * n, pa.string()), pa.array([text[j:j + GRAM] for j in range(0, GRAM * n, GRAM)], pa.string()), pa.array(np.full(n, ids[0])),
            pa.ListArray.from_arrays(pa.array(np.append(heads, len(rows)).astype(np.int32)), pa.array(rows))], schema=_LISTS)
