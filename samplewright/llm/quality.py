"""Quality scores by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words (runs of letters and digits, and runs of signs, in lower case) and its pairs of neighbouring
words, hashed into 2^18 places. A word next to itself, or with one word between, is one feature whatever the word. A feature's
value is its share of the text's features, so length does not matter. A score is one sparse dot product. Weights are learned from a bounded sample of labelled rows, one row at a time, by FTRL-proximal
updates with L1, so that places seen rarely stay at zero.

Defined cases: a null text is empty; a text without words scores what the bias says; a text of any length is read whole, and its score
does not depend on its length; rows that repeat are scored each time and train once; rows tie in the sample by hash and then by key;
an empty table, or no label, gives the score 0.5 to every text. `keep_good` treats null and empty texts by their score like any other.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm import words
from samplewright.llm.common import texts

PLACES = 1 << 18
#: Bytes of text worked on at a time, and words remembered: what bounds a worker's memory.
PORTION, WORDS = 3 << 20, 100_000
SCALE = 16.0
#: Labelled rows that training reads at most; the first ones in the order of a hash of their id.
SAMPLE = 6000
FOLDS = 5
CUT = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Features:
    """Hashed n-grams of whole texts. Words are hashed once and remembered."""

    def __init__(self):
        self.memory = words.Memory(self._make, WORDS)

    @staticmethod
    def _make(some: list[str]) -> list[bytes]:
        return [array("I", [zlib.crc32(t.encode()) for t in _TOKEN.findall(w.lower())]).tobytes() for w in some]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all features, and for each the number of its text."""
        different, index, starts = words.split(column)
        hashes, bounds = words.gather(self.memory.get(different), index, starts)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        hashes = hashes.astype(np.uint64)
        pair = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        inside = text[:-1] == text[1:]
        pair[hashes[:-1] == hashes[1:]] = 1
        again = (text[:-2] == text[2:]) & (hashes[:-2] == hashes[2:])
        mix = np.concatenate((hashes * np.uint64(0xC2B2AE3D27D4EB4F), pair[inside] * np.uint64(0xD6E8FEB86659FD93),
                              np.full(int(again.sum()), 3, np.uint64) * np.uint64(0xA0761D6478BD642F)))
        return (mix >> np.uint64(46)).astype(np.int64), np.concatenate((text, text[:-1][inside], text[:-2][again]))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, places: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """The dot products of `n` texts, through the logistic function. A text without words has the bias alone."""
        total = np.bincount(text, self.weights[places], n)
        size = np.maximum(np.bincount(text, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / size, -35, 35)))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], alpha: float = 1.0, beta: float = 1.0,
          l1: float = 0.02, l2: float = 0.01, epochs: int = 3, seed: int = 1) -> Model:
    """FTRL-proximal: `examples` are places and values. The bias is an unregularised coordinate. No examples: all scores 0.5."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == PLACES, 0, l1), 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + np.where(at == PLACES, 0, l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at = np.append(examples[i][0], PLACES)
            x = np.append(examples[i][1], 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    every = weight(np.arange(PLACES + 1))
    return Model(every[:PLACES], float(every[PLACES]))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; fold 0 is held out. Null ids are in no fold."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in words.portions(batches, "text", PORTION):
        places, text = features.of(batch.column("text"))
        out, values = [], []
        order = np.argsort(text, kind="stable")
        for mine in np.split(places[order], np.searchsorted(text[order], np.arange(1, batch.num_rows))):
            at, count = np.unique(mine, return_counts=True)
            out.append(at.astype("<i4").tobytes())
            values.append((SCALE * count / max(1, count.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(out, pa.binary()), pa.array(values, pa.binary())], ["quality", "places", "shares"])


def _bounded(rows: DataFrame, sample: int) -> DataFrame:
    """One row per doc_id, text and quality, and at most `sample` of them, the first in the order of a hash. They are chosen by their
    keys alone, so each task brings its copies down to chosen rows before a text moves."""
    key = ["doc_id", "_print", "quality"]
    rows = rows.withColumn("_print", F.xxhash64("text"))
    chosen = rows.select(*key).distinct().orderBy(F.xxhash64(*key), *key).limit(sample)
    return rows.join(F.broadcast(chosen), key, "left_semi").groupBy(*key).agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled rows outside fold 0. `labels` has doc_id and quality (1 good, 0 bad, null unused).

    The sample is small by its bound, so it is sent to the documents, which are not shuffled; only the sample's hashed features
    come back. Rows with the same id, text and quality train once, and at most `sample` rows train: the first in the order of a hash.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    picked = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = _bounded(texts(docs).join(F.broadcast(picked), "doc_id"), sample)
    got = rows.select("quality", "text").mapInArrow(_examples, "quality int, places binary, shares binary").collect()
    got.sort(key=lambda r: (r["places"], r["quality"]))  # tasks end in any order
    return train([(np.frombuffer(r["places"], "<i4").astype(np.int64), np.frombuffer(r["shares"], "<f4").astype(float)) for r in got],
                 [r["quality"] for r in got])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        for batch in words.portions(batches, "text", PORTION):
            places, text = features.of(batch.column("text"))
            scores = pa.array(model.scores(places, text, batch.num_rows))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), scores], [*rest, "score"])
    return run


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts(docs).mapInArrow(_scored(shared), "doc_id bigint, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                       F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that score `cut` or more, with all their columns as they are; rows stay where they lie."""
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in words.portions([whole], whole.schema.names[at], PORTION):
                column = batch.column(at).fill_null("")
                places, text = features.of(column)
                yield batch.filter(pa.array(shared.value.scores(places, text, batch.num_rows) >= cut))

    return docs.mapInArrow(run, docs.schema)
