"""Languages of a document by multilingual mixture inference.

A language is a distribution over hashed letter trigrams, counted over all labelled texts that are not held out. A document is
taken for a mixture of languages and of a background on which every trigram is equally likely (numbers, keys, signs of no language
end up there). Expectation-maximisation finds the proportions that make its trigrams likeliest. The languages, in falling order of
their proportions, give nested sets; each set is fitted again, and the next language joins only while the likelihood, after a charge
per language, still rises. Overlapping trigrams repeat each letter three times, so the likelihood counts a third.

Letters of all scripts and their combining marks are kept, in lower case; everything else is one blank.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text if nothing could be learned; a null doc_id
is in no fold: its row is neither held out nor learned from. Null languages and null texts are not learned from. Of equal proportions
the language first in byte order is taken. Texts are read whole; repeated rows are learned from, and scored, each time; other columns
are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm.words import portions

BITS = 16
PLACES = 1 << BITS
#: Languages that are told apart at most: those with the most trigrams among the labelled texts.
LANGUAGES = 256
FOLDS = 5
SMOOTHING = 0.5
#: Charge for a further language, in units of the logarithm of the number of trigrams.
PENALTY = 1.0
OVERLAP = 3
STEPS = 50
STILL = 1e-3
PORTION = 4 << 20
MOST_ROWS = 1 << 15
LONG = 1 << 22  # characters of a text that is worked on in stretches
_HELD = 32


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; fold 0 is held out. A null id has none."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its lower case, whether it is a letter, and whether it is a letter or a combining mark."""
    signs = [chr(i) for i in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, signs), bool, len(signs))
    mark = np.fromiter((unicodedata.category(c)[0] == "M" for c in signs), bool, len(signs))
    lower = np.arange(len(signs), dtype=np.uint32)
    for i in np.flatnonzero(letter):
        small = signs[i].lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return lower, letter, letter | mark


@dataclass
class Grams:
    """Trigrams of some texts: places and counts, text by text from `starts`; `lettered` tells which texts have a letter."""

    places: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    lettered: np.ndarray

    def of(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[text], self.starts[text + 1])
        return self.places[at], self.counts[at]


def _symbols(signs: np.ndarray, text: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and single blanks of some code points, and the number of their text. `before` tells whether a letter
    stood before the first one."""
    lower, _, kept = _letters()
    keep = kept[signs]
    stay = keep.copy()
    stay[1:] |= keep[:-1] | (text[1:] != text[:-1])
    stay[:1] |= before
    return np.where(keep, lower[signs], np.uint32(32))[stay], text[stay]


def _places(low: np.ndarray) -> np.ndarray:
    """Place of every trigram of a run of symbols."""
    h = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)


def trigrams(texts: list[str | None]) -> Grams:
    """Trigrams of at most 2^15 texts, each with a blank before and after; runs of other signs are one blank."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > LONG:
        return _trigrams_of_long(texts[0])
    whole = [f" {t or ''} " for t in texts]
    signs = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(whole), dtype=np.uint32), list(map(len, whole)))
    lettered = np.zeros(len(whole), bool)
    lettered[text[_letters()[1][signs]]] = True
    low, text = _symbols(signs, text, True)
    inside = text[:-2] == text[2:]
    key = (text[:-2] << np.uint32(BITS) | _places(low))[inside]
    key.sort()
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(key)))
    key = key[heads]
    starts = np.searchsorted(key >> np.uint32(BITS), np.arange(len(whole) + 1))
    return Grams((key & np.uint32(PLACES - 1)).astype(np.int64), counts, starts, lettered)


def _trigrams_of_long(text: str) -> Grams:
    """The same of one long text, stretch by stretch; the last two symbols of a stretch go on into the next."""
    total, carry, lettered, before = np.zeros(PLACES, np.int64), np.zeros(0, np.uint32), False, True
    for at in range(0, len(text), LONG):
        part = (" " if at == 0 else "") + text[at:at + LONG] + (" " if at + LONG >= len(text) else "")
        signs = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        low, _ = _symbols(signs, np.zeros(len(signs), np.uint32), before)
        lettered, before = lettered or bool(_letters()[1][signs].any()), bool(_letters()[2][signs[-1]])
        low = np.concatenate((carry, low))
        total += np.bincount(_places(low), minlength=PLACES) if len(low) > 2 else 0
        carry = low[-2:]
    place = np.flatnonzero(total)
    return Grams(place, total[place], np.array([0, len(place)]), np.array([lettered]))


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text", PORTION):
        for at in range(0, batch.num_rows, MOST_ROWS):
            yield batch.slice(at, MOST_ROWS)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, place, n). Sums of a few languages are held; where there are many, they are passed on earlier."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, total in held.items():
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(place), pa.string()), pa.array(place.astype(np.int32)), pa.array(total[place])], ["lang", "place", "n"])
        held.clear()

    for batch in _some(batches):
        found = trigrams(batch.column("text").to_pylist())
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if lang not in held and len(held) >= _HELD:
                yield from told()
            places, counts = found.of(i)
            held.setdefault(lang, np.zeros(PLACES, np.int64))[places] += counts
    yield from told()


@dataclass
class Model:
    """Probability of each place by language, in name order; the last column is the background."""

    names: list[str]
    likely: np.ndarray

    def mixture(self, places: np.ndarray, counts: np.ndarray, among: list[int]) -> tuple[np.ndarray, float]:
        """Proportions of the given languages and the background, and the log-likelihood."""
        p = self.likely[places][:, [*among, len(self.names)]].astype(np.float64)
        share = np.full(len(among) + 1, 1 / (len(among) + 1))
        total = counts.sum()
        for _ in range(STEPS):
            new = share * (p.T @ (counts / (p @ share))) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < STILL:
                break
        return share, float(counts @ np.log(p @ share))

    def languages(self, places: np.ndarray, counts: np.ndarray) -> list[tuple[str, float]]:
        """The language set with its proportions (without the background, they add up to 1), the largest first."""
        everything, _ = self.mixture(places, counts, list(range(len(self.names))))
        order = np.argsort(-everything[:-1], kind="stable").tolist()
        charge = PENALTY * np.log(counts.sum() + 1)
        best, best_value = None, -np.inf
        for size in range(1, len(order) + 1):
            share, likelihood = self.mixture(places, counts, order[:size])
            value = likelihood / OVERLAP - charge * size
            if value <= best_value:
                break
            best, best_value = share, value
        each = best[:-1] / best[:-1].sum() if best[:-1].sum() > 0 else np.full(len(best) - 1, 1 / (len(best) - 1))
        found = [(self.names[k], float(s)) for k, s in zip(order, each, strict=False)]
        return sorted(found, key=lambda f: (-f[1], f[0].encode()))


def fit(docs: DataFrame, most: int = LANGUAGES) -> Model:
    """Learn from every text with a language whose fold is not the held-out one. One dense row per language, `most` at most,
    reaches the driver."""
    taught = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    taught = taught.select(F.col("lang").cast("string").alias("lang"), "text")
    counts = taught.mapInArrow(_learned, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))

    def dense(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n = np.zeros(PLACES)
        n[table.column("place").to_numpy()] = table.column("n").to_numpy()
        likely = ((n + SMOOTHING) / (n.sum() + SMOOTHING * PLACES)).astype(np.float32)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "total": pa.array([int(n.sum())], pa.int64()),
                         "likely": pa.array([likely.tobytes()], pa.binary())})

    rows = counts.groupBy("lang").applyInArrow(dense, "lang string, total bigint, likely binary")
    best = sorted(rows.orderBy(F.desc("total"), "lang").limit(most).collect(), key=lambda r: r["lang"].encode())
    columns = [np.frombuffer(r["likely"], np.float32) for r in best] + [np.full(PLACES, 1 / PLACES, np.float32)]
    return Model([r["lang"] for r in best], np.ascontiguousarray(np.stack(columns, 1)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the language's proportion), and the set as `languages` and `shares`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in _some(batches):
            found = trigrams(batch.column("text").to_pylist())
            sets = [known.languages(*found.of(i)) if known.names and found.lettered[i] else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array([s[0][0] if s else "und" for s in sets], pa.string()),
                pa.array([s[0][1] if s else 0.0 for s in sets], pa.float64()), pa.array([[n for n, _ in s] for s in sets], pa.list_(pa.string())),
                pa.array([[v for _, v in s] for s in sets], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")
