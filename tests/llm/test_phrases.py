"""Collocations against a plain count of all phrases, and the lowered supports against what makes them complete."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import ROWS, odd_docs

from samplewright.llm import phrases

COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def plain(rows, support, longest=4, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            total[lang] += len(ws)
            for size in range(1, longest + 1):
                f[lang].update(tuple(ws[i:i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        covered = {p[i:i + size] for p, a in kept.items() for size in range(2, len(p)) for i in range(len(p) - size + 1)
                   if p[i:i + size] in kept and 100 * a >= 80 * kept[p[i:i + size]]}
        ranked = []
        for p, a in kept.items():
            if p not in covered:
                cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-cut[0], -a, " ".join(p).encode(), counts[p[:cut[1]]], counts[p[cut[1]:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == COLS
    return sorted(tuple(r) for r in df.collect())


def made_up(n=300, seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "city", "é", "of", "the", "x" * 300, "漢字", "a\x85b"] + [f"w{i}" for i in range(60)]
    texts = []
    for i in range(n):
        ws = rng.choices(words, weights=[9, 8, 7, 5, 9, 9, 2, 3, 3] + [1] * 60, k=rng.randrange(0, 120))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for w in ws)
        texts.append((text, rng.choice(["en", "en", "en", None, "de", "a\nb"])))
    return texts + [(texts[0][0], "en")] * 30 + [("", "en"), (None, "fr"), (" .,; \n", "de"), ("one two", "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(5)


@pytest.mark.parametrize(("support", "shards"), [(5, 8), (5, 1), (12, 3)])
def test_against_a_plain_count(spark, support, shards):
    rows = made_up()
    got = found(phrases.collocations(frame(spark, rows), support=support, shards=shards))
    assert got == plain(rows, support) and len(got) > 20


def test_top_and_ties(spark):
    rows = [("c d. é f. a b. z y", "en")] * 2
    assert found(phrases.collocations(frame(spark, rows), support=2, top=2)) == plain(rows, 2, top=2)
    assert [r[2] for r in plain(rows, 2)] == ["a b", "c d", "z y", "é f"]


def test_odd_rows_and_extra_columns(spark):
    got = found(phrases.collocations(odd_docs(spark), support=2))
    assert got == plain([(t, None) for _, t in ROWS], 2) and got
    empty = odd_docs(spark, [])
    assert found(phrases.collocations(empty)) == []
    assert found(phrases.collocations(odd_docs(spark, [(1, None), (2, ""), (3, " . ")]))) == []


def test_lowered_supports_keep_every_frequent_phrase(spark):
    rows = made_up()
    dealt = phrases._dealt(frame(spark, rows), 8)
    for row in phrases.lowered_supports(dealt, 30, 8).collect():
        assert len(row["least"]) == 8 and min(row["least"]) >= 1
        assert sum(v - 1 for v in row["least"]) < 30
    mined = phrases.frequent_in_a_shard(dealt, 30, shards=8)
    assert len(mined) == 3 and all(m.columns == ["lang", "shard", "h"] for m in mined)
    # Longer phrases are counted only where their parts are frequent: far fewer than there are.
    pairs = {p[i:i + 2] for t, _ in rows for p in map(tuple, pieces(t)) for i in range(len(p) - 1)}
    assert mined[1].select("h").distinct().count() < len(pairs) / 3


def test_words_and_pieces():
    texts = pa.array(["", "A b.c", None or " \t", "d!", "e"])
    got = phrases.split(texts)
    assert [got.names[i].as_py() for i in got.at] == ["a", "b", "c", "d", "e"]
    assert list(got.text) == [1, 1, 1, 3, 4]
    assert list(got.run(2)) == [0]
    assert len(phrases.split(pa.array([], pa.string())).at) == 0


def test_bit_set_holds_its_keys(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    made = phrases.bit_set(keys, F.col("h"))
    import numpy as np

    own = np.array([r["h"] for r in keys.collect()], np.int64).view(np.uint64)
    assert made.bits == 15 and made.holds(own).all()
    other = np.random.default_rng(0).integers(0, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2)
    assert made.holds(other).mean() < 0.1


def test_exact_arithmetic_past_64_bits(spark):
    row = spark.range(1).select(F.lit(9_000_000_000_000_000).alias("a"), F.lit(9_200_000_000_000_000).alias("l"), F.lit(9_100_000_000_000_000).alias("r"))
    assert row.select(phrases.weakness()).first()[0] == 2_000_000 * 9_000_000_000_000_000 // 18_300_000_000_000_000


def test_packed_hashes_come_back():
    import numpy as np

    rng = np.random.default_rng(4)
    for packing in (phrases.Packing(32, 3), phrases.Packing(47, 9), phrases.Packing(64, 12)):
        keep = np.uint64((1 << 64) - (1 << (64 - packing.bits)))
        h = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64) & keep)
        n = rng.integers(1, 1 << rng.integers(1, 40), len(h))
        back = [packing.unpack(*row) for row in packing.pack(h, n)]
        assert (np.concatenate([b[0] for b in back]) == h).all() and (np.concatenate([b[1] for b in back]) == n).all()
    assert phrases.packing_for(1) == phrases.Packing(32, 3) and phrases.packing_for(1 << 40) == phrases.Packing(52, 19)


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "PORTION", 50)
    text = "one two é three. " * 30 + "x " * 90 + "! four five; six"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "short, text"])], ["lang", "text"])
    parts = list(phrases._portions(iter([batch])))
    assert len(parts) > 8 and "".join(p.column("text")[0].as_py() for p in parts[:-1]) == text and {len(p) for p in parts} == {1}

    def runs(batches):
        return sorted(tuple(w.names[int(w.at[i + k])].as_py() for k in range(2)) for b in batches for w in [phrases.split(b.column("text"))] for i in w.run(2))

    assert runs(parts) == runs([batch])


def test_last_pass_hands_on_short_batches(monkeypatch):
    """In a table of copies every phrase is frequent, so a portion's phrases may be as many as its words."""
    from types import SimpleNamespace

    monkeypatch.setattr(phrases, "ROWS", 5)
    monkeypatch.setattr(phrases, "PHRASE_PORTION", 40)
    text = " ".join(f"w{i}" for i in range(8))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "seed": pa.array([7] * 4, pa.int64()), "text": [text] * 4})
    every = SimpleNamespace(value=phrases.BitSet(15, b"\xff" * (1 << 12)))
    got, most = {}, 0
    for out in phrases._exact_counts(every, 3)(iter([batch])):
        most = max(most, out.num_rows)
        for row in out.to_pylist():
            got[row["size"], row["phrase"]] = got.get((row["size"], row["phrase"]), 0) + row["n"]
    words = text.split()
    want = {(k, " ".join(words[i:i + k])): 4 for k in (1, 2, 3) for i in range(9 - k)}
    assert got == want | {(0, ""): 32}
    assert most <= 5
