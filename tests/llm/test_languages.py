"""Language identification: held-out accuracy, mixtures of two languages, and the steps against plain versions."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import LONG, ROWS, odd_docs

from samplewright.llm import languages

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(docs):
    return languages.fit(docs)


def test_held_out_documents(docs, model):
    rows = languages.predict(docs, model)
    assert rows.columns == COLS
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = rows.collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred == "und" or (r.lang_pred == r.languages[0] and r.score == r.shares[0] and abs(sum(r.shares) - 1) < 1e-9)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_held_out_labels_are_not_read(docs, model):
    turned = docs.withColumn("lang", F.when(languages.fold(F.col("doc_id")) == 0, F.lit("xx")).otherwise(F.col("lang")))
    other = languages.fit(turned)
    assert other.names == model.names and (other.likely == model.likely).all()


def test_mixtures(spark, docs, model):
    clean = docs.where("length(text) > 1500 and text not rlike '[#$%&*|0-9]'").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"))
    text = {r.lang: r.text[:1500] for r in clean.collect()}
    mixed = [("en", "fr"), ("de", "es"), ("en", "de")]
    rows = [(i, text[a][:1000] + " " + text[b][:1000]) for i, (a, b) in enumerate(mixed)] + [(10 + i, text[a]) for i, a in enumerate(sorted(text))]
    got = {r.doc_id: r for r in languages.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for i, pair in enumerate(mixed):
        assert set(got[i].languages) == set(pair) and min(got[i].shares) > 0.35
    for i, lang in enumerate(sorted(text)):
        assert got[10 + i].languages == [lang] and got[10 + i].score == 1.0


def plain_grams(text):
    out = [" "]
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            out.append(low if c.isalpha() else c)
        elif out[-1] != " ":
            out.append(" ")
    if out[-1] != " ":
        out.append(" ")
    return Counter("".join(out[i:i + 3]) for i in range(len(out) - 2))


def test_trigrams_against_a_plain_count():
    texts = ["", None, "A bC, d!", "Ünïcode ſtrange 漢字 it's İ Σς\r\n 12 ", "नमस्ते दुनिया", "x", "🙂 \U00010400b", LONG[:500]]
    got = languages.trigrams(texts)
    for i, text in enumerate(texts):
        places, counts = got.of(i)
        assert sorted(counts) == sorted(plain_grams(text or "").values())
        assert got.lettered[i] == any(c.isalpha() for c in text or "")
    one = languages.trigrams(texts[3:4])
    assert [list(x) for x in one.of(0)] == [list(x) for x in got.of(3)]


def test_expectation_maximisation_against_a_plain_loop():
    rng = np.random.default_rng(0)
    likely = rng.dirichlet(np.full(50, 0.2), 4).T
    model = languages.Model(["a", "b", "c"], likely)
    places, counts = np.arange(50), rng.integers(1, 30, 50)
    share = [0.25] * 4
    for _ in range(2000):
        sums = [0.0] * 4
        for p, n in zip(likely, counts, strict=True):
            whole = sum(s * x for s, x in zip(share, p, strict=True))
            sums = [t + n * s * x / whole for t, s, x in zip(sums, share, p, strict=True)]
        share = [t / counts.sum() for t in sums]
    best = sum(n * np.log(p @ share) for p, n in zip(likely, counts, strict=True))
    got, value = model.mixture(places, counts, [0, 1, 2])
    assert got.sum() == pytest.approx(1) and best - 1.0 < value <= best + 1e-9


def test_odd_rows(spark, model):
    rows = languages.predict(odd_docs(spark), model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = [t for i, t in ROWS if i == r.doc_id]
        if not any(c.isalpha() for t in texts for c in t or ""):
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, [])
        elif r.doc_id is not None:
            assert r.lang_pred in model.names
        assert r.doc_id is not None or not r.held_out
    nothing = languages.fit(odd_docs(spark))
    assert nothing.names == [] and {r.lang_pred for r in languages.predict(odd_docs(spark), nothing).collect()} == {"und"}
    assert languages.predict(odd_docs(spark, []), model).count() == 0


def test_at_most_so_many_languages(spark):
    rows = [(i, "word " * (1 + i % 40), f"l{i % 40:02}") for i in range(400)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3), most=5)
    taught = Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            taught[lang] += len(text) - 1
    assert model.names == sorted(sorted(taught, key=lambda k: (-taught[k], k))[:5]) and model.likely.shape == (languages.PLACES, 6)
    assert np.allclose(model.likely.sum(0), 1, atol=1e-3)


def test_long_texts_in_stretches(monkeypatch):
    text = "Ünïcode ſtrange 漢字, it's  İ Σς 12 " * 40
    whole = languages.trigrams([text])
    for size in (7, 100, 333):
        monkeypatch.setattr(languages, "LONG", size)
        parts = languages.trigrams([text])
        assert [list(x) for x in parts.of(0)] == [list(x) for x in whole.of(0)] and parts.lettered[0]
    monkeypatch.setattr(languages, "LONG", 3)
    assert not languages.trigrams(["12 34 56"]).lettered[0]
