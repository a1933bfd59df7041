import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from samplewright.llm import bpe, packing, token_counts, token_files, words
from samplewright.llm.queries import tokenizer
from tests.llm.helpers import ROWS, odd_docs

SF = "/root/testdata/sf0.001"
SIGNS = "ab Ñé\n\r\t '’.,!1２ſKİΣσ́\0<|▁ \x85\x1c ß漢  \n"
TEXT = st.text(st.one_of(st.sampled_from(SIGNS), st.characters(codec="utf-8")), max_size=60)
SET = settings(max_examples=150, deadline=None)
WORD, BYTE, PIECE = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def library(path):
    return Tokenizer.from_file(path)


@SET
@given(st.lists(TEXT, max_size=8))
def test_word_encoder_is_the_library(texts):
    ids, bounds = words.encoder(WORD).encode(pa.array(texts, pa.string()))
    want = library_word.encode_batch(texts, add_special_tokens=False)
    assert [ids[bounds[i]:bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in want]


library_word, library_byte = library(WORD), library(BYTE)
pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)


@SET
@given(st.lists(TEXT, max_size=8))
def test_counts_are_the_library(texts):
    assert token_counts.counter(PIECE).counts(pa.array(texts, pa.string())).tolist() == [len(pieces.encode(t)) for t in texts]


_BYTE = bpe.ByteBpe(BYTE, bpe.Lexicon(bpe.build_lexicon(BYTE, ["the", "then", "a", "ab", "don't", "é"])))


@SET
@given(st.lists(TEXT, max_size=8))
def test_bpe_is_the_library(texts):
    got = _BYTE.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [e.ids for e in library_byte.encode_batch(texts, add_special_tokens=False)]
    assert [_BYTE.decode(x.tolist()) for x in got] == [library_byte.decode(x.tolist(), skip_special_tokens=False) for x in got]


@SET
@given(st.dictionaries(st.binary(max_size=8), st.lists(st.integers(0, 50_000), max_size=4), max_size=60), st.binary(max_size=8))
def test_lexicon_is_a_dictionary(entries, other):
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(entries))
    assert all(lexicon.get(k) == v for k, v in entries.items())
    assert lexicon.get(other) == entries.get(other)


def test_lexicon_shares_suffixes():
    many = {f"{a}{b}ingly".encode(): [1] for a in "abcdefgh" for b in "xyz"}
    assert bpe.Lexicon(bpe.Lexicon.compile(many)).states < 12


def test_long_runs_are_merged_like_short_ones():
    rng = random.Random(5)
    for n in (65, 200, 4000):
        text = "".join(rng.choice("aeinrst") for _ in range(n))
        assert _BYTE.merge(text.encode()) == library_byte.encode(text, add_special_tokens=False).ids
        assert token_counts.counter(PIECE).whole(text) == len(pieces.encode(text))


@SET
@given(st.lists(st.integers(0, 1 << 62), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    code = token_files.EliasFano.of(token_files.EliasFano.encode(np.array(values, np.uint64)).bytes())
    assert code.all().tolist() == values
    for i in range(0, len(values), 37):
        assert code.select(i) == values[i] and code.find(values[i]) == sum(v <= values[i] for v in values)


def test_segment_round_trip(tmp_path):
    parts = [np.arange(n, dtype=np.uint32) for n in (1, 0, 5, 300)]
    path = tmp_path / "segment"
    path.write_bytes(token_files.pack([None, -7, 4, 4], parts, 2))
    segment = token_files.Segment(np.memmap(path, mode="r"))
    assert segment.doc_ids() == [None, -7, 4, 4] and [segment.doc_id(i) for i in range(4)] == [None, -7, 4, 4]
    assert all((segment.document(i) == p).all() for i, p in enumerate(parts))


def docs_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return [(docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd_docs(spark), ROWS), (odd_docs(spark, []), [])]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query(spark):
    for docs, rows in docs_of(spark):
        coded = sorted(((i, library_word.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows),
                       key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
        want, at = [], 0
        for i, ids in coded:
            want.append((str(i), at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted((str(r[0]), *r[1:]) for r in token_files.written_and_read(docs, WORD, 1).collect()) == sorted(want)


def test_token_counts_query(spark):
    for docs, rows in docs_of(spark):
        want = [(str(i), len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 4096) for i, t in rows]
        assert sorted((str(r[0]), *r[1:]) for r in token_counts.token_counts(docs, PIECE).collect()) == sorted(want)


def test_bpe_query(spark):
    for docs, rows in docs_of(spark):
        want = []
        for i, t in rows:
            ids = library_byte.encode(t or "", add_special_tokens=False).ids
            back = library_byte.decode(ids, skip_special_tokens=False)
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(docs, BYTE).collect()) == sorted(want)
        assert bpe.encode(docs, BYTE).count() == len(rows)


def test_packing_query(spark):
    for docs, rows in docs_of(spark):
        coded = sorted((str(i), tuple(library_word.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
        got = packing.pack(docs, WORD, 2).collect()
        # Every id of every document is in exactly one piece.
        want = sorted((i, s, len(c), crc(c), len(ids)) for i, ids in coded for s in range(0, len(ids), 4096) for c in [ids[s:s + 4096]])
        assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        if len(got) > 100:
            assert sum(len(ids) for _, ids in coded) / (4096 * len(sequences)) > 0.95


def test_differencing_keeps_no_empty_windows():
    import tracemalloc

    sizes = np.minimum(4095, np.random.default_rng(1).lognormal(6, 0.8, 2048).astype(int) + 1)
    tracemalloc.start()
    window, sums = packing.differencing(sizes, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6 and len(sums) == 1000 and sums.sum() == sizes.sum() and (np.bincount(window, sizes, 1000) == sums).all()
    assert packing.GROUP == 2048
    few = packing.windows(sizes)
    assert 1 - sizes.sum() / ((few.max() + 1) * packing.WINDOW) < 0.015


def test_differencing_is_near_equal_and_counts_up():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 40, 500):
        sizes = rng.integers(1, 4097, n)
        window = packing.windows(sizes)
        sums = np.bincount(window, weights=sizes)
        assert sums.max() <= 4096 and len(sums) >= -(-sizes.sum() // 4096)
    _, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums) == [14, 16]  # the classic example of the method
    assert sorted(packing.windows(np.array([3000, 3000, 3000])).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError):
        packing.windows(np.array([5000]))


def test_blocks_of_a_coded_list():
    rng = np.random.default_rng(8)
    for n in (0, 1, 255, 256, 257, 3000):
        for top in (1, 300, 1 << 40):
            values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
            coded = token_files.EliasFano.of(token_files.EliasFano.encode(values).bytes())
            assert list(coded.each()) == values.tolist() == coded.all().tolist()
            assert all(len(coded.some(b)) <= token_files.SAMPLE for b in range(-(-n // token_files.SAMPLE)))
