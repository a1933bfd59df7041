"""Near-full windows: overhangs cut off, checksums of cut pieces, padding on several laws of lengths."""

import zlib

import numpy as np
import pytest
from tests.llm.helpers import odd_docs
from tokenizers import Tokenizer

from samplewright.llm import packing
from samplewright.llm.queries import tokenizer

WORD = tokenizer("word_bpe_49k.json")
LAWS = [("lognormal", (7, 0.6)), ("lognormal", (6.9, 1)), ("lognormal", (6, 0.8)), ("lognormal", (7.5, 0.5)), ("uniform", (1, 4095))]


def sound(sizes, rows, capacity, grain):
    item, at, length, window = rows.T
    assert np.bincount(window, weights=length).max() <= capacity and length.min() > 0
    for i in range(len(sizes)):
        mine = sorted(zip(at[item == i], length[item == i], strict=True))
        end = 0
        for a, n in mine:
            assert a == end and (a + n == sizes[i] or (a + n) % grain == 0)
            end = a + n
        assert end == sizes[i]


@pytest.mark.parametrize("law", LAWS, ids=str)
def test_padding_and_runs(law):
    rng = np.random.default_rng(1)
    sizes = np.clip(getattr(rng, law[0])(*law[1], packing.GROUP).astype(int) + 1, 1, 4095)
    rows, runs = packing.filled(sizes)
    sound(sizes, rows, packing.WINDOW, packing.GRAIN)
    used = len(np.unique(rows[:, 3]))
    assert runs <= 3 and 1 - sizes.sum() / (used * packing.WINDOW) < 0.01
    assert len(rows) < 1.5 * len(sizes)


def test_small_groups():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 40):
        for _ in range(5):
            sizes = rng.integers(1, 4096, n)
            rows, runs = packing.filled(sizes)
            sound(sizes, rows, packing.WINDOW, packing.GRAIN)
            assert runs <= 3 and len(np.unique(rows[:, 3])) <= -(-sizes.sum() // packing.WINDOW) + 1
    rows, _ = packing.filled(np.array([5, 5, 5]), capacity=8, grain=4)
    sound(np.array([5, 5, 5]), rows, 8, 4)
    assert packing.filled(np.array([], int))[0].shape == (0, 4)
    with pytest.raises(ValueError):
        packing.filled(np.array([5000]))


def test_checksums_of_a_run_of_bytes():
    data = np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    for a, b in ((0, 5000), (0, 1), (17, 17), (1, 4999), (1234, 1238), (4000, 5000)):
        assert packing.crc_between(zlib.crc32(data[:a]), zlib.crc32(data[:b]), b - a) == zlib.crc32(data[a:b])


def test_cut_pieces_hold_every_id_once(spark):
    library = Tokenizer.from_file(WORD)
    docs = [(i, f"word{i % 7} and some more, " * (i * 37 % 120)) for i in range(300)] + [(None, None), (1000, "again"), (1000, "again")]
    for df, rows in ((spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), docs), (odd_docs(spark, docs[:40]), docs[:40])):
        got = packing.pack(df, WORD, 2, grain=32).collect()
        plain = {}
        for i, t in rows:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            plain.setdefault(i, []).append(ids)
        held, sequences = {}, {}
        for r in got:
            ids = plain[r.doc_id][0]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length])
            held.setdefault(r.doc_id, []).append((r.start, r.length))
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, all_ids in plain.items():
            assert sum(n for _, n in held[i]) == sum(map(len, all_ids))
            if len(all_ids) == 1:
                ends = np.cumsum([0] + [n for _, n in sorted(held[i])])
                assert [s for s, _ in sorted(held[i])] == ends[:-1].tolist()
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
        total = sum(len(ids) for all_ids in plain.values() for ids in all_ids)
        assert len(sequences) <= -(-total // packing.WINDOW) + 1
    assert packing.pack(odd_docs(spark, []), WORD, 2, grain=32).count() == 0
