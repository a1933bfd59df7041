import gzip
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samplewright.llm import vectors, warc
from tests.llm.helpers import group


def plain_links(rows):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.abs(x).max()
    pairs = [(i, j) for i in good for j in good if i < j and len(good[i]) == len(good[j])
             and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.9]
    roots = group(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    degree = [sum(k in p for p in pairs) for k in range(len(rows))]
    return sorted((str(i), degree[k], str(least.get(roots[k])), str(i) == str(least.get(roots[k]))) for k, (i, _) in enumerate(rows))


def vector_rows():
    rng = np.random.default_rng(1)
    rows = []
    for size in (1, 2, 5, 60):
        centre = rng.normal(size=24)
        rows += [(centre + 0.1 * rng.normal(size=24)).astype(np.float32).tolist() for _ in range(size)]
    rows += [rng.normal(size=24).tolist() for _ in range(40)] + [rows[3]] * 30 + [(np.array(rows[3]) * 5).tolist()]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    return [*rows, (900, None), (901, []), (902, [0.0] * 24), (903, [1.0] * 23 + [None]), (904, [float("nan")] * 24), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0]),
            (907, [2.0, 4.0]), (None, rows[3][1]), (908, [1e-30] * 24), (908, [1e-30] * 24)]


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_brute_force(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vectors.near_duplicates(df, recall=0.9999, block=block).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == plain_links(rows)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_recall_at_the_threshold():
    width, k, tables = vectors.plan(100_000)
    near = vectors.same_cell(np.sqrt(0.2), width)
    assert 1 - (1 - near**k)**tables >= 0.97
    rng = np.random.default_rng(2)
    steps = rng.normal(size=200_000) * np.sqrt(0.2)
    assert abs(np.mean(np.floor(rng.random(200_000) + steps / width) == 0) - near) < 0.01


def pages():
    text = "<p>déjà 漢字 vu</p>\r\n\r\n" * 4000
    return [(1, "http://a/b c\n", "x" * 1000), (2, None, "x" * 1000), (3, "http://c", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", text), (8, "u", text + "!"),
            (9, "u", text), (9, "u", text), (None, "u", "x" * 1000), (None, "u", "only here"), (-3, "u", "0\r\n\r\nWARC/1.1\r\n\r\n")]


def test_pages_go_through_archives(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, digest string, row int")
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        most = max(ids) if ids and len(body) >= 1000 and max(ids) != i else None
        want.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "response" if most is None else "revisit", most))
    got = warc.written_and_read(df).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == sorted(want, key=str)
    assert warc.written_and_read(df.where("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.integers(4, 40))
def test_chunks_and_segments(text, size):
    data = text.encode()
    assert warc.unchunked(warc.chunked(data, size)) == data
    made = list(warc.records(1, "u", data, hashlib.sha1(data).hexdigest(), None, "urn:1", segment=60 + size))
    parsed = list(warc.parse(gzip.decompress(gzip.compress(b"".join(r + warc.END for r in made)))))
    assert warc.payload(b"".join(block for _, block in parsed))[1] == data
    assert [h.get("warc-segment-number") for h, _ in parsed] == ([None] if len(parsed) == 1 else [str(i + 1) for i in range(len(parsed))])


def test_lost_and_damaged_segments_are_errors():
    import pyarrow as pa

    head = f"warc-type\tresponse\nwarc-payload-digest\t{warc._digest32(hashlib.sha1(b'ab').hexdigest())}\npage-id\t1"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n"
    row = lambda n, total, part: {"origin": "o", "number": n, "total": total, "head": head if n == 1 else None, "block": part}
    assert warc._joined(pa.Table.from_pylist([row(2, len(block), block[20:]), row(1, None, block[:20])])).to_pylist()[0]["payload_bytes"] == 2
    for bad in ([row(1, None, block[:20])], [row(1, None, block[:20]), row(3, len(block), block[20:])], [row(1, None, block[:20]), row(2, len(block) + 1, block[20:])]):
        with pytest.raises(ValueError):
            warc._joined(pa.Table.from_pylist(bad))


def test_many_repeated_payloads_are_salted(spark, monkeypatch):
    rows = [(i, "u", f"page {i % 7} " * 300 if i % 3 else "short") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    few = sorted(map(tuple, warc.written_and_read(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, warc.written_and_read(df).collect())) == few and any(r[4] is not None for r in few)
