"""Whitening against numpy's eigenvectors of a plainly computed covariance, and the slicer on awkward spectra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from tests.llm.helpers import CLASH

from samplewright.llm import whitening
from samplewright.llm.spectrum import Slicer, above, leading

KIND = "vec_id bigint, embedding array<double>, label int"


def plain(vectors, components=8):
    """Per row: integers by Fraction, exact deviation, whitened by eigh (sign free), explained."""
    x = np.array([[math.floor(Fraction(float(c)) * 1024) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    apart = (x * n - s).astype(object)
    v = np.array([[int(a) for a in row] for row in apart.T @ apart], object) / n**3
    w, q = np.linalg.eigh(v.astype(float))
    w, q = w[::-1][:components], q[:, ::-1][:, :components]
    z = (apart / n).astype(float) @ q / np.sqrt(w)
    return (apart * apart).sum(1), z, w / np.trace(v.astype(float))


def rows_of(df):
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return sorted(df.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"]))


def correlated(n=400, d=12, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) / 3 + rng.standard_normal(d)).astype(np.float32)


def test_against_eigh(spark):
    x = correlated()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").repartition(7)
    got = rows_of(whitening.whiten(df))
    deviation, z, explained = plain(x)
    assert len(got) == 400 * 8 and {r["n"] for r in got} == {400}
    assert [r["deviation"] for r in got[::8]] == list(deviation)
    found = np.array([r["whitened"] for r in got]).reshape(400, 8)
    sign = np.sign((found * z).sum(0))
    assert np.allclose(found * sign, z, atol=1e-9)
    assert np.allclose([r["explained"] for r in got[:8]], explained, rtol=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_odd_vectors_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11), -i / 3]) for i in range(20)]
    odd = [(100, None), (101, [1.0, nan, 2.0]), (102, [inf, 0.0, 1.0]), (103, [None, 1.0, 1.0]), (104, []), (105, [1e300, 0.0, 0.0])]
    more = [(None, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (200, [1.0, 5.0]), (201, [4.0, 5.0])]
    schema = "vec_id bigint, embedding array<double>, " + ", ".join(f"{c} string" for c in CLASH) + ", component string, whitened string, size string"
    df = spark.createDataFrame([(i, v, *["x"] * (len(CLASH) + 3)) for i, v in good + odd + more], schema)
    got = rows_of(whitening.whiten(df))
    three = [r for r in got if r["vec_id"] is None or r["vec_id"] < 100]
    assert len(three) == 23 * 3 and {r["n"] for r in three} == {23}
    two = [r for r in got if r["vec_id"] in (200, 201)]
    assert [(r["component"], r["n"], r["explained"]) for r in two] == [(1, 2, 1.0), (2, 2, 0.0)] * 2
    assert [r["whitened"] for r in two[1::2]] == [None, None] and abs(two[0]["whitened"]) == pytest.approx(1)
    assert len(got) == len(three) + len(two)
    deviation, z, explained = plain([v for _, v in good] + [[1.0, 2.0, 3.0]] * 3)
    first = [r for r in three if r["component"] == 1]
    assert sorted(r["deviation"] for r in first) == sorted(deviation)
    assert np.allclose(sorted(abs(r["whitened"]) for r in first), sorted(abs(z[:, 0])))


def test_no_variance_and_no_rows(spark):
    same = rows_of(whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1) for i in range(5)], KIND)))
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, 0.0, None)} and len(same) == 10
    assert rows_of(whitening.whiten(spark.createDataFrame([], KIND))) == []
    assert rows_of(whitening.whiten(spark.createDataFrame([(1, None, 1)], KIND))) == []


def test_large_entries_stay_exact(spark):
    x = [[float(1 << 40), 1.0], [-float(1 << 40), 2.0], [3.0, 4.5]]
    got = rows_of(whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], KIND)))
    deviation, _, _ = plain(x)
    assert [r["deviation"] for r in got[::2]] == [int(t) if t < 1 << 63 else None for t in deviation]
    assert max(deviation) > 1 << 63


def test_sums_past_machine_integers():
    total = whitening.Total()
    for _ in range(5):
        total.add(np.array([1 << 61]), float(1 << 61))
    total.add(np.array([1 << 70], object), 2.0**70)
    assert list(total.value()) == [5 * (1 << 61) + (1 << 70)]
    y = np.array([[1 << 30, 3], [-(1 << 30), 5]])
    assert [list(r) for r in whitening.products(y)] == [[1 << 61, -(1 << 31)], [-(1 << 31), 34]]


def awkward():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 64, 130):
        a = rng.standard_normal((d + 3, d))
        yield a.T @ a
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    for w in ([5.0] * 4 + [1.0] * 16, [1e9, 1.0, 1 - 1e-10] + [1e-3] * 17, [7.0, 7 - 1e-6, 7 - 2e-6, 0] + [0.0] * 16):
        yield q @ np.diag(w) @ q.T
    yield np.eye(10)
    yield np.zeros((3, 3))
    yield np.array([[0.0, 1.0], [1.0, 0.0]])
    yield np.ones((12, 12))


@pytest.mark.parametrize("v", list(awkward()))
def test_slicer(v):
    v = (v + v.T) / 2
    w = np.linalg.eigvalsh(v)[::-1]
    values, vectors = leading(v, 8)
    scale = max(abs(w).max(), 1e-300)
    assert np.allclose(values, w[:8], atol=1e-12 * scale, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-12 * scale
    for shift in np.random.default_rng(2).uniform(w[-1] - 1, w[0] + 1, 10):
        assert above(v, shift) == (w > shift).sum()


def test_counts_number_each_interval():
    v = np.diag(np.arange(10.0))
    slicer = Slicer(v)
    for number in (1, 4, 10):
        low, high = slicer.isolate(number)
        assert low < 10.0 - number < high and slicer.above(low) == number and slicer.above(high) == number - 1
    assert slicer.certified(3, 7.0, 1e-6) and not slicer.certified(3, 6.0, 1e-6)
