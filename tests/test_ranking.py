import random

import pytest
from pyspark.sql import functions as F

from samplewright.operators import ranking, skew


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(("hot" if i % 3 == 0 else f"g{rnd.randrange(50)}"), i, rnd.randrange(10**6)) for i in range(5000)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g string, i bigint, v bigint").repartition(7), data


def test_dense_index_by_group(rows):
    df, data = rows
    got = {(r["g"], r["i"]): r["n"] for r in ranking.dense_index(df, ["v", "i"], by=["g"]).collect()}
    want = {}
    for g in {d[0] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (d[2], d[1])), 1):
            want[g, d[1]] = n
    assert got == want


def test_dense_index_whole_table(rows):
    df, data = rows
    got = [(r["n"], r["i"]) for r in ranking.dense_index(df, ["v", "i"]).collect()]
    assert sorted(got) == [(n, d[1]) for n, d in enumerate(sorted(data, key=lambda d: (d[2], d[1])), 1)]


@pytest.mark.parametrize("bound", [0, 200_000])
def test_later_rows_both_ways(rows, monkeypatch, bound):
    """The salted way and the broadcast way give the same rows."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", bound)
    df, data = rows
    got = {(r["g"], r["i"], r["first_i"]) for r in ranking.later_rows(df, ["g"], ["i"]).collect()}
    first = {}
    for g, i, _ in data:
        first[g] = min(i, first.get(g, i))
    assert got == {(g, i, first[g]) for g, i, _ in data if i != first[g]}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    df, _ = rows
    right = spark.createDataFrame([("hot", 1), ("g3", 2), ("none", 3)], "g string, w int")
    assert skew.hot_keys(df, "g")[0] == "hot"
    salted = skew.salted_join(df, right, "g", how)
    plain = df.join(right, "g", how)
    assert salted.columns == plain.columns
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))


def test_first_rows_and_pages(rows):
    df, data = rows
    got = ranking.first_rows(df, ["g"], ["v", "i"], 3)
    assert got.where("g = 'hot'").count() == 3
    ordered = sorted(data, key=lambda d: (d[2], d[1]))
    for shallow in (0, 10**6):
        page = ranking.page(df, ["v", "i"], 3, 100, shallow)
        assert [r["i"] for r in page.collect()] == [d[1] for d in ordered[200:300]]
    with pytest.raises(ValueError):
        ranking.page(df, ["v"], 1, 1001)


def test_row_list(spark, rows):
    df, data = rows
    wanted = spark.createDataFrame([(1,), (5000,), (9999,)], "n bigint")
    got = {r["i"] for r in ranking.row_slice(df, ["i"], rows=wanted).collect()}
    assert got == {0, 4999}


def test_first_and_last(rows):
    df, data = rows
    firsts = {r["g"]: r["i"] for r in ranking.first_by(df, ["g"], ["v", "i"], ["i"]).collect()}
    lasts = {r["g"]: r["i"] for r in ranking.last_by(df, ["g"], ["v", "i"], ["i"]).collect()}
    for g in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == g), key=lambda d: (d[2], d[1]))
        assert (firsts[g], lasts[g]) == (own[0][1], own[-1][1])


def test_group_limit_is_applied_before_the_shuffle(rows):
    df, _ = rows
    plan = ranking.first_rows(df, ["g"], [F.col("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
