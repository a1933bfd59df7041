"""Searches through the text index and pages through the page index, against scans and sorts."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from tests.test_ranges import files_under

from samplewright.operators import ranking, search, textindex

KIND = "row_n bigint, sampletype string, attrs map<string,string>"


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    words = ["Urgent", "clerk 3", "TODO", "naïve", "İstanbul", "ab", "a", "", "漢字漢字", "xx-1-yy", "x" * 300]
    data = [(i, rnd.choice(["ORD", "CUS"]), None if i % 50 == 0 else {
        a: None if rnd.random() < 0.1 else " ".join(rnd.choices(words, k=rnd.randrange(0, 5))) for a in ("Notes", "Clerk", "Odd 'name")}) for i in range(400)]
    return spark.createDataFrame(data, KIND).repartition(5).cache()


@pytest.fixture(scope="module")
def index(rows):
    return textindex.TextIndex.build(rows, slots=16)


def test_same_rows_with_and_without_index(rows, index):
    asked = [["urgent"], ["CLERK 3", "todo"], ["a"], ["a", "urgent"], ["naïve"], ["İstanbul"], ["漢字漢"], ["none of these"], ["clerk 3 todo"], ["ab", "-1-"]]
    some = [(), ("Notes",), ("Notes", "Clerk"), ("Odd 'name", "Notes")]
    ways = itertools.product(asked, some, ["PARTIAL", "EXACT"], ["OR", "AND"], ["OR", "AND"])
    rnd = random.Random(3)
    hits = 0
    for texts, attributes, match, attribute_logic, text_logic in rnd.sample(list(ways), 40):
        kinds = rnd.choice([(), ("ORD",)])
        got = index.search(texts, kinds, attributes, match, attribute_logic, text_logic)
        want = search.advanced_search(rows, texts, kinds, attributes, match, attribute_logic, text_logic)
        found = sorted(r.row_n for r in got.collect())
        assert got.columns == rows.columns and found == sorted(r.row_n for r in want.collect())
        hits += len(found)
    assert hits > 100


def test_the_index_narrows(rows, index):
    assert index.candidates(["a"], (), "OR", "OR") is None and index.candidates(["a", "urgent"], (), "OR", "OR") is None
    assert index.candidates(["a", "none of these"], (), "OR", "AND").count() == 0
    near = index.candidates(["xx-1-yy"], ("Notes",), "OR", "OR").count()
    assert near == rows.where("attrs['Notes'] like '%xx-1-yy%'").count() < 400
    opened = index.lists.where("slot = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in opened and len(index.lists.select("slot").distinct().collect()) > 8


def test_pages_open_only_their_ranges(spark):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 as k", "cast(id % 3 as string) as t").repartition(6)
    index = ranking.PageIndex.build(df, ["k", "id"], ranges=20)
    assert len(index) == 5000 and len(index.sizes) > 10
    want = [r.id for r in df.orderBy("k", "id").collect()]
    for number, size in ((1, 100), (7, 33), (50, 100), (51, 100), (1, 1000), (13, 1)):
        assert [r.id for r in index.page(number, size).collect()] == want[(number - 1) * size:number * size]
    start = sum(n for _, n in index.sizes[:5])
    keep = index.sizes[5][0]
    for name in files_under(f"{index.path}/rows"):
        if f"_range={keep}/" not in name:
            with open(name, "wb") as f:
                f.write(b"not parquet")
    assert [r.id for r in index.between(start + 3, start + 12).collect()] == want[start + 2:start + 12]
    assert [r.id for r in ranking.PageIndex(spark, index.path).between(start + 1, start + 1).collect()] == [want[start]]


def test_pages_of_little(spark):
    df = spark.range(3).selectExpr("id")
    assert [r.id for r in ranking.page(df, ["id"], 1, 2, shallow=0).collect()] == [0, 1]
    assert ranking.page(df, ["id"], 9, 2, shallow=0).count() == 0
    assert ranking.page(df.limit(0), ["id"], 1, 2, shallow=0).count() == 0
    with pytest.raises(ValueError):
        ranking.page(df, ["id"], 0, 2)


def test_a_text_that_grows_in_lower_case_is_indexed(spark):
    """Two characters that are three in lower case have a trigram, which search and index must agree on."""
    rows = spark.createDataFrame([(1, "ORD", {"Notes": "İx"}), (2, "ORD", {"Notes": "ix"})], KIND)
    found = textindex.TextIndex.build(rows, slots=2).search(["İx"], (), ["Notes"])
    assert [r.row_n for r in found.collect()] == [r.row_n for r in search.advanced_search(rows, ["İx"], (), ["Notes"]).collect()] == [1]


def test_posting_lists_of_runs_against_plain_lists():
    """Rows with gaps between their numbers, several batches, and texts beyond the basic plane."""
    rnd = random.Random(5)
    ids = np.array([0, 3, textindex.RUN - 1, textindex.RUN, 5 * textindex.RUN, 2, 1 << 33, (1 << 33) + 1])
    cells = [{a: "".join(rnd.choices("ab漢😀 ", k=rnd.randrange(0, 9))) for a in "xyz"[:rnd.randrange(0, 4)]} for _ in ids]
    cells[1]["x"] = None
    kind = pa.list_(pa.string())
    batches = [pa.record_batch([pa.array(ids[i:j]), pa.array([list(c) for c in cells[i:j]], kind), pa.array([list(c.values()) for c in cells[i:j]], kind)],
                               ["_id", "keys", "lows"]) for i, j in ((0, 6), (6, 8))]
    got = [(r["attr"], r["gram"], r["run"] + at) for b in textindex._posted(iter(batches)) for r in b.to_pylist() for at in r["at"]]
    want = {(a, v[i:i + 3], int(n)) for n, c in zip(ids, cells, strict=True) for a, v in c.items() if v for i in range(len(v) - 2)}
    assert len(got) == len(set(got)) and set(got) == want
