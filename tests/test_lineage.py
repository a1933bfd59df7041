import random

import pytest

from samplewright.operators import lineage, resolve, skew


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def brute_cycles(pairs):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    ancestors = {c: reach(up, c) for c in up}
    looped = {c for c in ancestors if c in ancestors[c]}
    return {c: max(d for d in looped if d in ancestors[c] and c in ancestors[d]) for c in looped}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}") for _ in range(48)}
    got = lineage.cycle_nodes(spark.createDataFrame(sorted(pairs), "child_uid string, parent_uid string"))
    assert {r["uid"]: r["cycle_id"] for r in got.collect()} == brute_cycles(pairs)


def test_no_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "child_uid string, parent_uid string")
    assert lineage.cycle_nodes(edges).count() == 0


@pytest.mark.parametrize("bound", [0, 200_000])
def test_closure_survives_cycles_and_hubs(spark, monkeypatch, bound):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", bound)
    rnd = random.Random(3)
    pairs = [(f"k{i}", "hub") for i in range(300)] + [("hub", "top"), ("top", "k0")] + [(f"x{i}", f"k{rnd.randrange(300)}") for i in range(300)]
    edges = spark.createDataFrame(pairs, "child_uid string, parent_uid string")
    down = {}
    for c, p in pairs:
        down.setdefault(p, set()).add(c)
    starts = spark.createDataFrame([("a", "hub"), ("b", "k5")], "key string, uid string")
    got = {}
    for r in lineage.closure(starts, edges, "down", "key").collect():
        assert r["uid"] not in got.setdefault(r["key"], set())
        got[r["key"]].add(r["uid"])
    assert got == {"a": reach(down, "hub") | {"hub"}, "b": reach(down, "k5") | {"k5"}}


def test_parents_with_all_types_needs_every_type(spark):
    nodes = spark.createDataFrame(
        [("r1", "REG"), ("r2", "REG"), ("t", "TIS"), ("d", "D.SEQ"), ("i", "D.IMG"), ("d2", "D.SEQ")], "uid string, sampletype string")
    edges = spark.createDataFrame([("t", "r1"), ("d", "t"), ("i", "t"), ("d2", "r2")], "child_uid string, parent_uid string")
    got = lineage.parents_with_all_types(edges, nodes, ["D.SEQ", "D.IMG"])
    assert {r["uid"] for r in got.collect()} == {"r1", "t"}
    got = lineage.parents_with_all_types(edges, nodes, ["D.SEQ"], ["REG"])
    assert {r["uid"] for r in got.collect()} == {"r1", "r2"}


def test_lookup_join_drops_count_and_keeps_unmatched(spark, monkeypatch):
    left = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1), (None, 2)], "k string, i int")
    right = spark.createDataFrame([("a", "x", 100), ("c", "y", 0)], "k string, v string, n bigint")
    for bound in (0, 200_000):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", bound)
        got = skew.lookup_join(left, right, "k", "left", count="n")
        assert got.columns == ["k", "i", "v"]
        assert got.count() == 102 and got.where("v = 'x'").count() == 100


def test_salted_join_takes_maps(spark):
    rows = [("hot", {"a": str(i)}) for i in range(50)] + [("cold", None)]
    left = spark.createDataFrame(rows, "k string, attrs map<string,string>")
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    got = skew.salted_join(left, right, "k", hot=["hot"], salts=4).collect()
    assert sorted((r.k, str(r.attrs), r.v) for r in got) == sorted((k, str(a), 1 if k == "hot" else 2) for k, a in rows)


def test_ways_follow_the_share_of_the_rows():
    assert skew.ways(count=500, rows=1000, shares=200) == 200
    assert skew.ways(count=5, rows=1000, shares=200) == 2


def test_load_refuses_repeated_and_blank_uids(spark):
    from samplewright.operators import load

    kind = "uid string, sampletype string, n int"
    stored = spark.createDataFrame([("a", "T", 0), (None, "T", 9)], kind)
    sent = spark.createDataFrame([("a", "T", 2), ("a", "T", 1), ("b", "T", 3), ("", "T", 4)], kind)
    got = {(r.uid, r.n, r.outcome) for r in load.merge_load(stored, sent, True, order=["n"]).collect()}
    assert got == {("a", 1, "updated"), ("b", 3, "inserted"), (None, 9, "kept")}
    lost = load.refused(sent, ["n"])
    assert {(r.uid, r.n, r.reason) for r in lost.collect()} == {("a", 2, "repeated"), ("", 4, "no_uid")}
    totals = load.load_totals(load.merge_load(stored, sent, True, order=["n"]), lost=lost).first()
    assert (totals.processed, totals.success, totals.failed, totals.updated) == (4, 2, 2, 1)


@pytest.mark.parametrize("name", ["dup_name", "flat_rows", "parent_status_rows", "collisions", "stage_plan"])
def test_queries_keep_their_rows_when_every_lookup_is_salted(spark, monkeypatch, name):
    import __spark_entry__ as entry

    query, sf = entry.queries()[name], "/root/testdata/sf0.001"
    plain = sorted(map(repr, query(spark, sf).collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    assert sorted(map(repr, query(spark, sf).collect())) == plain


def test_long_sides_are_never_broadcast(spark, monkeypatch):
    """The planner takes these tables for small ones, as it does files of keys from which long uids are made."""
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lineage, "FILTER_ROWS", 0)
    edges = spark.createDataFrame([(f"c{i}", "hub" if i < 300 else f"p{i}") for i in range(400)], "child_uid string, parent_uid string")
    frontier = spark.createDataFrame([("hub",), ("p350",), ("none",)], "uid string")
    for direction, ways in (("down", {"hub": 4}), ("up", {})):
        table = lineage.Edges(edges)
        table._hubs[direction] = ways
        for _ in range(2):  # shuffled, then in buckets
            met = table.meet(direction, frontier, 3)
            assert met.count() == (301 if direction == "down" else 0)
            plan = met._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin Inner" not in plan
    samples = spark.createDataFrame([(1, "a"), (None, "b")], "sample_id bigint, uid string")
    found = resolve.resolve_identifiers(spark.createDataFrame([("1",), ("b",), ("c",)], "identifier string"), samples)
    assert {(r["identifier"], r["uid"]) for r in found.collect()} == {("1", "a"), ("b", "b"), ("c", None)}
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
