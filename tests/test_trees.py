"""Trees by bit sets and edges in buckets, against plain walks."""

import random
import re

import pytest
from tests.test_lineage import reach

from samplewright.operators import lineage, skew

EDGE, NODE = "child_uid string, parent_uid string", "uid string, sampletype string, parent string"


def made(seed=1, n=150, inputs=130):
    rnd = random.Random(seed)
    pairs = {(f"n{i:03d}", f"n{rnd.randrange(max(1, i)):03d}") for i in range(1, n) for _ in range(rnd.choice([1, 1, 2]))}
    pairs = {(c, p) for c, p in pairs if c != p} | {(f"h{i}", "n000") for i in range(40)}
    names = sorted({x for e in pairs for x in e})
    nodes = [(u, "T", ";".join(p for c, p in sorted(pairs) if c == u)) for u in names if u != "n005"]
    starts = [(f"in{i:03d}", rnd.choice(names)) for i in range(inputs)]
    return pairs, nodes, starts


def plain(pairs, starts):
    up, down = {}, {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
        down.setdefault(p, set()).add(c)
    members = {i: reach(up, u) | reach(down, u) | {u} for i, u in starts}
    return members, {(i, c, p) for i, m in members.items() for c, p in pairs if c in m and p in m}


@pytest.mark.parametrize("bound", [0, 200_000])
def test_trees_of_many_inputs(spark, monkeypatch, bound):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", bound)
    pairs, nodes, starts = made()
    members, rels = plain(pairs, starts)
    known = {u for u, _, _ in nodes}
    edges = spark.createDataFrame(sorted(pairs) * 2, EDGE)  # edges given twice count once
    trees = lineage.Trees(spark.createDataFrame(nodes, NODE), edges, spark.createDataFrame(starts, "input_id string, uid string"))
    assert trees.members.count() == len({(b, u) for i, m in members.items() for u in m for b in [int(i[2:]) // 64]})
    got = {(r.input_id, r.uid) for r in trees.named(trees.node_rows(), "uid").collect()}
    assert got == {(i, u) for i, m in members.items() for u in m if u in known}
    found = trees.named(trees.rel_rows(), "child_uid", "parent_uid").collect()
    assert len(found) == len(rels) and {tuple(r) for r in found} == rels
    totals = {(r.block, r.bit): r.m for r in trees.totals(trees.rel_rows(), "m").collect()}
    assert all(totals[divmod(int(i[2:]), 64)] == sum(1 for r in rels if r[0] == i) for i, _ in starts)
    page = trees.page(2, 7).collect()
    want = {(i, u) for i, m in members.items() for u in sorted(m & known)[7:14]}
    assert len(page) == len(want) and {tuple(r) for r in page} == want
    with pytest.raises(ValueError):
        trees.page(0)


def test_batch_trees_names_what_is_missing(spark):
    nodes = spark.createDataFrame([("a", "T", None, 1), ("b", "T", "a", 2)], NODE + ", sample_id bigint")
    ids = spark.createDataFrame([("a",), ("2",), ("nope",), ("a",)], "identifier string")
    got = {r.input_id: (r.resolved_id, r.total_nodes, r.total_rels, r.warning) for r in lineage.batch_trees(
        ids, nodes, spark.createDataFrame([("b", "a")], EDGE)).collect()}
    assert got == {"a": ("a", 2, 1, None), "2": ("b", 2, 1, None), "nope": (None, 0, 0, "identifier not found")}


def test_stored_edges_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, _, _ = made(n=400)
        edges = lineage.Edges(spark.createDataFrame(sorted(pairs), EDGE))
        starts = spark.createDataFrame([("n000",), ("n001",)], "uid string")
        down = {}
        for c, p in pairs:
            down.setdefault(p, set()).add(c)
        assert {r.uid for r in lineage.closure(starts, edges, "down").collect()} == {"n000", "n001"} | reach(down, "n000") | reach(down, "n001")
        cold, hot, hubs = edges.laid("down")
        assert "n000" in hubs and {r.uid for r in hot.select("uid").distinct().collect()} == set(hubs)
        plan = cold.join(starts, "uid")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "SortMergeJoin" in plan
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1  # the looked-up rows; the edges stay
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bits_carried_round_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], EDGE)
    starts = spark.createDataFrame([("a", 1), ("d", 2), ("d", 4)], "uid string, mask bigint")
    assert {(r.uid, r.mask) for r in lineage.carried(starts, edges, "up").collect()} == {("a", 7), ("b", 7), ("c", 7), ("d", 6)}
    assert {(r.uid, r.mask) for r in lineage.carried(starts, edges, "up", own=False).collect()} == {("a", 7), ("b", 7), ("c", 7)}


@pytest.mark.parametrize("n", [1, 700])
def test_a_table_of_bits_loses_no_row_and_lets_few_others_pass(spark, n):
    rows = spark.range(20_000).selectExpr("id", "if(id % 1000 = 999, null, concat('u', id)) as uid")
    few = spark.range(n).selectExpr("concat('u', id * 7) as k").union(spark.sql("select cast(null as string)"))
    got = skew.among(rows, "uid", few, n + 1, "k")
    assert got.columns == ["id", "uid"]
    kept = {r["uid"] for r in got.collect()}
    wanted = {f"u{7 * i}" for i in range(n) if 7 * i % 1000 != 999}
    assert wanted <= kept and None not in kept
    assert len(kept) <= len(wanted) + 20_000 // 8


def test_long_tables_are_cut_down_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
    pairs = [(f"c{i}", f"p{i // 3}") for i in range(6_000)]
    edges = lineage.Edges(spark.createDataFrame(pairs, "child_uid string, parent_uid string"))
    frontier = spark.createDataFrame([("p5",), ("p9",)], "uid string")
    met = edges.meet("down", frontier, 2)
    assert {r["_next"] for r in met.collect()} == {f"c{i}" for i in (15, 16, 17, 27, 28, 29)}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "getbit" in plan and not edges._shuffled
