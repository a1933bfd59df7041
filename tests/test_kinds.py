"""Edges are sifted by the kinds of their uids before anything is shuffled or written; the results are those of brute force."""

import random

import pytest
from tests.test_lineage import brute_cycles

from samplewright.operators import lineage

KIND = "child_uid string, parent_uid string"


def tables(spark, monkeypatch):
    """Rows of every table that is written from now on."""
    written = []
    real = lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: [df := real(df), written.append(df.count())][0])
    return written


def registry(spark):
    pairs = [(f"LIN-{i}", f"ORD-{i % 30}") for i in range(300)] + [(f"ORD-{i}", f"CUS-{i % 5}") for i in range(30)]
    nodes = [(c,) for c, _ in pairs] + [(f"CUS-{i}",) for i in range(4)]
    return spark.createDataFrame(pairs, KIND), spark.createDataFrame(nodes, "uid string")


def test_kinds_without_a_ring_write_no_edges(spark, monkeypatch):
    edges, nodes = registry(spark)
    written = tables(spark, monkeypatch)
    got = lineage.dag_check(edges, nodes).first()
    assert (got["n_orphans"], got["n_in_cycles"], got["valid"]) == (1, 0, False)
    assert sum(written) == 0


def test_only_edges_of_cited_samples_are_written(spark, monkeypatch):
    pairs = [(f"A-x{i}", f"A-{i % 3}") for i in range(300)] + [("A-0", "A-1"), ("A-1", "A-0"), ("A-2", "A-top")]
    written = tables(spark, monkeypatch)
    got = {r["uid"]: r["cycle_id"] for r in lineage.cycle_nodes(spark.createDataFrame(pairs, KIND)).collect()}
    assert got == {"A-0": "A-1", "A-1": "A-1"} and max(written) <= 3


@pytest.mark.parametrize("most", [1000, 3])
@pytest.mark.parametrize("seed", range(3))
def test_cycles_across_kinds_against_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(lineage, "MOST_KINDS", most)
    rnd = random.Random(seed)
    node = lambda: rnd.choice(["A-", "B-", "C-", "D-", "", "-"]) + f"{rnd.randrange(6)}"
    pairs = {(node(), node()) for _ in range(34)} | {("E-1", "A-1"), ("E-2", "E-1"), ("F-1", "F-1")}
    got = lineage.cycle_nodes(spark.createDataFrame([*sorted(pairs), ("E-1", "A-1")], KIND)).collect()
    assert {r["uid"]: r["cycle_id"] for r in got} == brute_cycles(pairs)


def test_orphans_count_distinct_children(spark):
    edges = spark.createDataFrame([("a-1", "b-1"), ("a-1", "b-1"), ("a-2", "b-1"), ("a-2", "b-2"), ("a-3", "z"), ("a-3", None)], KIND)
    got = lineage.orphans(edges, spark.createDataFrame([("b-2",), ("a-1",), (None,)], "uid string")).collect()
    assert {tuple(r) for r in got} == {("b-1", 2), ("z", 1)}


@pytest.mark.parametrize("most", [1000, 0])
def test_long_frontiers_meet_edges_of_their_kinds(spark, monkeypatch, most):
    for name, bound in (("BROADCAST_ROWS", 0), ("FILTER_ROWS", 0), ("MOST_KINDS", most)):
        monkeypatch.setattr(lineage, name, bound)
    edges = lineage.Edges(registry(spark)[0])
    for kind, n in (("CUS", 30), ("ORD", 300), ("CUS", 30), ("LIN", 0), ("CUS", 30)):
        starts = spark.createDataFrame([(f"{kind}-{i}",) for i in range(300)], "uid string")
        assert edges.meet("down", starts, 300).distinct().count() == n
    if most:
        assert edges.step("down", frozenset([("CUS",)])).count() == 30


def test_types_of_children_are_read_off_the_edges(spark, monkeypatch):
    """The walk starts from parents: no child that nobody cites is ever looked up, and the rest of the edges is small."""
    met = []
    real = lineage.Edges.meet
    monkeypatch.setattr(lineage.Edges, "meet", lambda self, way, frontier, rows: [met.append((rows, self.table.count())), real(self, way, frontier, rows)][1])
    edges, _ = registry(spark)
    nodes = spark.createDataFrame([(f"{k}-{i}", k) for k, n in (("LIN", 300), ("ORD", 30), ("CUS", 5)) for i in range(n)], "uid string, sampletype string")
    typed = edges.withColumn("sampletype", lineage._kind("child_uid"))
    for most in (1000, 0):
        monkeypatch.setattr(lineage, "MOST_KINDS", most)
        got = lineage.parents_with_all_types(typed, nodes, ["ORD", "LIN"], ["CUS"], typed="sampletype").collect()
        assert {r["uid"] for r in got} == {f"CUS-{i}" for i in range(5)}
        assert max(rows for rows, _ in met) == 35 and max(n for _, n in met) == (30 if most else 330)
    assert sorted(lineage.parents_with_all_types(edges, nodes, ["ORD", "LIN"]).collect()) == sorted(got)
