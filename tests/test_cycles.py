"""Chain contraction: few rounds on long chains, and the same groups as brute force."""

import random

import pytest
from tests.test_lineage import brute_cycles

from samplewright.operators import contract, lineage

KIND = "child_uid string, parent_uid string"


def run(spark, pairs):
    rounds = []
    got = lineage.cycle_nodes(spark.createDataFrame(sorted(pairs), KIND).repartition(4), rounds.append).collect()
    assert len({r["uid"] for r in got}) == len(got)
    return {r["uid"]: r["cycle_id"] for r in got}, rounds


def chain(name, n, end=None):
    nodes = [f"{name}{i:05d}" for i in range(n)]
    return list(zip(nodes, [*nodes[1:], end] if end else nodes[1:], strict=False))


def test_a_long_chain_ends_in_few_rounds(spark):
    got, rounds = run(spark, chain("n", 10_000))
    assert got == {} and len(rounds) <= 20


def test_a_ring_with_tails_ends_in_few_rounds(spark):
    ring = chain("r", 3000)
    ring.append((ring[-1][1], ring[0][0]))
    tails = [e for t in range(3) for e in chain(f"t{t}_", 2000, f"r{t * 700:05d}")] + [("r00100", "up0"), *chain("up", 1500)]
    got, rounds = run(spark, ring + tails)
    assert got == {f"r{i:05d}": "r02999" for i in range(3000)} and len(rounds) <= 20


@pytest.mark.parametrize("seed", range(6))
def test_groups_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 30
    pairs = {(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(rnd.choice([26, 34, 44]))}
    # Long runs between some of the nodes, a ring of its own, a run that leads back, and a node that cites itself.
    for k in range(4):
        a, b = f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}"
        way = [a, *[f"w{k}_{i}" for i in range(rnd.randrange(1, 7))], b]
        pairs |= set(zip(way, way[1:], strict=False))
    pairs |= {("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("q1", "q2"), ("q2", "q1"), ("s", "s")}
    got, _ = run(spark, pairs)
    assert got == brute_cycles(pairs)


def test_runs_become_edges(spark):
    pairs = [*chain("a", 6, "top"), ("top", "x"), ("top", "y"), ("b1", "a00000"), ("b2", "a00000")]
    edges = spark.createDataFrame(pairs, KIND)
    got = contract.contract(edges)
    assert {tuple(r) for r in got.live.collect()} == {("a00000", "top"), ("top", "x"), ("top", "y"), ("b1", "a00000"), ("b2", "a00000")}
    assert {tuple(r) for r in got.runs.collect()} == {("a00005", "a00000", "top")}
    assert {r["uid"] for r in got.inner.collect()} == {f"a{i:05d}" for i in range(1, 6)}
    assert contract.contract(spark.createDataFrame([("a", "b")], KIND)) is None
