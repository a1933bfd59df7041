"""Chains of a graph made short: every run of nodes with one parent and one child becomes one edge.

The nodes of a run find its end by pointer jumping: each step doubles how far a node sees, so a run of any length takes as many
steps as its length has binary digits. State is one row per node of a run, and only nodes that do not see the end yet are joined
again. A node is pointed to by one other at most, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.session import cut


class Contracted(NamedTuple):
    """`live` has the remaining edges, `inner(uid, run)` the nodes of the runs, `runs(run, a, b)` the child and the parent that a
    run joins, `rings(uid, cycle_id)` the nodes of rings that nothing joins, with the ring's largest uid."""

    live: DataFrame
    inner: DataFrame
    runs: DataFrame
    rings: DataFrame


def _jump(single: DataFrame, step: Callable[[str], None]) -> tuple[DataFrame, DataFrame]:
    """Of nodes with one parent and one child, `single(uid, up)`: those that see the end of their run, (uid, run, to), and those
    in rings, (uid, cycle_id). `to` is the parent beyond the run, `run` the last node before it."""
    known = single.select(F.col("uid").alias("_w"), F.lit(True).alias("open"))
    state = cut(single.join(known, F.col("up") == F.col("_w"), "left").select(
        "uid", F.col("up").alias("to"), F.col("uid").alias("run"), F.col("uid").alias("top"), F.coalesce("open", F.lit(False)).alias("open")))
    done, waiting, before = [state.where("not open")], state.where("open"), -1
    left = waiting.count()
    while left:
        step("jump")
        far = reduce(DataFrame.unionByName, [*done, waiting]).select(
            F.col("uid").alias("_w"), F.col("to").alias("_to"), F.col("run").alias("_run"), F.col("top").alias("_top"), F.col("open").alias("_open"))
        moved = cut(waiting.join(far, F.col("to") == F.col("_w")).select(
            "uid", F.col("_to").alias("to"), F.col("_run").alias("run"), F.greatest("top", "_top").alias("top"), F.col("_open").alias("open"),
            (F.col("_top") > F.col("top")).alias("grew")))
        done.append(moved.where("not open").drop("grew"))
        waiting = moved.where("open").drop("grew")
        now = moved.agg(F.count_if("open").alias("left"), F.count_if(F.col("open") & F.col("grew")).alias("grew")).first()
        before, left = left, now["left"]
        # A run that is not a ring always gets shorter. Nodes of a ring that learn no larger uid have seen all of it.
        if left == before and not now["grew"]:
            break
    ended = reduce(DataFrame.unionByName, done).select("uid", "run", "to")
    return ended, waiting.select("uid", F.col("top").alias("cycle_id"))


def contract(live: DataFrame, step: Callable[[str], None] = lambda name: None) -> Contracted | None:
    """One edge in place of every run of `live(child_uid, parent_uid)`, whose rows are distinct and join different nodes; None if
    there is no run. A run that leads back to where it began becomes an edge of a node to itself."""
    step("degrees")
    up = live.groupBy(F.col("child_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("parent_uid").alias("up"))
    down = live.groupBy(F.col("parent_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("child_uid").alias("down"))
    single = cut(up.where("n = 1").drop("n").join(down.where("n = 1").drop("n"), "uid"))
    if single.isEmpty():
        return None
    ended, rings = _jump(single, step)
    # The run's first node is the one that no other of its nodes leads to.
    first = single.join(single.select(F.col("up").alias("uid")), "uid", "left_anti")
    runs = cut(first.join(ended, "uid").select("run", F.col("down").alias("a"), F.col("to").alias("b")))
    gone = single.select("uid")
    rest = live.join(gone.toDF("child_uid"), "child_uid", "left_anti").join(gone.toDF("parent_uid"), "parent_uid", "left_anti")
    joined = rest.select("child_uid", "parent_uid").union(runs.select("a", "b")).distinct()
    return Contracted(cut(joined), ended.select("uid", "run"), runs, rings)
