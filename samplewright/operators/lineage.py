"""Lineage over edges `(child_uid, parent_uid, …)`.

Every loop keeps its state in written tables (one per hop), never holds pairs of a group, and stops when a hop adds
nothing. Cycles are no problem: a node is expanded once per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t
from samplewright.functions.layers import layer
from samplewright.operators.contract import Contracted, contract
from samplewright.operators.ranking import dense_index, first_rows
from samplewright.operators.resolve import resolve_identifiers
from samplewright.operators.skew import BROADCAST_ROWS, FILTER_ROWS, among, hot_ways, salted_join
from samplewright.session import cut, scratch_path, stored

_FAR = {"up": ("child_uid", "parent_uid"), "down": ("parent_uid", "child_uid")}
MOST_KINDS = 1000


def lineage_edges(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Edges of a sample table, from its `;`-joined parents; a parent cited twice by one row counts once.

    Rows that share a uid give their edges twice, which no walk below minds; take `distinct` before counting edges.
    """
    parents = F.array_distinct(t.split_list("parent"))
    held = layer(rows, *dict.fromkeys(["parent", *carry]), child_uid=t.filled("uid")).where("child_uid IS NOT NULL")
    return held.select("child_uid", F.explode(parents).alias("parent_uid"), *carry).where(~t.holds_any("parent_uid"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kind(uid: str) -> Column:
    """What stands before the first hyphen of a uid, nothing where there is none. Equal uids are of one kind."""
    return F.coalesce(t.uid_type(uid), F.lit(""))


def _few(kinds: DataFrame) -> frozenset[tuple] | None:
    """The distinct rows of a table of kinds, None if there are more than `MOST_KINDS`."""
    rows = kinds.distinct().limit(MOST_KINDS + 1).collect()
    return None if len(rows) > MOST_KINDS else frozenset(tuple(row) for row in rows)


class Edges:
    """A table of edges that walks look up by one of its ends.

    While what is looked up is small, it is broadcast and the edges stay where they are. Up to `FILTER_ROWS` rows, only the edges
    that pass a table of bits are shuffled. When there are more, only edges whose end is of a kind that is looked up can lead on. The
    first time edges of these kinds are needed they are shuffled; the second time they are written once more, in buckets of the end
    they are looked up by, and from then on only the looked-up rows move. Hubs, whose edges would make one bucket long, are kept
    apart and their rows are spread.
    """

    def __init__(self, edges: DataFrame):
        self.table = edges
        self._laid: dict[tuple, tuple[DataFrame, DataFrame | None, dict]] = {}
        self._shuffled: set[tuple] = set()
        self._hubs: dict[str, dict] = {"up": {}}  # a child cites few parents
        self._kinds: list[frozenset[tuple] | None] = []
        self._onward: Edges | None = None

    def kinds(self) -> frozenset[tuple] | None:
        """(kind of the child, kind of the parent) of all edges, None if there are too many. What tasks send is one row per pair."""
        if not self._kinds:
            self._kinds.append(_few(self.table.select(_kind("child_uid").alias("child"), _kind("parent_uid").alias("parent"))))
        return self._kinds[0]

    def onward(self) -> Edges:
        """The edges that may lead on from a parent, upwards: those of children whose kind is some parent's too, written once."""
        if self._onward is None:
            kinds = self.kinds()
            held = None if kinds is None else self.table.where(_kind("child_uid").isin(sorted({parent for _, parent in kinds})))
            self._onward = self if held is None else Edges(stored(held.select("child_uid", "parent_uid"), "onward"))
        return self._onward

    def step(self, direction: str, kinds: frozenset[tuple] | None = None) -> DataFrame:
        near, far = _FAR[direction]
        step = self.table.select(F.col(near).alias("uid"), F.col(far).alias("_next"))
        return step if kinds is None else step.where(_kind("uid").isin([kind for kind, in kinds]))

    def hubs(self, direction: str) -> dict:
        if direction not in self._hubs:
            self._hubs[direction] = hot_ways(self.step(direction), "uid")
        return self._hubs[direction]

    def laid(self, direction: str, kinds: frozenset[tuple] | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
        """(edges in buckets, edges of hubs, ways of the hubs) of the kinds that are looked up, written on first use."""
        if (direction, kinds) not in self._laid:
            spark = self.table.sparkSession
            step = self.step(direction, kinds)
            hubs = self.hubs(direction)
            hot = None
            if hubs:
                listed = F.broadcast(spark.createDataFrame([(h,) for h in hubs], "uid string"))  # at most one per share
                hot, step = cut(step.join(listed, "uid", "left_semi")), step.join(listed, "uid", "left_anti")
            name = f"edges_{direction}_{uuid.uuid4().hex}"
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            step.repartition(buckets, "uid").write.bucketBy(buckets, "uid").sortBy("uid").option(
                "path", scratch_path(spark, name)).saveAsTable(name)
            self._laid[direction, kinds] = spark.table(name), hot, hubs
        return self._laid[direction, kinds]

    def meet(self, direction: str, frontier: DataFrame, rows: int) -> DataFrame:
        """Every edge that leads on from a row of `frontier(uid, …)`, of `rows` rows, as its columns and `_next`."""
        if rows <= BROADCAST_ROWS:
            return self.step(direction).join(F.broadcast(frontier), "uid")
        # Both sides are long here, whatever size the planner guesses from the files below: neither is broadcast.
        if rows <= FILTER_ROWS:
            return salted_join(among(self.step(direction), "uid", frontier, rows), frontier, "uid", "inner", self.hubs(direction), merged=True)
        kinds = _few(frontier.select(_kind("uid").alias("kind")))
        if (direction, kinds) not in self._shuffled:
            self._shuffled.add((direction, kinds))
            return salted_join(self.step(direction, kinds), frontier, "uid", "inner", self.hubs(direction), merged=True)
        cold, hot, hubs = self.laid(direction, kinds)
        met = cold.join(frontier.hint("merge"), "uid")
        return met if hot is None else met.unionByName(salted_join(hot, frontier, "uid", "inner", hubs, merged=True))


def as_edges(edges: DataFrame | Edges) -> Edges:
    return edges if isinstance(edges, Edges) else Edges(edges)


def closure(starts: DataFrame, edges: DataFrame | Edges, direction: str, key: str | None = None) -> DataFrame:
    """Everything reachable from `starts(uid[, key])`, starts included at hop 0: ([key,] uid, hop).

    Each hop joins only the newest nodes to the edges, drops the ones already seen, and is written once. The edges are
    read once per hop: pass a stored table, or `cut` a derived one first.
    """
    table = as_edges(edges)
    keys = [key] if key else []
    hops = [cut(starts.select(*keys, "uid").distinct().withColumn("hop", F.lit(0)))]
    rows = total = hops[0].count()
    while rows:
        reached = table.meet(direction, hops[-1].drop("hop"), rows).select(*keys, F.col("_next").alias("uid")).distinct()
        seen = _union(hops).drop("hop")
        fresh = reached.join(F.broadcast(seen) if total <= BROADCAST_ROWS else seen.hint("merge"), [*keys, "uid"], "left_anti")
        hops.append(cut(fresh.withColumn("hop", F.lit(len(hops)))))
        rows = hops[-1].count()
        total += rows
    return _union(hops)


def carried(starts: DataFrame, edges: DataFrame | Edges, direction: str, keys: Sequence[str] = (), own: bool = True) -> DataFrame:
    """(keys…, uid, mask): the bits of all `starts(keys…, uid, mask)` from which a node is reached; with `own`, at the start too.

    Only bits that are new to a node travel on, so a node is met again only while its mask grows. Every hop is written once; the
    result has one row per node and key, and no pair of start and node exists.
    """
    table = as_edges(edges)
    by = [*keys, "uid"]
    sent = cut(starts.groupBy(*by).agg(F.bit_or("mask").alias("mask")).where("mask <> 0"))
    rows = sent.count()
    hops = [sent] if own else []
    while rows:
        got = table.meet(direction, sent, rows).groupBy(*keys, F.col("_next").alias("uid")).agg(F.bit_or("mask").alias("mask"))
        if hops:
            # Masks of the nodes just reached only; a frontier's neighbours are few beside all nodes.
            known = _union(hops).groupBy(*by).agg(F.bit_or("mask").alias("old"))
            got = got.join(known, by, "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0)))))
            got = got.where("mask <> 0").drop("old")
        sent = cut(got)
        hops.append(sent)
        rows = sent.count()
    return _union(hops or [sent]).groupBy(*by).agg(F.bit_or("mask").alias("mask"))


def full_lineage(starts: DataFrame, edges: DataFrame | Edges, key: str | None = None) -> DataFrame:
    """Ancestors, the sample itself and descendants: ([key,] uid, direction)."""
    edges = as_edges(edges)
    up = closure(starts, edges, "up", key).withColumn("direction", F.when(F.col("hop") == 0, "self").otherwise("up"))
    down = closure(starts, edges, "down", key).where("hop > 0").withColumn("direction", F.lit("down"))
    return up.unionByName(down)


_LANES = 64


class Trees:
    """The lineage trees of many inputs at once.

    Inputs are numbered, and 64 of them make a block: a node of any of their trees has one row per block, (block, uid, mask), with
    a bit per input. `starts(key, uid)` names the inputs; rows of one key are one input.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame | Edges, starts: DataFrame, key: str = "input_id"):
        self.nodes, self.edges, self.key = nodes, as_edges(edges), key
        starts = cut(starts.select(key, "uid").where(F.col(key).isNotNull()))
        self.inputs = cut(dense_index(starts.select(key).distinct(), [key], name="_n", start=0).select(
            key, F.floor(F.col("_n") / _LANES).cast("bigint").alias("block"), F.pmod("_n", F.lit(_LANES)).cast("int").alias("bit")))
        placed = starts.join(self.inputs, key).select("block", "uid", F.expr("shiftleft(1L, bit)").alias("mask"))
        both = carried(placed, self.edges, "up", ["block"]).union(carried(placed, self.edges, "down", ["block"]))
        self.members = cut(both.groupBy("block", "uid").agg(F.bit_or("mask").alias("mask")))
        self._n = self.members.count()

    def _met(self, rows: DataFrame, members: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
        """Rows joined to members. Many members are merged, with the rows that may be one: a node lies in many blocks, so there are
        fewer nodes than members, and rows are long."""
        if self._n <= BROADCAST_ROWS:
            return rows.join(F.broadcast(members), by)
        return among(rows, key, members, self._n).join(members.hint("merge"), by)

    def node_rows(self) -> DataFrame:
        """(block, uid, mask, sampletype, parent) of the members that have a row among the nodes."""
        return self._met(self.nodes.select("uid", "sampletype", "parent"), self.members, "uid", ["uid"]).select("block", "uid", "mask", "sampletype", "parent")

    def rel_rows(self) -> DataFrame:
        """Edges with both ends in a tree, with the bits of the trees: (block, child_uid, parent_uid, …, mask)."""
        child = self.members.select("block", F.col("uid").alias("child_uid"), F.col("mask").alias("_c"))
        parent = self.members.select("block", F.col("uid").alias("parent_uid"), F.col("mask").alias("_p"))
        ends = self._met(self.edges.table, child, "child_uid", ["child_uid"])
        rels = self._met(ends, parent, "parent_uid", ["block", "parent_uid"])
        shared = rels.withColumn("mask", F.col("_c").bitwiseAND(F.col("_p"))).where("mask <> 0")
        return shared.select("block", *self.edges.table.columns, "mask").distinct()

    def totals(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows per input, (block, bit, name), from one sum per bit: what is shuffled is one row per block and task."""
        each = rows.groupBy("block").agg(F.array(*[F.sum(F.getbit("mask", F.lit(i)).cast("bigint")) for i in range(_LANES)]).alias("_sums"))
        return each.select("block", F.posexplode("_sums").alias("bit", name))

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """One row per input of each row's mask: the input's key and `columns`."""
        per_block = self.inputs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", self.key))).alias("_names"))  # at most 64
        fits = self.inputs.count() <= BROADCAST_ROWS
        met = rows.join(F.broadcast(per_block) if fits else per_block, "block")
        mine = F.filter("_names", lambda x: F.getbit(F.col("mask"), x["bit"]) == 1)
        return met.select(F.explode(mine).alias("_name"), *columns).select(F.col("_name")[self.key].alias(self.key), *columns)

    def page(self, number: int = 1, size: int = 100) -> DataFrame:
        """(key, uid) of the nodes on one page of each tree, in uid order. Every task keeps the first rows of its share per bit,
        so trees are not spread out into (input, node) rows."""
        if number < 1 or not 1 <= size <= 1000:
            raise ValueError("page numbers start at 1 and a page holds 1 to 1000 rows")
        last = number * size
        laid = self.node_rows().select("block", "uid", "mask").sortWithinPartitions("block", "uid")
        heads = laid.mapInArrow(_first_of_each_bit(last), "block bigint, uid string, bit int")
        ranked = first_rows(heads, ["block", "bit"], ["uid"], last).where(F.col("rank") > last - size)
        return self.named(ranked.withColumn("mask", F.expr("shiftleft(1L, bit)")), "uid")


def _first_of_each_bit(last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, np.zeros(_LANES, np.int64)
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            bits = np.unpackbits(np.ascontiguousarray(batch.column("mask").to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ends = np.flatnonzero(np.append(blocks[1:] != blocks[:-1], True)) + 1 if len(blocks) else []
            at = 0
            for end in ends:
                if blocks[at] != block:
                    block, seen = blocks[at], np.zeros(_LANES, np.int64)
                rank = np.cumsum(bits[at:end], axis=0, dtype=np.int64) + seen
                row, bit = np.nonzero((bits[at:end] == 1) & (rank <= last))
                seen = rank[-1]
                taken = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").take(taken), batch.column("uid").take(taken), pa.array(bit.astype(np.int32))], ["block", "uid", "bit"])
                at = end
    return run


def tree(nodes: DataFrame, edges: DataFrame | Edges, starts: DataFrame, key: str = "input_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and relationships of the lineage tree of each start: the edges between members of one tree.

    `nodes(uid, sampletype, parent)`; a node keeps its own parent list as the array `parent_uids`.
    """
    trees = Trees(nodes, edges, starts, key)
    kept = trees.node_rows().withColumn("parent_uids", t.split_list("parent"))
    return trees.named(kept, "uid", "sampletype", "parent_uids"), trees.named(trees.rel_rows(), *trees.edges.table.columns)


def batch_trees(ids: DataFrame, nodes: DataFrame, edges: DataFrame | Edges) -> DataFrame:
    """One line per requested `identifier`: resolved uid (null with a warning if unknown), node and edge totals."""
    asked = cut(resolve_identifiers(ids.select("identifier").distinct(), nodes))
    trees = Trees(nodes, edges, asked.where("uid IS NOT NULL").select(F.col("identifier").alias("input_id"), "uid"))
    counts = trees.totals(trees.node_rows(), "n").withColumn("m", F.lit(0).cast("bigint")).union(
        trees.totals(trees.rel_rows(), "m").select("block", "bit", F.lit(0).cast("bigint"), "m"))
    totals = counts.groupBy("block", "bit").agg(F.sum("n").alias("total_nodes"), F.sum("m").alias("total_rels"))
    totals = trees.inputs.join(totals, ["block", "bit"]).select("input_id", "total_nodes", "total_rels")
    return asked.join(totals, F.col("identifier") == F.col("input_id"), "left").select(
        F.col("identifier").alias("input_id"), F.col("uid").alias("resolved_id"),
        F.coalesce("total_nodes", F.lit(0)).alias("total_nodes"), F.coalesce("total_rels", F.lit(0)).alias("total_rels"),
        F.when(F.col("uid").isNull(), "identifier not found").alias("warning"),
    )


def type_edges(edges: DataFrame, nodes: DataFrame, label: str = "assay_title") -> DataFrame:
    """Distinct (source type, target type, label). Node types come from the node table; hub parents are spread out."""
    types = nodes.select("uid", "sampletype")
    targets = edges.join(types.toDF("child_uid", "target"), "child_uid").select("parent_uid", "target", label).distinct()
    typed = salted_join(targets, types.toDF("parent_uid", "source"), "parent_uid", hot=hot_ways(edges, "parent_uid"))
    return typed.select("source", "target", F.col(label).alias("annotation")).distinct()


def uid_type_edges(edges: DataFrame, label: str | None = None) -> DataFrame:
    """Type edges with the types read off the UIDs: no join at all."""
    cols = [t.uid_type("parent_uid").alias("source"), t.uid_type("child_uid").alias("target")]
    return edges.select(*cols, *([F.col(label).alias("annotation")] if label else [])).distinct()


def enrich_edges(pairs: DataFrame, assays: DataFrame, studies: DataFrame) -> DataFrame:
    """Type edges with assay id, description and study titles joined by `; `.

    `assays(annotation, assay_id, description)`; `studies(assay_id, study_title)` links an assay to its studies. The
    titles are gathered per assay of the catalogue, so a list is as long as the assay has studies.
    """
    linked = studies.distinct().groupBy("assay_id").agg(
        F.array_join(F.sort_array(F.collect_set("study_title")), "; ").alias("study_titles"))
    return pairs.join(assays, "annotation", "left").join(linked, "assay_id", "left").select(
        "source", "target", "annotation", F.col("assay_id").cast("string").alias("internal_assay_id"), "study_titles",
        "description",
    )


def type_nodes(catalogue: DataFrame) -> DataFrame:
    """Type nodes with their field list joined by `; `."""
    fields = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("required", "standard", "possible")])
    return catalogue.select(
        F.col("sampletype").alias("node"), "description", "clade",
        F.array_join(F.array_distinct(fields), "; ").alias("metadata_fields"),
    )


def child_types(starts: DataFrame, edges: DataFrame | Edges, nodes: DataFrame) -> DataFrame:
    """Distinct types of everything derived from the starts."""
    below = closure(starts, edges, "down").where("hop > 0")
    return below.join(nodes.select("uid", "sampletype"), "uid").select("sampletype").distinct()


def descendant_types(edges: DataFrame | Edges, nodes: DataFrame, types: Sequence[str], typed: str | None = None) -> DataFrame:
    """For each node with descendants of the listed types: (uid, mask), bit i set for `types[i]`.

    Type sets travel upwards, one hop at a time, from the nodes whose set has just grown. The state is one row per
    node, not one per pair of ancestor and descendant, and a hub parent's children are merged before the shuffle. `typed` names
    a column of the edges with the child's type; the first hop is then read off the edges, and most nodes are never joined.
    """
    if len(types) > 60:
        raise ValueError("pass at most 60 types at a time")
    own = F.col(typed or "sampletype")
    bit = reduce(lambda chain, i: chain.when(own == types[i], 1 << i), range(1, len(types)),
                 F.when(own == types[0], 1)).otherwise(0).cast("bigint")
    if typed is None:
        return carried(nodes.select("uid", bit.alias("mask")), edges, "up", own=False)
    edges = as_edges(edges)
    first = edges.table.select(F.col("parent_uid").alias("uid"), bit.alias("mask"))
    return carried(first, edges.onward(), "up")


def parents_with_all_types(
    edges: DataFrame | Edges, nodes: DataFrame, child_types: Sequence[str], parent_types: Sequence[str] | None = None,
    typed: str | None = None,
) -> DataFrame:
    """Samples with descendants of all listed types; `parent_types` keeps samples of any of these types. `typed` is as in
    `descendant_types`."""
    wanted, edges = list(dict.fromkeys(child_types)), as_edges(edges)
    found = None
    for i in range(0, len(wanted), 60):
        part = wanted[i:i + 60]
        full = descendant_types(edges, nodes, part, typed).where(F.col("mask") == (1 << len(part)) - 1).select("uid")
        found = full if found is None else found.join(full, "uid", "left_semi")
    asked = nodes.where(F.col("sampletype").isin(*parent_types)) if parent_types else nodes
    return asked.join(found, "uid", "left_semi")


def _lost(edges: Edges, nodes: DataFrame) -> DataFrame:
    """(uid) of the parents that are not among the nodes, each once. Nodes of a kind that no edge cites are not shuffled."""
    cited = edges.table.select(F.col("parent_uid").alias("uid")).where("uid IS NOT NULL").distinct()
    held, kinds = nodes.select("uid"), edges.kinds()
    if kinds is not None:
        held = held.where(_kind("uid").isin(sorted({parent for _, parent in kinds})))
    return cited.join(held.hint("merge"), "uid", "left_anti")


def orphans(edges: DataFrame | Edges, nodes: DataFrame) -> DataFrame:
    """Parents that are not among the nodes, with the number of their distinct children. Each is looked up once, and only children
    of those that are not found are told apart."""
    edges = as_edges(edges)
    lost = cut(_lost(edges, nodes))
    cited = edges.meet("down", lost, lost.count()).select(F.col("uid").alias("parent_uid"), "_next").distinct()
    return cited.groupBy("parent_uid").agg(F.count(F.lit(1)).alias("n_children"))


def _ring_kinds(kinds: frozenset[tuple]) -> set[tuple]:
    """The pairs of kinds that are left when those that lead nowhere are stripped. A cycle of samples is a closed walk of kinds, so
    an edge of any other pair lies on none."""
    left = set(kinds)
    while True:
        children, parents = {c for c, _ in left}, {p for _, p in left}
        kept = {(c, p) for c, p in left if c in parents and p in children}
        if kept == left:
            return kept
        left = kept


class _Shrunk:
    """Edges of a graph with everything taken off that tells nothing about cycles, and what is needed to put it back.

    Edges of kinds that lie on no closed walk go where they are read, then those of samples that nobody cites; both before anything
    is written. Edges that lead nowhere are stripped; where that goes slowly, runs of single nodes become single edges, so that the
    rounds do not follow the longest chain.
    """

    def __init__(self, edges: DataFrame | Edges, step: Callable[[str], None]):
        self.step = step
        edges = as_edges(edges)
        pairs, kinds = edges.table.select("child_uid", "parent_uid"), edges.kinds()
        if kinds is not None:
            # A kind holds no hyphen, so one tells the two of a pair apart.
            pairs = pairs.where(F.concat(_kind("child_uid"), F.lit("-"), _kind("parent_uid")).isin(sorted(f"{c}-{p}" for c, p in _ring_kinds(kinds))))
        cited = pairs.select(F.col("parent_uid").alias("child_uid")).distinct()
        every = cut(pairs.join(cited.hint("merge"), "child_uid", "left_semi").distinct())
        self.levels: list[Contracted] = []
        self.found: list[DataFrame] = []
        self.loops = every.where("child_uid = parent_uid").select(F.col("child_uid").alias("uid"))
        self.has_loops = not self.loops.isEmpty()
        self.live = every.where("child_uid <> parent_uid")

    def shrink(self) -> bool:
        """Strip and contract until nothing changes; whether edges are left."""
        n = self.live.count()
        while n:
            children = self.live.select(F.col("child_uid").alias("parent_uid")).distinct()
            parents = self.live.select(F.col("parent_uid").alias("child_uid")).distinct()
            self.step("strip")
            self.live = cut(self.live.join(children, "parent_uid", "left_semi").join(parents, "child_uid", "left_semi").select(
                "child_uid", "parent_uid"))
            left = self.live.count()
            if 4 * left > 3 * n:
                if not self._contract():
                    if left == n:
                        break
                else:
                    left = self.live.count()
            n = left
        return n > 0

    def _contract(self) -> bool:
        got = contract(self.live, self.step)
        if got is None:
            return False
        self.levels.append(got)
        self.found.append(got.rings)
        turns = got.live.where("child_uid = parent_uid").select(F.col("child_uid").alias("uid"))
        self.loops = self.loops.union(turns)
        self.has_loops = self.has_loops or not turns.isEmpty()
        self.live = got.live.where("child_uid <> parent_uid")
        return True

    def take(self, group: DataFrame) -> None:
        """Set a group of nodes (uid, cycle_id) aside."""
        self.found.append(group)
        gone = group.select("uid")
        self.live = cut(self.live.join(gone.toDF("child_uid"), "child_uid", "left_anti").join(
            gone.toDF("parent_uid"), "parent_uid", "left_anti"))

    def nodes(self) -> DataFrame | None:
        """(uid, cycle_id, looped) of the groups found and of all runs between two nodes of one group; None if nothing was found."""
        parts = [f for f in self.found if not f.isEmpty()]
        if not parts and not self.has_loops:
            return None
        alone = self.loops.distinct().select("uid", F.col("uid").alias("cycle_id"))
        held = cut(_union(parts)) if parts else alone.limit(0)
        for level in reversed(self.levels):
            known = held.union(alone.join(held.select("uid"), "uid", "left_anti")) if self.has_loops else held
            ends = level.runs.join(known.toDF("a", "_a"), "a").join(known.toDF("b", "_b"), "b").where("_a = _b")
            held = cut(held.union(salted_join(level.inner, ends.select("run", F.col("_a").alias("cycle_id")), "run").select("uid", "cycle_id")))
        tagged = held.withColumn("looped", F.lit(False)).union(alone.select("uid", F.lit(None).cast("string"), F.lit(True)))
        return tagged.groupBy("uid").agg(F.coalesce(F.max("cycle_id"), "uid").alias("cycle_id"), F.max("looped").alias("looped"))


def cycle_nodes(edges: DataFrame | Edges, step: Callable[[str], None] = lambda name: None) -> DataFrame:
    """(uid, cycle_id) for every sample that is its own ancestor; `cycle_id` is the largest uid of its cycle group.

    First all edges that cannot lie on a cycle are stripped, and chains are contracted: an acyclic table ends here, after as many
    rounds as the longest chain's length has binary digits. In what is left, each node learns the largest uid among its ancestors
    and itself; going back down from that uid within the same colour gives one strongly connected group, which is set aside, and
    the rest goes round again. The state is one row per node. `step` is told the name of every round.
    """
    edges = as_edges(edges)
    graph = _Shrunk(edges, step)
    while graph.shrink():
        graph.take(cut(_same_colour_down(graph.live, _largest_ancestor(graph.live, step))))
    named = graph.nodes()
    if named is None:
        return edges.table.select(F.col("child_uid").alias("uid"), F.col("parent_uid").alias("cycle_id")).where(F.lit(False))
    named = cut(named)
    # A group of one node is a cycle only if the node leads to itself.
    groups = named.groupBy("cycle_id").agg(F.max("uid").alias("top"), F.count(F.lit(1)).alias("n"), F.max("looped").alias("looped"))
    return salted_join(named.select("uid", "cycle_id"), groups.where("n > 1 or looped").select("cycle_id", "top"), "cycle_id").select(
        "uid", F.col("top").alias("cycle_id"))


def _largest_ancestor(live: DataFrame, step: Callable[[str], None]) -> DataFrame:
    """(uid, colour): the largest uid reachable upwards, the node itself included."""
    state = cut(live.select(F.col("child_uid").alias("uid")).union(live.select("parent_uid")).distinct()
                .withColumn("colour", F.col("uid")))
    grown, table = state, Edges(live)
    while n := grown.count():
        step("colour")
        told = table.meet("down", grown, n).groupBy(F.col("_next").alias("uid")).agg(F.max("colour").alias("new"))
        grown = cut(told.join(state, "uid").where("new > colour").select("uid", F.col("new").alias("colour")))
        state = cut(state.union(grown).groupBy("uid").agg(F.max("colour").alias("colour")))
    return state


def _same_colour_down(live: DataFrame, colour: DataFrame) -> DataFrame:
    """Nodes on a way from a colour's own node up and back: (uid, cycle_id).

    A node of colour c can reach c upwards; it lies in c's group when c can reach it upwards too.
    """
    within = (
        live.join(colour.toDF("child_uid", "_c"), "child_uid").join(colour.toDF("parent_uid", "_p"), "parent_uid")
        .where("_c = _p").select("child_uid", "parent_uid")
    )
    roots = colour.where("uid = colour").select("uid", F.col("colour").alias("cycle_id"))
    return closure(roots, cut(within), "up", "cycle_id").select("uid", "cycle_id")


def dag_check(edges: DataFrame | Edges, nodes: DataFrame) -> DataFrame:
    """Counts of orphaned parents and of samples on cycles, and whether the batch is a sound DAG."""
    edges = as_edges(edges)
    lost = _lost(edges, nodes).agg(F.count(F.lit(1)).alias("n_orphans"), F.lit(0).cast("bigint").alias("n_in_cycles"))
    loops = cycle_nodes(edges).agg(F.lit(0).cast("bigint").alias("n_orphans"), F.count(F.lit(1)).alias("n_in_cycles"))
    both = lost.union(loops).agg(F.sum("n_orphans").alias("n_orphans"), F.sum("n_in_cycles").alias("n_in_cycles"))
    ok: Column = (F.col("n_orphans") == 0) & (F.col("n_in_cycles") == 0)
    return both.withColumn("valid", ok)
