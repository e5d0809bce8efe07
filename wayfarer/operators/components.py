"""Connected components of an edge table, by contraction.

Each round every node points to its neighbour (or itself) of lowest pseudo-random priority, and the edges
are rewritten between the targets. A round removes a constant share of the nodes whatever the shape of the
graph, so the number of rounds grows with the logarithm of the longest path. Edges are first thinned to a
spanning forest within each partition, so a dense group never keeps more edges than nodes per partition.
Once at most ``small`` edges are left (a fixed, documented bound), one task finishes with union-find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.session import cut, dropped, written

#: Edges that one task may finish alone: 200,000 pairs of longs are 3.2 MB.
SMALL_EDGES = 200_000
#: Nodes that a task remembers while it thins edges.
REMEMBERED = 1_000_000


class UnionFind:
    """Union-find over arbitrary hashable nodes; the root of a set is its smallest node."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True


class BoundedForest:
    """Tells edges that join two sets from those within one. It forgets all when it holds too many nodes, which keeps
    more edges than a forest needs but never loses one."""

    def __init__(self, nodes: int = REMEMBERED) -> None:
        self.nodes = nodes
        self.sets = UnionFind()

    def joins(self, a, b) -> bool:
        if len(self.sets.parent) >= self.nodes:
            self.sets = UnionFind()
        return self.sets.union(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the edges of a partition that join two of its sets (a spanning forest)."""
    seen = BoundedForest()
    for batch in batches:
        kept = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if seen.joins(a, b)]
        if kept:
            a, b = zip(*kept, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label all nodes of the few edges that are left."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
    nodes = np.fromiter(sets.parent, np.int64, len(sets.parent))
    roots = np.fromiter((sets.find(x) for x in nodes.tolist()), np.int64, len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage as :func:`cut` does, in fewer bytes: shuffle files go at once."""
    return written(df, "components")


def connected_components(edges: DataFrame, small: int = SMALL_EDGES, max_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``edges`` has two long columns ``a`` and ``b``; returns ``node, root`` for every node of an edge.

    ``root`` is the smallest node of the component. Null ends, loops and repeated edges are ignored; an
    empty edge table gives no rows. ``keep`` stores what a round gives (:func:`stored` takes less disk).
    """
    live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    live = live.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live = keep(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInArrow(_forest, "a long, b long"))
    maps: list[DataFrame] = []
    for round_no in range(max_rounds):
        if live.count() <= small:
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        priority = lambda c: F.struct(F.xxhash64(F.lit(round_no), c).alias("p"), c.alias("id"))
        best = both.groupBy("a").agg(F.min(priority(F.col("b"))).alias("n"))
        own = priority(F.col("a"))
        step = keep(best.select(F.col("a").alias("node"), F.least(own, F.col("n"))["id"].alias("up")))
        maps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        to_b = step.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = live.join(to_a, "a").join(to_b, "b").where("ua <> ub")
        moved = moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        before, live = live, keep(moved.mapInArrow(_forest, "a long, b long"))
        if keep is stored:
            dropped(before)
    else:
        raise RuntimeError("connected components did not converge")
    top = live.coalesce(1).mapInArrow(_finish, "node long, root long")
    if not maps:
        return keep(top)
    for step in reversed(maps):
        # A node of this round ends where its target ends; a target without further edges is its own root.
        upper = top.select(F.col("node").alias("up"), F.col("root").alias("r"))
        top = step.join(upper, "up", "left").select("node", F.coalesce("r", "up").alias("root"))
    if keep is stored:
        top = keep(top)
        dropped(live, *maps)
    # Contraction names a component by the node that won; the contract is its smallest node.
    low = top.groupBy("root").agg(F.min("node").alias("low"))
    return keep(top.join(low, "root").select("node", F.least("low", "root").alias("root")))
