"""Connected components of an edge table, distributed.

Each partition first contracts its own edges by union-find, which leaves at most one edge per node and partition. If
no more than ``TASK_EDGES`` edges are left, one task contracts them too, and that is the result: its memory is bounded by
that number, and rounds over a small table cost little but the start of their tasks.
Of a larger table, large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014) join what is left; their number grows with the logarithm of the longest path, and they end when every node but a
root has one edge, to a root. Minima are aggregated before the shuffle and written; the joins then hold one row per node
on one side and come straight from their exchanges, so Spark can split a hub's edges over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Edges that one task contracts alone, in some 50 MB; more are left to rounds over all tasks.
TASK_EDGES = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges; each node but a root leaves an edge to its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while (above := parent[x]) != top:
            parent[x] = top
            x = above
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([root(x) for x in nodes], pa.int64())})


def _unsettled(edges: DataFrame) -> DataFrame:
    """The nodes with several edges to lesser ones, or with edges to lesser and from greater ones. Without any, every node is
    a root or tied to its root."""
    up = F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.explode(F.array(up, down)).alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
    return ends.where("up > 1 or up > 0 and down > 0").select("node")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a bigint, b bigint); component is the least node reachable.

    Nodes without an edge don't appear. Nulls and loops are left out; repeated edges do no harm.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = materialize(edges.mapInArrow(_contract, "a long, b long"))
    while (several := edges.count() > TASK_EDGES) and _unsettled(edges).count():
        # Large-star: every neighbour above a node is tied to the node's least neighbour (or itself).
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = edges.groupBy("a", "b").agg(F.lit(1).alias("n")).drop("n")
        # Small-star: every neighbour below a node, and the node, are tied to the least of them.
        edges = materialize(edges)
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")))
        below = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(below.unionAll(least.select("a", F.col("m").alias("b"))).groupBy("a", "b").agg(F.lit(1).alias("n")).drop("n"))
    if not several:
        edges = materialize(edges.coalesce(1).mapInArrow(_contract, "a long, b long"))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
