"""Connected components of an edge table by alternating large-star and small-star contraction.

Every round first contracts the edges that lie in one task, in pieces of bounded size, to stars around their least node; so
components that are shallow or lie together need one round. The steps between are equi-joins and partially aggregated minima
on narrow rows, and every round is written to the shared folder. Rounds end when all that is left are stars: every node
has one edge, and no centre has one of its own. Their number grows with the logarithm of the longest path. The edges of a hub, a
node with very many, are never gathered in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Edges that a task contracts at once.
PIECE_EDGES = 200_000
#: Nodes with more than CROWD edges are hubs. The bound grows with the edges, so that there are never more than HUBS of them.
CROWD, HUBS = 1000, 50_000


class Forest:
    """Union-find; keeps the edges that joined two parts. The root of a part is its least node."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x):
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> bool:
        x, y = self.find(a), self.find(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.edges.append((a, b))
        return True


def _stars(batches):
    """Edges u -> v of one task, v being the least node that it connects u to."""

    def star(us, vs):
        forest = Forest()
        for u, v in zip(us, vs, strict=True):
            forest.join(u, v)
        nodes = list(forest.up)
        return pa.record_batch({"u": pa.array(nodes, pa.int64()), "v": pa.array(map(forest.find, nodes), pa.int64())})

    us, vs = [], []
    for batch in batches:
        us += batch.column(0).to_pylist()
        vs += batch.column(1).to_pylist()
        if len(us) >= PIECE_EDGES:
            yield star(us, vs)
            us, vs = [], []
    if us:
        yield star(us, vs)


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """u -> v once for each of the given pairs of columns, from one pass."""
    return edges.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))).alias("e")).select("e.*")


def _least(edges: DataFrame, crowd: int) -> DataFrame:
    """Every edge u -> v with the least of u and all its neighbours (m).

    A hub, which has more than crowd edges, sends its least node to all tasks, and its edges are spread by their other end.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = least.filter(F.col("n") > crowd).select("u", F.col("m").alias("sent"))
    others = least.filter(F.col("n") <= crowd).select("u", "m", F.lit(0).cast("long").alias("s"))
    edges = edges.join(F.broadcast(hubs), "u", "left").withColumn("s", F.when(F.col("sent").isNull(), 0).otherwise(F.xxhash64("v")))
    return edges.join(others, ["u", "s"], "left").select("u", "v", F.coalesce("sent", "m").alias("m"))


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars of all tasks. A component that lies in many tasks has the same edges in each of them; they are kept once."""
    return stored(edges.mapInArrow(_stars, "u long, v long").distinct(), "edges")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label of every node with an edge to another one; label is the least node of its component."""
    e = _contracted(edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")))
    while True:
        # edges are distinct, so a node with two of them has two centres
        ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
        nodes = e.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.min("x.to").alias("low"), F.max("x.to").alias("high"), F.count("x.to").alias("up"), F.count(F.lit(1)).alias("n"))
        now = nodes.agg(F.count_if(F.expr("low < high OR (up > 0 AND up < n)")).alias("open"), F.sum("up").alias("edges")).first()
        if not now["open"]:
            break
        crowd = max(CROWD, 2 * now["edges"] // HUBS)
        large = _least(_pairs(e, ("u", "v"), ("v", "u")), crowd).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = _pairs(_least(large, crowd), ("v", "m"), ("u", "m")).filter("u != v")
        before, e = e, _contracted(small)
        discard(before)
    return _pairs(e, ("u", "v"), ("v", "v")).select(F.col("u").alias("node"), F.col("v").alias("label")).distinct()
