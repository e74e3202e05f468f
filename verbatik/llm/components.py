"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatik.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large) or smaller (small) neighbours to its smallest neighbour.

    The minimum is a map-side combined aggregate joined back to the edges, so that a hub's edges
    can be split over tasks (skewed joins) and are never gathered.
    """
    if large:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    else:
        near = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select(F.col("a"), F.col("m")))
    return out.where("u != v").distinct()


def _settled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        a, b = a[low != high], b[low != high]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """Component of every node of an edge table.

    edges: columns u and v (bigint), any direction, repeats and loops allowed. Returns node, root
    with root the smallest node of the component; nodes that only have loops or null ends are left
    out. Up to at_once rows (16 bytes each) are collected and settled on the driver; of more, nothing
    is collected but two numbers a round. An empty table gives an empty table.
    """
    if at_once:
        some = edges.select("u", "v").where("u != v").limit(at_once + 1).toArrow()
        if some.num_rows <= at_once:
            nodes, root = _settled(*(np.array(some.column(c), np.int64) for c in ("u", "v")))
            return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": root}))
    cur = materialize(edges.select("u", "v").where("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        nxt = materialize(_star(_star(cur, True), False), "edges")
        now = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(cur)
        cur = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
