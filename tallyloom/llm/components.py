"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop, save


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), undirected, of any sortable type: (node, component), the least node reachable, for each node of an edge.

    A round hooks each node to its least neighbour, if that is less, follows the hooks to their roots by pointer jumping, and contracts the
    graph: edges become edges of roots, and those inside one tree go. A large group falls together in a round or two, so later rounds
    carry only what is still apart. Every step is a table in the shared folder. Neighbours are only ever reduced (a partial
    minimum before the shuffle), never collected; joins are shuffle joins that adaptive execution splits where a node is hot.
    Null ends and loops link nothing.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = save(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*pair("a", "b")).distinct(), "edges")
    rounds = []
    while now.limit(1).count():
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a"))
        up = save(ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), "roots")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = save(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "roots")
            drop(up)
            up = jumped
            if not up.where("moved").limit(1).count():
                break
        rounds.append(up)
        of = lambda end: up.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))  # noqa: E731, B023
        apart = save(now.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(*pair("ra", "rb")).distinct(), "edges")
        drop(now)
        now = apart
    drop(now)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    out = rounds[-1].select("node", F.col("root").alias("component"))
    for up in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("root"), "component")
        out = up.select("node", "root").join(later, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return out


def unite(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the sets of p[k] and q[k] for every k, in place. label[x] is the least member of x's set, before and after."""
    p, q = label[p], label[q]
    while len(apart := np.flatnonzero(p != q)):
        p, q = p[apart], q[apart]
        low, high = np.minimum(p, q), np.maximum(p, q)
        np.minimum.at(label, high, low)
        while (label != (next_label := label[label])).any():
            label[:] = next_label
        p, q = label[p], label[q]
