"""Walks over process trees and components of sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import materialise


def descendants(edges: DataFrame, roots: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """(root, node, depth): everything below each root. One equi-join a level; lineage is cut at each. A cycle raises."""
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    found = None
    for depth in range(1, most_levels + 1):
        nxt = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth"))
        level = materialise(nxt, "level")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
    else:
        raise ValueError(f"more than {most_levels} levels: the edges have a cycle or the limit is too low")
    return found if found is not None else level


def root_of(edges: DataFrame, nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root): by pointer doubling, so that a chain of n takes log n joins. A cycle raises."""
    up = nodes.select("node").join(edges.select(F.col("child").alias("node"), "parent"), "node", "left").select("node", F.coalesce("parent", "node").alias("at"))
    up = materialise(up, "up")
    for _ in range(most_rounds):
        two = up.alias("a").join(up.select(F.col("node").alias("n2"), F.col("at").alias("at2")).alias("b"), F.col("a.at") == F.col("b.n2"), "left").select("node", F.coalesce("at2", "at").alias("at"), (F.coalesce("at2", "at") != F.col("at")).alias("moved"))
        two = materialise(two, "up")
        moved = not two.where("moved").isEmpty()
        up = two.select("node", "at")
        if not moved:
            break
    else:
        raise ValueError(f"roots not reached in {most_rounds} rounds: the edges have a cycle")
    return up.select("node", F.col("at").alias("root"))


#: Edges up to which one task solves a graph.
SMALL = 1_000_000


def _solved(edges: DataFrame, kind: str) -> DataFrame:
    """(node, component) of the nodes with edges, in one task: labels fall to the least neighbour's and then jump, on arrays."""
    import numpy as np
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([f["u"].to_numpy(), f["v"].to_numpy()]), return_inverse=True)
        u, v = at[: len(f)], at[len(f) :]
        lab = np.arange(len(names))
        while True:
            new = lab.copy()
            low = np.minimum(lab[u], lab[v])
            np.minimum.at(new, lab[u], low)  # the old label's node takes the least label any member saw
            np.minimum.at(new, lab[v], low)
            new = new[new]
            while (new[new] != new).any():
                new = new[new]
            if (new == lab).all():
                break
            lab = new
        return pd.DataFrame({"node": names, "component": names[lab]})

    return edges.groupBy().applyInPandas(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, by hooking to the least neighbour and then halving paths. Each round is stored.

    A graph of at most SMALL edges, counted first, is solved in one task with the same result.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v")
    kind = dict(nodes.dtypes)["node"]
    if kind in ("int", "bigint", "string") and both.limit(SMALL + 1).count() <= SMALL:
        return nodes.select("node").join(_solved(both, kind), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    lab = materialise(nodes.select("node", F.col("node").alias("c")), "labels")
    for _ in range(most_rounds):
        near = both.join(lab.select(F.col("node").alias("v"), F.col("c").alias("vc")), "v").groupBy("u").agg(F.min("vc").alias("m"))
        hooked = lab.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", "c", F.least("c", F.coalesce("m", "c")).alias("h"))
        # the old component takes the least label any member saw, and then labels jump to their label's label
        least = hooked.groupBy("c").agg(F.min("h").alias("h2"))
        step = hooked.join(least, "c").select("node", F.col("c").alias("old"), "h2")
        jump = least.select(F.col("c").alias("h2"), F.col("h2").alias("h3"))
        new = materialise(step.join(jump, "h2", "left").select("node", "old", F.least("h2", F.coalesce("h3", "h2")).alias("c")), "labels")
        moved = not new.where("old != c").isEmpty()
        lab = new.select("node", "c")
        if not moved:
            break
    else:
        raise ValueError(f"components not settled in {most_rounds} rounds")
    return lab.select("node", F.col("c").alias("component"))
