"""Connected components of a distributed edge list by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a - b as (node, smallest node of its part), without the smallest ones."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        if np.array_equal(root, before):
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) of longs touches; root is the smallest
    node of its component.

    In each round every node points to its smallest neighbour, pointers are followed to their
    end by doubling, and the edges are rewritten to the ends; what is left shrinks by half or
    more. Every round is written to the shared folder, nothing passes the driver."""
    live = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    found = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("b"))
        to = written(to.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers")
        while True:
            ends = to.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = written(to.join(ends, "root").select("node", "root", "further"), "pointers")
            to = step.select("node", F.col("further").alias("root"))
            if step.where("root <> further").isEmpty():
                break
        if found is None:
            found = to
        else:
            ends = to.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = found.join(ends, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            found = written(found, "components")
        heads = to.select(F.col("node").alias("a"), F.col("root").alias("x"))
        tails = to.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = live.join(heads, "a").join(tails, "b").where("x <> y")
        live = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if found is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
