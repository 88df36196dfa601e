"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.session import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``node``, ``component`` for each node of an undirected edge table; a component is named by its smallest node.

    Alternates two steps until nothing changes: every node passes the smallest label in its
    neighbourhood to its larger neighbours (large star), then to its smaller ones (small star).
    Edges with a null end are ignored; each step writes its edges to the shared folder.  Minima
    are taken before the shuffle; where a node has very many edges, its side of the join is the
    long one, which the adaptive skew rule splits.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    current = staged(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        following = staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        if following.count() == current.count() and not following.join(current, ["u", "v"], "left_anti").limit(1).count():
            break
        discard(current, large)
        current = following
    discard(current, large)
    found = following.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots).unionByName(loops.join(found, "node", "left_anti").join(roots, "node", "left_anti")).distinct()


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over links (i, j), in a task."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != (further := root[root])).any():
            root = further
