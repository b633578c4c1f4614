"""Connected components by alternating large and small stars.

Every step is a combinable minimum and a join; links are never gathered on the driver, and
each round is written to the shared folder so that the plan stays short. The rounds end when
the links are stars: no node has two links downwards, and no centre has one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm._common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    to = both.join(least, "u")
    if large:
        out = to.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = to.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("centre").alias("centre")).filter("down > 1 OR down = 1 AND centre = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the smallest node it can reach.

    Loops, repeated links and either direction are fine; links with a null end are dropped;
    nodes without links are not returned.
    """
    edges = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("a <> b").distinct())
    while not _are_stars(edges):
        before, edges = edges, stored(_star(_star(edges, True), False))
        forget(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's connected part, for links between nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
