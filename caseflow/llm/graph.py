"""Connected components of links that are never collected."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import ship
from caseflow.session import cut_lineage

ship(__name__)


def local_labels(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``size`` nodes over the links of one task."""
    labels = np.arange(size)
    while len(left):
        least = np.minimum(labels[left], labels[right])
        # Hang the roots of both ends below the smaller one, then shorten all ways.
        np.minimum.at(labels, labels[left], least)
        np.minimum.at(labels, labels[right], least)
        while not np.array_equal(labels, shorter := labels[labels]):
            labels = shorter
        apart = labels[left] != labels[right]
        left, right = left[apart], right[apart]
    return labels


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, expected: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``edges`` has two long columns, a and b, in any direction, repeats allowed; rows with a NULL or
    with a = b say nothing. Alternating large and small stars ends after a number of rounds that
    grows with the logarithm of the nodes; each round is checkpointed in the shared folder, in as many files as the
    round before had links for. ``expected`` is about the number of links, for the first of them.
    """
    edges = cut_lineage(edges.select("a", "b").filter("a != b").distinct(), expected)
    before = _state(edges)
    while before[0]:
        edges = cut_lineage(_small_star(_large_star(edges)), before[0])
        after = _state(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
