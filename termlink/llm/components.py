"""Connected components by alternating large-star and small-star steps, and size-checked joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .kernels import shared

BROADCAST_ROWS = 1_000_000  # of a few longs each: some ten MB


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component being its smallest node; nodes without an edge are not listed.

    Each step is a partial minimum and a join, so a hub's edges are split like any skewed join's; the
    lineage is cut with a reliable checkpoint after each round.
    """
    now = shared(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = large.join(low, F.col("a") == F.col("k"))
        small = joined.where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("k", "m").toDF("a", "b"))
        now = shared(small.distinct())
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone`` (a cut, narrow table); broadcast only when counted small."""
    gone = gone.select(F.col(key).alias("_gone")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti")


def find_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' components, for edges within one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root
