"""Connected components: of small graphs in numpy, of large ones in rounds of star operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import staged

ROUNDS = 60


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of ``n`` nodes."""
    parent = np.arange(n)
    while len(a):
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    return parent


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """From (a, b) to (node, component): the least node that each can reach.

    Alternates large-star and small-star: each node hangs its larger, then its smaller
    neighbours on the least one, until every component is a star. Each round is written to
    the shared folder; only a count of changed edges comes to the driver. A hub's rows are
    reduced before the shuffle, and the join that brings the least neighbour back has a
    shuffle of its own on both sides, so that adaptive execution can split a hub.
    """
    own = F.col("a").bitwiseXOR(F.lit(1).cast("long"))  # another key than the aggregation's
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(own.alias("key"), "m")
        large = both.join(least, own == F.col("key")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower.select(own.alias("key"), "m"), own == F.col("key"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        after = staged(small, name)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
