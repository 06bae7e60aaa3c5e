"""Connected components of an edge table, by joins and aggregates only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import forget, stored


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node reachable.

    Large-star and small-star steps by turns: each node links its larger, then its smaller
    neighbours to the smallest neighbour, until nothing changes. No neighbour list is ever gathered;
    a hub only meets an aggregate with map-side combine and a join that Spark can split.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now = stored(
        edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    before = None
    state = _state(now)
    while state != before:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.filter(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(b.alias("a"), F.col("m").alias("b")).filter(a != b).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        after = stored(small.distinct(), "edges")
        before, state = state, _state(after)
        forget(now)
        now = after
    tops = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)


class LocalLinks:
    """Union of links among ``n`` local nodes; keeps one label per node, never a list of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while len(u):
            x, y = label[u], label[v]
            apart = x != y
            if not apart.any():
                break
            u, v, x, y = u[apart], v[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label[:] = shorter
