"""Connected components of a link table, distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node with the least node of its part."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        if (parent == before).all():
            break
    keep = parent != np.arange(len(nodes))
    return nodes[parent[keep]], nodes[keep]


def contract(links: DataFrame) -> DataFrame:
    """The links (a, b) of each partition as a forest; batch by batch, so that memory stays bounded."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if len(a):
                x, y = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that links reach.

    Alternates large-star and small-star steps until nothing changes; each step
    is a shuffle of at most the remaining links, and hangs no group on one task
    but by a minimum, which combines before the shuffle.
    """
    edges = cut(contract(links.where("a <> b")).distinct())
    seen = None
    while True:
        # large star: every larger neighbour goes to the least node around
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the least of these
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("m").alias("a"), "b").unionAll(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b")
        edges = cut(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = state
