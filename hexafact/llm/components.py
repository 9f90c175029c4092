"""Connected components by alternating large-star and small-star steps; those of a few edges in the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexafact.llm.session import discard, materialise

MAX_ROUNDS = 60
#: Edges that the driver joins by itself at most, 16 bytes each: steps over written tables cost more than so few edges.
FEW = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of ``edges`` (a, b).

    Each step joins every node with the least of its neighbours; edges end as stars around the roots. Of more than ``FEW``
    edges, nothing but a count and a checksum reaches the driver, and every step is a written table.
    """
    if edges.count() <= FEW:
        return _of_few(edges)
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = _digest(stars)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, stars = stars, materialise(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        discard(old)
        after = _digest(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _of_few(edges: DataFrame) -> DataFrame:
    found = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").toArrow()
    pairs = np.stack([found.column(k).to_numpy() for k in range(2)], 1).astype(np.int64)
    nodes, place = np.unique(pairs, return_inverse=True)
    a, b = place.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():  # hang each root under the least one beside it
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    made = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[root], pa.int64())})
    return F.broadcast(edges.sparkSession.createDataFrame(made, "node bigint, root bigint"))


def _digest(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]
