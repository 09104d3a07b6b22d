"""Connected components of a link table, by large-star and small-star rounds over Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a-b: each node with the least node of its part."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(nodes[find(i)], nodes[i]) for i in range(len(nodes)) if find(i) != i]


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a batch, cut down to stars."""
    for frame in frames:
        out = forest(frame["a"].to_numpy(), frame["b"].to_numpy())
        if out:
            yield pd.DataFrame(np.array(out, np.int64), columns=["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: each node's larger (or else its smaller) neighbours, and it, link to the least of the neighbourhood."""
    both = links.select(F.col("a").alias("n"), F.col("b").alias("m")).union(links.select(F.col("b").alias("n"), F.col("a").alias("m")))
    near = both if large else both.where("m < n")
    least = near.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    least = stored(least, "least")  # a written table, so that the join's own exchange can split the links of a hot node
    moved = near.where("m > n") if large else near
    joined = moved.join(least, "n")
    out = joined.select(F.col("low").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("low").alias("a"), F.col("n").alias("b")))
    return out.where("a != b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (long columns a, b): root is the least node reachable.

    Each round writes its links to the shared folder; it ends when a round changes none, after about log2 of the
    longest path. Links are never collected.
    """
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").mapInPandas(_local, "a long, b long"), "links")
    mark = None
    while True:
        after = stored(_star(_star(now, True), False), "links")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if new == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = new
