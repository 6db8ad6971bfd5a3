"""Connected components of an edge table by alternating stars, after runs of edges are reduced to stars by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import materialize

# Edges that one task reduces to stars at a time; a table of no more is settled by that.
CHUNK = 1 << 17


def stars(a: list[int], b: list[int]) -> pd.DataFrame:
    """Edges (a, b) from every node to the smallest of its component, by union-find."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (above := up.setdefault(i, i)) != i:
            up[i] = up[above]
            i = up[i]
        return i
    for x, y in zip(a, b):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    nodes = np.fromiter(up, np.int64, len(up))
    roots = np.fromiter((root(i) for i in list(up)), np.int64, len(up))
    return pd.DataFrame({"a": nodes, "b": roots})[nodes != roots]


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The components of ``edges`` by stars of each CHUNK of them, and whether there is but one chunk."""
    size = CHUNK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for batch in batches:
            a += batch["a"].tolist()
            b += batch["b"].tolist()
            while len(a) > size:
                yield stars(a[:size], b[:size])
                a, b = a[size:], b[size:]
        if a:
            yield stars(a, b)
    n = edges.count()
    few = edges.coalesce(max(1, -(-n // size)))
    return materialize(few.mapInPandas(run, "a long, b long")), n <= size


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger node a has one edge, to a node b that is nobody's larger node."""
    counts = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("nodes")).first()
    if counts.n != counts.nodes:
        return False
    inner = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(inner, "a", "left_semi").isEmpty()


def _pull(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """Link the neighbours v of each node u in ``pairs`` (u, v) to the least node of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if keep_larger:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; the component is its smallest node.

    Self-edges are ignored, repeated and reversed edges do no harm, no edges give no rows.  Each round is a
    written table, so lineage stays short and a lost executor costs one round at most.
    """
    edges, settled = _contracted(materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                                             .filter("a <> b")))
    edges = edges if settled else materialize(edges.distinct())
    while not settled and not _are_stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _pull(both, keep_larger=True)
        edges = materialize(_pull(large.select(F.col("a").alias("u"), F.col("b").alias("v")), keep_larger=False))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
