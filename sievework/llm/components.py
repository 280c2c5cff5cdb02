"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, skewed_lookup, stash


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step over (a, b): each node's neighbours are tied to the least node about it.

    The least neighbour and the degree of each node are written first; the edges then meet them through
    ``skewed_lookup``, so that a hub's rows are joined by broadcast and no task holds them all. ``rows`` is what there are
    at most of edges, either way.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stash(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree"), "least")
    tied = skewed_lookup(both, least, "a", "degree", rows)
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = stash(out.where("a <> b").distinct(), "edges")
    discard(least)
    discard(edges)
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38,0)))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the component's least node.

    Each step is written to the shared folder, and what it was made from is deleted. Ends when a round leaves the edges
    as they were.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        rows = 2 * mark[0]  # the large step meets each edge from both its ends, and leaves no more than these
        edges = _star(_star(edges, True, rows), False, rows)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
