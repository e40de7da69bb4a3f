"""Connected components of a table of links, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.session import materialise

MAX_ROUNDS = 64


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every linked node; ``component`` is the smallest node reachable.

    ``links`` has the columns ``a`` and ``b``. Every round replaces a node's links by links to the
    smallest neighbour, once from the larger neighbours and once from the smaller ones, until no link
    changes: then each node is linked to its component alone. The number of rounds grows with the
    logarithm of the longest chain. A round is two aggregates by node, which are combined before the
    shuffle, and two joins with one row per node on one side, so a node with very many links is split
    by the adaptive skew join. Rounds are tables in the shared folder. Null nodes and links of a node
    to itself carry nothing and are left out.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = materialise(edges.distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        hung = _hang(edges, larger_only=True)
        pulled = _hang(hung, larger_only=False)
        if _same(edges, pulled):
            break
        edges = pulled
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _hang(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of them and the node itself.

    ``larger_only``: only the larger neighbours, seen from either end; else the smaller ones.
    """
    if larger_only:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select("a", "b")
    least = materialise(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least"
    )
    joined = both.join(least, "a")
    if larger_only:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return materialise(moved.where("a <> b").distinct(), "links")


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two tables of distinct links hold the same rows."""

    def summary(edges: DataFrame) -> tuple:
        row = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        return tuple(row)

    return summary(before) == summary(after)
