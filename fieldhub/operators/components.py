"""Connected components by alternating stars (Kiveris et al., 2014) on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub.session import Scratch

MAX_ROUNDS = 64
HOT_SPLIT_EDGES = 1_000_000  # below this many edges no node is worth splitting out
HOT_NODES = 2_000  # upper bound on broadcast hub nodes


def _downward(edges: DataFrame) -> DataFrame:
    """Edges with the larger id first."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, degree): smallest neighbour and number of neighbours of each u."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))


def _meet(edges: DataFrame, least: DataFrame, hot_degree: int | None) -> DataFrame:
    """Edges with the m of their u.

    A hub node may own a large part of all edges.  Nodes above ``hot_degree`` are few
    (at most edges / hot_degree), so their rows meet a broadcast and never gather in one
    task; the other edges take the shuffled join.
    """
    m = least.select("u", "m")
    if hot_degree is None:
        return edges.join(m, "u")
    hot = F.broadcast(least.filter(F.col("degree") > hot_degree).select("u", "m"))
    cold = least.filter(F.col("degree") <= hot_degree).select("u", "m")
    rest = edges.join(hot.select("u"), "u", "left_anti")
    return edges.join(hot, "u").unionByName(rest.join(cold, "u"))


def _large_star(edges: DataFrame, hot_degree: int | None) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest id around that node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _meet(both.filter("v > u"), _least(both), hot_degree)
    return met.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, hot_degree: int | None) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node itself, on their minimum."""
    least = _least(edges)
    links = _meet(edges, least, hot_degree).filter("v <> m")
    return links.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def _fingerprint(edges: DataFrame):
    return edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))
    ).first()


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", hot_split_edges: int = HOT_SPLIT_EDGES
) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component = least id.

    Each round is a few keyed aggregations and joins, and the number of rounds grows with
    the logarithm of the node count, not with the length of a chain.  Every round is
    written to the checkpoint folder; the loop ends when the edge set repeats.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    current = scratch.cut(_downward(given).distinct())
    seen = _fingerprint(current)
    for _ in range(MAX_ROUNDS):
        hot = max(1, 2 * seen[0] // HOT_NODES) if seen[0] >= hot_split_edges else None
        current = scratch.cut(_small_star(_large_star(current, hot), hot).distinct())
        mark = _fingerprint(current)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def label(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Add ``component`` to a node table; a node without edges is its own component."""
    found = connected_components(edges).withColumnRenamed("node", "_node")
    return (
        nodes.join(found, nodes[key] == found["_node"], "left")
        .withColumn("component", F.coalesce("component", F.col(key)))
        .drop("_node")
    )
