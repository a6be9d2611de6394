"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Every node passes the smallest of its neighbours and itself to its larger neighbours.

    spent gets the tables that may go once the result is written.
    """
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    # written first, so that the join deals both sides itself and can split the rows of a hub
    smallest = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("least")), "large-star")
    spent.append(smallest)
    return (
        both.where("other > node")
        .join(smallest, "node")
        .select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        .where("hi <> lo")
        .distinct()
    )


def _small_star(edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Every node points at its smallest neighbour, and so do its other smaller neighbours."""
    smallest = materialise(edges.groupBy("hi").agg(F.min("lo").alias("least")), "small-star")
    spent.append(smallest)
    moved = edges.join(smallest, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(smallest.select("hi", F.col("least").alias("lo"))).distinct()


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Nulls and self links take no part. Neither edges nor components reach the driver: each round compares
    a count and a sum of hashes. Rounds grow as the logarithm of the longest chain.
    """
    edges = materialise(
        pairs.where(f"{left} is not null and {right} is not null and {left} <> {right}")
        .select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        spent = [edges]
        large = materialise(_large_star(edges, spent), "large")
        spent.append(large)
        stars = materialise(_small_star(large, spent), "edges")
        after = _state(stars)
        for table in spent:
            discard(table)
        edges = stars
        if after == before:
            break
        before = after
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
