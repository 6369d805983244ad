"""Distributed connected components, for the operators that link documents or pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import drop_materialized, materialize


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that an edge of ``edges`` names and that
    is not itself the root; roots have no row. Edges with a null end, loops and repeats are ignored.

    Alternates large stars (every larger neighbour of a node moves to the node's smallest neighbour) and small stars (the
    smaller neighbours and the node itself move there) until nothing changes, which takes a number of rounds logarithmic in
    the components' sizes. Both halves aggregate a minimum by node, combined before the shuffle, and join it back; each
    result is written to the shared folder and read again, so that the lineage stays short and adaptive execution may split
    the rows of a hub. Nothing but two numbers per round comes to the driver.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).filter("hi <> lo").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    now = materialize(tidy(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))), "edges")
    seen = state(now)
    for _ in range(max_rounds if seen[0] else 0):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(tidy(both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))), "large")
        drop_materialized(least)
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        moved = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("m").alias("y")), F.struct(F.col("lo").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
        new = materialize(tidy(moved), "edges")
        for old in (now, large, least):
            drop_materialized(old)
        now, before = new, seen
        seen = state(now)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
