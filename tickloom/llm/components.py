"""Connected components of links, as Spark joins only."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import drop_stored, stored


def _smallest(edges: DataFrame) -> DataFrame:
    """Columns u, v with the smallest v of each u; a node with very many links is combined before the shuffle."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in ``links`` (u, v).

    Large star and small star in turns: every node links its larger neighbours, then all its neighbours, to its smallest
    neighbour. After about log(nodes) turns each node links to the smallest of its component alone.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        near = _smallest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        before, edges = edges, stored(small, "links")
        drop_stored(before)
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
