"""Connected components of an edge table by alternating large-star and small-star steps; each step is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import join_split, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least neighbour m of u, itself included."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_split(pairs, materialize(least, "least"), ["u"], "n")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id in edges; component is the smallest id reachable. Self-loops and repeats do no harm."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    while True:
        # Large star: each larger neighbour of u points to u's least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # Small star: the smaller neighbours of u, and u, point to the least of them.
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        # Done when every node points to one root and no root points on.
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if not ends.agg(F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).cast("int"))).first()[0]:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
