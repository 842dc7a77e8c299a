"""Distributed union-find: connected components by alternating star contractions.

Large-star links a node's larger neighbours to its least neighbour, small-star its smaller ones;
both keep the components, and alternating them ends in one star per component whose centre is the
least node. Each round is one shuffle by node and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.staging import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.withColumn("low", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    return low.filter("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.withColumn("low", F.min("b").over(Window.partitionBy("a")))
    own = low.select("a", F.col("low").alias("b"))
    rest = low.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return own.unionByName(rest).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of an edge; root is the component's least node.

    ``edges`` has columns a and b of one orderable type. Loops, repeated and reversed edges are
    allowed, edges with a null are ignored; without edges the result is empty.
    """
    edges = edges.select("a", "b").filter("a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges)), "edges", instead_of=[edges])
        now = _state(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root")).distinct()
