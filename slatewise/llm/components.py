"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.session import written


def components(links: DataFrame) -> DataFrame:
    """(v, c): every vertex of `links` (a long, b long) with the smallest vertex of its component.

    Each pass hangs the larger neighbours of a vertex, then the smaller ones, on the smallest it
    knows; minima are aggregated before rows meet, so a vertex with very many links is a skewed
    join that Spark can split and never one task's list. Vertices without a link to another are absent.
    """

    def star(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        return edges.join(least, "a")

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a vertex go to the least of the vertex and its neighbours
        large = star(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: neighbours below a vertex, and the vertex, go to the least of them
        near = star(large)
        small = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    tops = edges.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct()
    return edges.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(tops)
