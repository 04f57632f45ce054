"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.session import materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable over undirected (a, b); only nodes with an edge.

    Alternates large and small stars until only stars are left; written each time. The
    least neighbour comes from an aggregate joined back, so that a node with very
    many edges is no single task.
    """

    def star(e: DataFrame, least_of_all: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select("b", "a")) if least_of_all else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if least_of_all:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    def stars(e: DataFrame) -> bool:
        """Every node has one edge to a node that has none itself."""
        ends = e.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("b", F.lit(0), F.lit(1)))
        per = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return per.filter("out > 1 or (out = 1 and into = 1)").isEmpty()

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)
    while not stars(edges):
        edges = materialise(star(materialise(star(edges, True), name), False), name)
    least = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least)
