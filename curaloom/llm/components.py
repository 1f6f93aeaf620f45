"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, store


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of an edge.

    Alternates large-star and small-star steps, which need rounds in proportion
    to the logarithm of the number of nodes.  Each round is written to the shared
    folder.  Nothing but two sums comes to the driver.  A node with very many
    edges costs its row in the join, which adaptive execution may split; the
    minimum over neighbours is combined before it is shuffled.

    Defined cases: an edge with a null end or from a node to itself says nothing;
    repeated and reversed edges are one; no edges give an empty result; other
    columns aren't read.
    """
    edges = store(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        before, edges = edges, store(small, "edges")
        forget(before)
        sums = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(sums) == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
        seen = tuple(sums)
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
