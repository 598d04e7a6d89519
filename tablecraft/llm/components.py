"""Connected components of a graph that is only held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    ``edges`` has two long columns. Neighbourhoods are turned into stars around
    their smallest node, large and small in turn, until nothing changes; the number
    of rounds grows with the logarithm of a path's length. Every step is a grouping
    with partial sums or an inner join that can be split at a hot node, and each
    round is written to the shared folder. Self edges and null ends are ignored.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    graph = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull()).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are stored before they are joined: joins of tables can be split at a hot node, joins of groupings cannot.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        lower = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        graph = stored(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = graph.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = graph.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
