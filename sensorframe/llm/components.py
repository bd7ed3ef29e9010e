"""Connected components of a graph that is larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.session import stored


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node.

    Large-star and small-star steps in turn until nothing changes: every node points its neighbours to the
    smallest one it knows. Only minima are taken per node, so no neighbourhood is ever gathered in one place,
    and each step is stored, so a lost executor costs the current step only.
    """
    ends = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = stored(edges.where("u != v").select(*ends).distinct())
    while True:
        # Large star: larger neighbours of each node go to its smallest neighbour or itself. The minima are
        # stored, so that the join deals out both its sides anew and can split a hot node.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(_smallest(both).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(near, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large)
        # Small star: smaller neighbours of each node, and itself, go to the smallest of them.
        near = _smallest(large)
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = stored(small)
        # Done when all edges are stars: no node has two parents, and none is both parent and child.
        sides = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
        sides = sides.unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        sides = sides.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if sides.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
