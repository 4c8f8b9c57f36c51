"""Connected components of an edge list by alternating large and small stars, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node; ``component`` is the smallest node reachable.

    Every round hooks neighbours to the smallest node of each neighbourhood; the stars are written to the shared
    folder, so the lineage stays short and a lost executor re-reads files. A neighbourhood is reduced to its
    minimum with a map-side combine and joined back, so a node with very many edges is not one task's work.
    Null nodes and loops are ignored; an empty edge list gives no rows.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    while True:
        following = stored(_small_star(_large_star(now)), "edges")
        same = following.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(following, ["u", "v"], "left_anti").isEmpty()
        now = following
        if same:
            break
    # stars around the smallest node of each component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than u goes to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the smallest of them. Edges come as (larger, smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
