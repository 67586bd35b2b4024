"""Connected components of an edge table by alternating star contraction.

Every round is two group-by-minimum joins over edges; no adjacency list is ever built, so a hub with millions of
neighbours is rows of a join, which adaptive execution splits. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import written


def _to_smallest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links each node's neighbours (all larger ones, or the smaller ones and itself) to its smallest neighbour."""
    if both_ways:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if both_ways:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge, root being the smallest node reachable. `edges` has longs u and v.

    Null ends are dropped; self-loops and repeated edges do not matter; without edges the result is empty.
    """
    edges = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        edges = written(_to_smallest(_to_smallest(edges, True), False), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def named_components(links: DataFrame) -> DataFrame:
    """name and root (a number for each component) of the names that links (u, v: strings) connect; names get numbers of their own, no hashes."""
    names = written(links.select(F.col("u").alias("name")).union(links.select("v")).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    number = lambda c: names.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    edges = links.select("u", "v").distinct().join(number("u"), "u").join(number("v"), "v")
    return components(edges.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))).join(names, F.col("node") == F.col("id")).select("name", "root")
