"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace, skew_safe_join


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node it reaches.

    Each round takes the least root among the neighbours and then follows roots once (pointer jumping), so
    the number of rounds grows with the logarithm of the longest path. A root is looked up once, and the
    nodes of a large component meet what was found by broadcast, wherever they lie. Rounds are written tables:
    no state on the driver, nothing lost with an executor.
    """
    edges = space.save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    roots, turn = space.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("r")).select("node", F.least("node", "r").alias("root")), f"{name}-0"), 0
    nodes = roots.count()
    while True:
        told = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = space.save(roots.join(told, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")), f"{name}-met-{turn}")
        groups = met.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
        jump = groups.join(met.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("root", "_n", F.least("root", F.coalesce("far", "root")).alias("far"))
        jumped = skew_safe_join(met, space.save(jump, f"{name}-jump-{turn}"), "root", "_n", nodes).select("node", "old", F.col("far").alias("root"))
        turn += 1
        after = space.save(jumped, f"{name}-{turn}")
        changed = not after.filter("root <> old").isEmpty()
        space.drop(f"{name}-met-{turn - 1}")
        space.drop(f"{name}-jump-{turn - 1}")
        space.drop(f"{name}-{turn - 1}")
        roots = after.select("node", "root")
        if not changed:
            return roots
