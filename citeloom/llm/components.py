"""Connected components of links by repeated contraction; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round maps a node to the smallest of itself and its neighbours and carries the links over to the mapped nodes,
    until no link is left between different nodes. Hubs are partial aggregates, never one collected group.
    """
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "edges")
    steps: list[DataFrame] = []
    while True:
        step = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "step")
        steps.append(step)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("_a")), step.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        edges = materialise(edges.join(a, "a").join(b, "b").filter("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    roots = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        roots = roots.join(step.withColumnsRenamed({"node": "root", "to": "_to"}), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return materialise(roots, "roots")
