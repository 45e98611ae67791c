"""Connected components of a table of links, as joins of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.session import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of links ``(a, b)``; the smallest node names it.

    Each round every node takes the smallest name among its neighbours and then the name
    of that name, so long chains shorten by halves. Names are aggregated before they are
    shuffled, so a node with very many links costs no task more than others.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.where("a <> b").distinct(), "edges")
    names = stage(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("component")), "names")
    while True:
        near = (
            edges.join(names.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        nearer = names.join(near, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = names.select(F.col("node").alias("component"), F.col("component").alias("name"))
        after = stage(
            nearer.join(jump, "component", "left").select(
                "node", F.least("component", F.coalesce("name", "component")).alias("component"), "was"),
            "names")
        changed = after.where("component <> was").limit(1).count()
        names = after.select("node", "component")
        if not changed:
            return names
