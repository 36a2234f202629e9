"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b): the smallest id that links lead to.

    Each round every node takes the smallest of itself and its neighbours as parent, parents
    are followed to the root, and the graph of the roots goes on. A round at
    least halves the nodes that still have links. Nodes are reduced by
    aggregates only, so a node with very many links is no large group; what a round
    leaves is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(
        links.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links"
    )
    found = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select(a.alias("id"), F.least(a, b).alias("parent"))
        roots = written(parents, "parents")
        while True:
            up = roots.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            higher = written(
                roots.join(up, "parent").select("id", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")),
                "parents",
            )
            roots = higher.select("id", "parent")
            if higher.filter("moved").isEmpty():
                break
        if found is None:
            found = roots.withColumnRenamed("parent", "component_id")
        else:
            next_ = roots.toDF("component_id", "parent")
            found = found.join(next_, "component_id", "left").select(
                "id", F.coalesce("parent", "component_id").alias("component_id")
            )
        if roots.isEmpty():
            return found
        one, two = roots.toDF("a", "pa"), roots.toDF("b", "pb")
        left = edges.join(one, "a").join(two, "b").filter("pa != pb")
        edges = written(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        found = written(found, "found")
        if edges.isEmpty():
            return found
