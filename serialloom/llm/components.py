"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pin import pin


def _undirected(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    return pin(ends.filter("low <> high").distinct())


def _to_roots(up: DataFrame) -> DataFrame:
    """(node, parent) with each parent replaced by the last one that its parents lead to."""
    while True:
        above = up.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        up = pin(
            up.join(above, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            )
        )
        if up.filter("moved").isEmpty():
            return up.select("node", "parent")
        up = up.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    Each round hangs every node on its smallest neighbour, if that is smaller, takes the
    root of each such tree for its nodes, and keeps the edges between different roots. So
    each round leaves at most half of the nodes, and the edges shrink with them. Edges and
    roots stay tables.
    """
    edges, rounds = _undirected(edges), []
    while not edges.isEmpty():
        up = pin(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent")))
        roots = _to_roots(up)
        rounds.append(roots)
        for end in ("low", "high"):
            here = roots.select(F.col("node").alias(end), F.col("parent").alias("root"))
            edges = edges.join(here, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = _undirected(edges.select(F.col("low").alias("a"), F.col("high").alias("b")))
    if not rounds:
        return edges.select(F.col("low").alias("node"), F.col("high").alias("component"))
    known = rounds.pop()
    while rounds:
        later = known.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        before = rounds.pop().join(later, "parent", "left")
        known = pin(before.select("node", F.coalesce("root", "parent").alias("parent")).unionByName(known))
    own = known.select(F.col("parent").alias("node"), "parent").distinct()
    return pin(known.unionByName(own).withColumnRenamed("parent", "component"))
