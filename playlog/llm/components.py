"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``a, b``: the smallest id that can be reached.

    In each round every vertex follows its smallest neighbour, and that one's smallest neighbour in turn; edges are then
    drawn between what the vertices have come to, and those inside one vertex fall away. The edges shrink to a fraction
    in a round, so few rounds are needed. A round's results are written, so that no lineage grows. Vertices with many
    edges cost no more than others: minima are combined before a shuffle.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "components-edges")
    both = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    followed = []
    while not edges.isEmpty():
        ways = edges.toDF("id", "next").union(edges.select("b", "a"))
        least = ways.groupBy("id").agg(F.least("id", F.min("next")).alias("next"))
        least = stored(least, "components-least")
        second = least.select(F.col("id").alias("next"), F.col("next").alias("to"))
        steps = stored(least.join(second, "next").select("id", "to"), "components-steps")
        followed.append(steps)
        for end in ("a", "b"):
            edges = edges.join(steps.toDF(end, "to"), end).drop(end).withColumnRenamed("to", end)
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = stored(edges.distinct(), "components-edges")
    found = both.select("id", F.col("id").alias("component"))
    for steps in followed:
        found = found.join(steps.withColumnRenamed("id", "component"), "component", "left")
        found = found.select("id", F.coalesce("to", "component").alias("component"))
    return found
