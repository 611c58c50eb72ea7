"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import written


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); a component is named by its smallest node.

    Each round sends every node to its smallest neighbour if that is smaller, replaces the links by
    links between the images and drops loops. Every node with links but the local minima vanishes,
    so the number of rounds grows with the logarithm of the largest component, and the tables shrink.
    Both sides of the joins are stored tables, so a node with very many links is split, not gathered.
    """
    links = links.filter(F.col("a") != F.col("b"))
    links = written(spark, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = written(spark, links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                    .select("node", F.col("node").alias("component")), "components")
    while not links.isEmpty():
        sent = written(spark, links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "sent")
        further = sent.select(F.col("node").alias("to"), F.col("to").alias("next"))
        sent = written(spark, sent.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "sent")
        at_a, at_b = (sent.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        links = links.join(at_a, "a", "left").select(F.coalesce("to_a", "a").alias("a"), "b")
        links = links.join(at_b, "b", "left").select("a", F.coalesce("to_b", "b").alias("b")).filter(F.col("a") != F.col("b"))
        links = written(spark, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        image = sent.select(F.col("node").alias("component"), "to")
        found = written(spark, found.join(image, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
    return found
