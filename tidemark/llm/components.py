"""Connected components of a table of links, by contraction: nothing but the loop's end test comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import discard, stage


def connected(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node of a link.

    Each round hooks every node to its smallest smaller neighbour, follows the
    hooks four steps, and replaces the ends of links by what they reached; links
    inside a component vanish.  Rounds are as the logarithm of the longest chain
    of rising ids; each is written, so a lost executor re-reads it, and dropped
    when the next one stands.  Links with a null end are ignored.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    read = [edges]
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        for _ in range(2):
            far = hook.select(F.col("node").alias("to"), F.col("to").alias("_far"))
            hook = hook.join(far, "to", "left").select("node", F.coalesce("_far", "to").alias("to"))
        hook = stage(hook, "hooks")
        moved = stage(_moved(labels, "component", hook), "labels")
        left = _moved(_moved(edges, "a", hook), "b", hook).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = stage(left, "links")
        discard(hook, *read)
        labels, edges, read = moved, left, [left, moved]
    return labels


def _moved(rows: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    to = hook.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    return rows.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")
