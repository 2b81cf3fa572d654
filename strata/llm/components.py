"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (x, y); component is the smallest node reached.

    Each round takes the smallest label among the neighbours, then jumps to the label's label,
    so the number of rounds grows with the logarithm of the diameter. Every round is staged.
    An empty table gives an empty result; loops and repeated edges change nothing.
    """
    both = staged(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = staged(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        new = staged(low.join(jump, "low", "left").select("node", F.least("low", "jump").alias("component"), "was"), "labels")
        if new.filter("component < was").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
