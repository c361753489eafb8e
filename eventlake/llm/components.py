"""Connected components of a link table, by smallest labels and pointer jumping, wholly in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node of its component.

    Each round takes the smallest label around a node and then the label of that label, so the number of rounds grows
    with the logarithm of the longest path. Nodes without links do not occur.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct()
    both = stored(both)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "n"), F.col("b") == F.col("n"))
        near = near.groupBy(F.col("a").alias("m")).agg(F.min("label").alias("around"))
        step = labels.join(near, F.col("node") == F.col("m")).select("node", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        jump = step.select(F.col("node").alias("j"), F.col("label").alias("next"))
        done = step.join(jump, F.col("label") == F.col("j"), "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        labels = stored(done)
        if labels.filter("old != label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
