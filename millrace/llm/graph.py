"""Connected components by label propagation with pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b): the smallest node that it reaches.

    Each round takes the smallest label among neighbours, then the label of that label, and is written to the shared
    folder. Sums are partial before the exchange; a hub's joins are plain inner joins, which adaptive execution splits.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "low").alias("l"))
        lower = cut(lower, "lower")
        if lower.filter("l < was").limit(1).count() == 0:
            discard(both, lower)
            return labels
        jump = lower.select(F.col("node").alias("l"), F.col("l").alias("label"))
        discard(labels)
        labels = cut(lower.join(jump, "l").select("node", "label"), "labels")
        discard(lower)
