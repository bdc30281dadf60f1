"""Connected components of a link table by alternating minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_copy


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (v, c): for each node of a link the smallest node that links reach.

    Each round takes the smallest label among the neighbours and then the label of that label,
    until a round changes nothing; the number of rounds grows with the logarithm of a
    component's width. A node with very many links is pre-aggregated (min) before its shuffle;
    every round ends in a checkpoint, and only the count of changed rows goes to the driver.
    """
    edges = keep_copy(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = keep_copy(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).withColumn("c", F.least("v", "c")))
    while True:
        near = (edges.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("x")))
        best = label.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "x").alias("c"))
        jump = label.select(F.col("v").alias("c"), F.col("c").alias("y"))
        new = keep_copy(best.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("y", "c")).alias("c")))
        changed = not new.filter(F.col("old") != F.col("c")).isEmpty()
        label = new.select("v", "c")
        if not changed:
            return label
