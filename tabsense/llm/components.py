"""Connected components of a link table, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import cut


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest node.

    Each round a node takes the smallest label among its neighbours and then
    the label of that label (pointer jumping), until nothing changes.  A hub's
    neighbours are folded by a partial aggregate, never listed.  Every round
    ends in a reliable checkpoint, so an executor loss repeats one round.
    """
    ends = links.select("a", "b").where("a <> b")
    both = cut(ends.union(ends.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("node"))
                .agg(F.min("b").alias("low"))
                .select("node", F.least("node", "low").alias("label")))
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        taken = label.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = taken.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = cut(taken.join(jump, "label").select(
            "node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("moved")))
        label = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return label.withColumnRenamed("label", "component")
