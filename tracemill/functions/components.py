"""Connected components of an edge table by spreading the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace, name: str, rounds: int | None = None) -> DataFrame:
    """(a, b) edges -> (node, component): the smallest node that each node reaches.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so chains
    shorten by half a round, until no label moves or ``rounds`` are over; what then has one label belongs
    together in any case. Labels are written every round; nothing is gathered on the driver. Smallest labels
    combine before their shuffle; a node with many neighbours, or a label that many nodes share, is a plain join
    key, which adaptive execution splits.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = work.table(f"{name}-edges", both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    start = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("component"))
    labels, k = work.table(f"{name}-0", start), 0
    while rounds is None or k < rounds:
        k += 1
        seen = (
            both.join(labels.select(F.col("node").alias("y"), "component"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("low"))
        over = labels.select(F.col("node").alias("low"), F.col("component").alias("over"))
        jumped = lower.join(over, "low").select(
            "node", F.least("low", "over").alias("component"), (F.least("low", "over") != F.col("component")).alias("moved")
        )
        stepped = work.table(f"{name}-{k}", jumped)
        moved = rounds is not None or stepped.where("moved").limit(1).count()
        labels = stepped.select("node", "component")
        work.drop(f"{name}-{k - 1}")
        if not moved:
            break
    work.drop(f"{name}-edges")
    return labels
