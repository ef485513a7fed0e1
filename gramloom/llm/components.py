"""Connected components of a distributed edge list, by smallest labels and jumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) -> (node, label): label is the smallest node that can be reached.

    Each round takes the smallest label among neighbours (combined in map tasks, so that a
    hub is no hot group; a join on a hub's label is one that Spark can split), then jumps to
    that label's own label, which halves distances: the rounds needed grow with the
    logarithm of the longest path.  Every round is a written table, and rounds end when no
    label falls.
    """
    name = f"labels-{uuid.uuid4().hex[:8]}"
    both = scratch.put(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("n")).select("node", F.least("label", "heard").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("m"), F.col("label").alias("far"))
        stepped = lower.join(jump, F.col("low") == F.col("m"), "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "was")
        after = scratch.put(stepped, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = after.select("node", "label")
        if not after.filter("label <> was").limit(1).count():
            scratch.drop(f"{name}-edges")
            return labels
