"""Connected components of a link table by rounds of minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm._common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the smallest id reachable.

    Each round gives every id the smallest label of its neighbours and then the label of that label;
    labels are stored each round, so the plan does not grow. It ends when no label changes.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct().where("a <> b"), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["node"], "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        root = labels.select(F.col("id").alias("root"), F.col("component").alias("jump"))
        new = lower.join(root, lower["label"] == root["root"], "left").select("id", "old", F.least("label", "jump").alias("component"))
        new = stored(new, "labels")
        labels = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return labels
