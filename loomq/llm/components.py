"""Connected components of a link table, by least labels and pointer jumping, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of links (a, b), labels being the least node of its component.

    A round gives each node the least label around it, then that label's own label; rounds go on until none changes.
    Each round is a written table, so lineage stays short and a lost executor costs one round at most.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = _shared.written(both, "links")
    labels = _shared.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(around, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = low.join(jump, "low").select("node", F.least("low", "further").alias("label"), "old")
        new = _shared.written(new, "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
