"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node that node reaches. Each round takes the smallest label among
    neighbours, then the label's own label, so paths halve; labels and links stay distributed."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = materialize(both.union(both.select("other", "node")).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        met = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialize(met.join(ahead, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if labels.filter("was <> label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
