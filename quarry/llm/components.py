"""Connected components of a link table, by label propagation with pointer jumping over DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import path_of, remove, staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the smallest node reachable.

    Every round takes the smallest label among a node's neighbours and then that label's own label, so
    the longest path halves; each round's table is written to the shared folder and the last one's is
    removed. Joins and groupings are on nodes; a hub's rows are pre-aggregated before they move.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_label"))
        ahead = labels.select(F.col("node").alias("_node"), F.col("label").alias("_ahead"))
        new = staged(lower.join(ahead, F.col("_label") == F.col("_node"), "left").select("node", "_old", F.least("_label", "_ahead").alias("label")), "labels")
        moved = new.filter("label <> _old").limit(1).count()
        if labels.inputFiles():
            remove(links.sparkSession, path_of(labels))
        labels = new.select("node", "label") if moved else new
        if not moved:
            return new.select("node", "label")
