"""Connected components by iterative joins: smallest labels spread over links, then labels jump to their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import remove, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """v, c: the smallest node that each node of the links (columns a, b) reaches."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    # The first round from the links themselves: the smallest neighbour.
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near")).select("v", F.least("v", "near").alias("c")), "labels")
    for _ in range(most_rounds):
        # A node takes the smallest label of its neighbours and of the node that its own label names.
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("near"))
        to = labels.select(F.col("v").alias("at"), F.col("c").alias("next"))
        now = labels.join(near, F.col("v") == F.col("a")).join(to, F.col("c") == F.col("at")).select("v", F.col("c").alias("was"), F.least("c", "near", "next").alias("c"))
        now = written(now, "labels")
        remove(labels)
        labels = now
        if labels.where("c <> was").isEmpty():
            remove(both)
            return labels.select("v", "c")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
