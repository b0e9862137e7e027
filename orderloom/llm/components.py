"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links`` (``a, b``): the smallest identifier reachable.

    Each round takes the smallest label among a node and its neighbours and then follows labels one
    step, so a chain shortens by halves. Minima fold before the shuffle; adaptive execution splits
    the joins on nodes with very many links. No links give an empty table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "low").alias("component"), F.col("component").alias("was"))
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = stored(lower.join(target, "component").select("id", F.least("component", "next").alias("component"), "was"))
        if jumped.filter("component <> was").isEmpty():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")
