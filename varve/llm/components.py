"""Connected components of links between ids, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id of ``links (a, b)``: the least id that it reaches.

    Each round takes the least label among an id and its neighbours and then
    the label of that label, so labels travel along long chains by doubling.
    The links and labels stay distributed, and each round cuts its lineage.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both.distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        step = checkpoint(step.join(jump, "next").select("id", F.col("component").alias("old"), F.least("next", "far").alias("component")))
        moved = step.where("old <> component").limit(1).count()
        labels = step.select("id", "component")
        if not moved:
            return labels
