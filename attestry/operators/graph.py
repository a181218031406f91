"""Connected components and clusters of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable. edges: (a long, b long), in either direction.

    Every round each node takes the least label of itself and its neighbours, then that label's own label, and is
    written to the shared folder. Minima are combined before the shuffle, so a hub burdens no task.
    """
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).select(F.col("a").alias("id"), "c"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("id").alias("k"), F.col("c").alias("up"))
        new = stored(step.join(up, F.col("c") == F.col("k"), "left").select("id", "old", F.least("c", "up").alias("c")), "labels")
        if not new.where("old <> c").limit(1).count():
            return new.select("id", F.col("c").alias("component"))
        labels = new.select("id", "c")


def clusters(edges: DataFrame, least: int = 3) -> DataFrame:
    """(id, component, size) of the components with at least ``least`` members."""
    c = components(edges)
    sizes = c.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return c.join(sizes, "component").select("id", "component", "size")
