"""Connected components by minimum labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every identifier in ``edges(a, b)``; the component is its smallest id.

    Each round takes the smallest label among a vertex and its neighbours (an aggregation, so a hub
    is combined before it moves), then jumps to that label's own label. Rounds are written to the
    shared folder, which cuts lineage. Labels only ever fall, so it ends; the number of rounds grows
    with the logarithm of a component's diameter.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), "cc-labels")
    held = labels
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        to = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        jumped = hooked.join(to, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "was")
        done = materialise(jumped, "cc-labels")
        discard(held)
        held, labels = done, done.select("id", "label")
        if done.where("label <> was").isEmpty():
            discard(both)
            return labels.withColumnRenamed("label", "component")
