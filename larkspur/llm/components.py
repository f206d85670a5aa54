"""Connected components of an edge table, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): the least node reachable, for every node of an edge.

    Each round takes the least label among neighbours and then the label's label, so paths shrink by
    doubling; it ends when a round changes nothing. Every join has written tables on both sides, so a
    hub's rows can be split among tasks, and every minimum is taken partly before its shuffle. Edges
    with a null end are ignored.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = both.select("a", "b").union(both.select("b", "a")).distinct()
    kind = both.schema["a"].dataType
    both = materialize(both, "edges")
    if not both.limit(1).count():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast(kind).alias("old"))
        near = materialize(heard.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        far = near.join(near.select(F.col("node").alias("n"), F.col("label").alias("further")), F.col("label") == F.col("n"))
        new = materialize(far.select("node", F.col("further").alias("label"), "old"), "labels")
        drop(near, labels)
        labels = new
        if not new.where("label <> old").limit(1).count():
            drop(both)
            return new.select("node", F.col("label").alias("component"))
