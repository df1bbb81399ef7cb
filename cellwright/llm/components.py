"""Connected components of an edge table, by spreading the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b), which may come in any order and often.

    Every round is a minimum that is reduced before it is shuffled, so a node with very many edges is no heavier than
    others. Rounds go on until no label changes; a chain takes about the logarithm of its length.
    """
    edges = cut(edges.select("a", "b"), "links")  # what found the links is not run twice
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("far"))
        near = both.join(far, "b").groupBy("a").agg(F.min("far").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        # What a node learns its label should know as well, and the other way round.
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        joined = spread.join(jump, F.col("next") == F.col("at"), "left")
        stepped = joined.select("node", F.col("label").alias("before"), F.least("next", F.coalesce("beyond", "next")).alias("label"))
        stepped = cut(stepped, "labels")
        labels = stepped.select("node", "label")
        if not stepped.where("label <> before").head(1):
            return labels.select("node", F.col("label").alias("component"))
