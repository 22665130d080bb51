"""Connected components of a distributed graph, for the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import cut, dropped


#: Edges that one task works on, either way counted.
EDGES = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that it reaches.

    Each round takes the least label among neighbours and then the label of one's label, which
    halves the way that is left. Labels are written to the shared folder after either step, so a lost
    executor costs a round at most, and joins on a label that very many nodes carry can be split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = cut(both, "edges")
    # Few edges need few tasks, however many partitions the session deals shuffles to.
    tasks = 1 + both.count() // EDGES
    few = lambda df: df.coalesce(tasks)
    labels = cut(few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))), "labels")
    while True:
        near = few(both.join(labels, F.col("b") == F.col("node")).select("a", "root")).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        moved = cut(few(moved), "labels")
        up = moved.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = moved.join(up, F.col("root") == F.col("up")).select("node", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("fresh"))
        jumped = cut(few(jumped), "labels")
        dropped(labels, moved)
        labels = jumped
        if jumped.where("fresh").isEmpty():
            dropped(both)
            return labels.drop("fresh")
