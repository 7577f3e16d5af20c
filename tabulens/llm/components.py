"""Connected components of an undirected graph given as edges, by turning every neighbourhood into a star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the least node that it is connected with.

    In turns, every node links its larger neighbours, then its smaller ones, to the least that it knows. Each step keeps
    the components and the number of edges does not grow; the steps needed grow with the logarithm of the longest path.
    A node of any degree is met by partial minima and joined back, so no task gathers a neighbourhood. Every step ends
    in a table in the shared folder.
    """
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links")
    while True:
        # Large stars: the larger neighbours of a node go to the least of its neighbours and itself.
        both = links.select(F.col("low").alias("node"), F.col("high").alias("other")).union(links.select(F.col("high").alias("node"), F.col("low").alias("other")))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("least").alias("low"), F.col("other").alias("high"))
        # Small stars: the smaller neighbours of a node, and itself, go to the least of them.
        large = large.where("low < high").distinct()
        floor = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(floor, "high").select(F.col("least").alias("low"), F.explode(F.array("low", "high")).alias("high"))
        after = written(small.where("low < high").distinct(), "links")
        # Done when no node stands on both sides and none has two roots.
        tangled = after.groupBy("high").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not tangled and not after.join(after.select(F.col("high").alias("low")), "low", "left_semi").limit(1).count():
            dropped(links)
            break
        dropped(links)
        links = after
    roots = after.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return after.select(F.col("high").alias("node"), F.col("low").alias("root")).union(roots)
