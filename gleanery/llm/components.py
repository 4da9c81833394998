"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import written


def _least(edges: DataFrame, name: str) -> DataFrame:
    """Smallest number in the neighbourhood of each ``u``, itself included, as a table: its join with the edges can then be split where a node has very many."""
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges (a, b)``; root is the smallest node that can be reached.

    Each round points every node at the smallest neighbour it knows (Kiveris et
    al., "Connected Components in MapReduce and Beyond"). Edges are folded before
    each shuffle; nothing is gathered per component. Ends when a round changes no edge.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both, "large"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = _least(large, "small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = written(small, "small-star")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = tuple(row)
