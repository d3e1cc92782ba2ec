"""Connected components by alternating large-star and small-star rounds on a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b), where root is the component's smallest node.

    Nodes are of any orderable type. A round hangs neighbours below the smallest node that they see; the number of
    rounds grows with the logarithm of the longest chain. Only the smallest neighbour is aggregated (map-side first),
    so that a node with millions of links is never gathered in one place; the joins that spread it back are plain
    inner joins, which adaptive execution may split. Each round is written to the checkpoint folder. Links of a node
    with itself and repeated links change nothing; without links the result is empty.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        seen = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if seen == before:
            break
        before = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = durable(small.select("e.*").where("a <> b").distinct())
    below = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return below.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
