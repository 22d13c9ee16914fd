"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.storage import scratch, written


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of the links (a, b), other than a root, and the least node that it reaches.

    Only neighbours' minima are combined and joined back; no node's neighbours are gathered, and hubs are split by
    adaptive execution. The number of steps grows with the logarithm of the longest chain.
    """
    with scratch() as block:
        edges, before = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"), None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            joined = large.join(least, "u")
            small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
            edges = written(small, "edges")
            state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if state == before:
                return block.out(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
            before = state
