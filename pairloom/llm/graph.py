"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014); every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links(a, b), longs; root is the least node that is reachable. Loops and repeats are fine."""
    edges = C.stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark["n"] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        # written, so that Spark may divide a node with many links in the join
        least = C.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = C.stored(large, "large-star")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = C.stored(small, "small-star")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
