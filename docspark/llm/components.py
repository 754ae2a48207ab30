"""Connected components by alternating large-star and small-star steps on a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, root): root is the smallest node of the component; nodes without edges are absent.

    Each round links a node's larger neighbours to its smallest neighbour (large star), then its smaller neighbours
    and itself to the smallest (small star). The edge count never grows, every step is an aggregate that combines
    before its shuffle and an equi-join that adaptive execution can split at hub nodes, and each round's edges are
    written to the shared folder. The driver sees two numbers a round, and ends when a round changes nothing, which takes
    a number of rounds of the order of the square of the logarithm of the nodes. Self-loops and repeated edges do no harm.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # each node with all its neighbours
            pairs = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        else:  # each node with its smaller neighbours
            pairs = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = pairs.join(least, "u")
        if large:
            out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        e = stored(star(star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
