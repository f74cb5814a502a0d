"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): every end of an edge (columns a and b) with the smallest id it can reach.

    Rounds of two steps, until nothing changes: each vertex links its larger neighbours to its smallest
    neighbour, then its smaller neighbours. Hubs are joined on their key, which adaptive execution can split; a
    round is a written table. The number of rounds grows with the logarithm of the longest path.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > k AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = durable(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = durable(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == state:
            return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())
        state = now
