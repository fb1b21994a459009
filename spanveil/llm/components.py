"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.plans.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the smallest neighbour of u."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = down.join(least, down["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, with that smallest.

    ``edges`` are (a, b) in any direction, repeated or not. Minima are reduced
    on the map side; each round is written to the shared folder, so that no
    lineage grows and no executor's memory is needed again.
    """
    now = stored(edges.where("a <> b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        now = stored(_small_star(_large_star(now)), "stars")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return now
        mark = seen
    raise RuntimeError("the components did not settle")
