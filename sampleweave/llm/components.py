"""Connected components of an edge table by rounds of large-star and small-star, each cut into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.session import cut


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over undirected (a, b) pairs, a > b.

    Large star: every neighbour above ``u`` is tied to the least of ``u`` and its neighbours. Small star: ``u`` and its
    neighbours below are tied to the least of these. The least is a plain ``min``; the members of a hub are never gathered.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        new = (seen.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        new = (edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
               .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return new.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the least node that is reachable.

    The rounds end when two in a row leave the same edges; the number of rounds grows with the logarithm of the
    longest path, and a round never has more edges than the one before it has edges and nodes.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = cut(star(star(now, large=True), large=False))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
