"""Orders, positions and rank comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from .keys import numbered

RANK_DIGITS = 9


def positions(ranks: DataFrame, identity: str, value: str) -> DataFrame:
    """(identity, position): place in ascending order of the rounded value, ties by id."""
    rough = ranks.select(identity, rounded(F.col(value), RANK_DIGITS).alias("_value"))
    return (numbered(rough, [F.col("_value").asc(), F.col(identity).asc()])
            .select(identity, "position"))


def rank_difference(left: DataFrame, right: DataFrame, identity: str, value: str) -> DataFrame:
    """|position in left - position in right| per id; NULL where one side lacks the id."""
    a = positions(left, identity, value).withColumnRenamed("position", "position_a")
    b = positions(right, identity, value).withColumnRenamed("position", "position_b")
    return (a.join(b, identity, "full_outer")
            .withColumn("difference", F.abs(F.col("position_a") - F.col("position_b"))))


def strongest(weights: DataFrame, k: int) -> DataFrame:
    """The k greatest and the k least weights, as (side, feature, weight)."""
    top = weights.orderBy(F.desc("weight"), "feature").limit(k).withColumn("side", F.lit("positive"))
    low = weights.orderBy(F.asc("weight"), "feature").limit(k).withColumn("side", F.lit("negative"))
    return top.unionByName(low).select("side", "feature", "weight")
