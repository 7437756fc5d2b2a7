"""Joins: with a tiny side, by shuffled hash, by block, and sorted co-groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_within
from .keys import block_of, chunk_of

TINY_BYTES = 16 * 1024 * 1024


def join_tiny(big: DataFrame, tiny: DataFrame, on, tiny_bytes: int = TINY_BYTES) -> DataFrame:
    """Inner join that broadcasts ``tiny`` if it is seen to be tiny; else Spark's own choice."""
    return big.join(broadcast_within(tiny, tiny_bytes), on)


def join_shuffle_hash(probe: DataFrame, build: DataFrame, on) -> DataFrame:
    """Inner join by shuffled hash with ``build`` (one row per key) as the hash side."""
    return probe.join(build.hint("shuffle_hash"), on)


def join_by_block(left: DataFrame, right: DataFrame, blocks: int) -> DataFrame:
    """Join two frames on ``block``, both partitioned by it."""
    return left.repartition(blocks, "block").join(right.repartition(blocks, "block"), "block")


def user_positions(ratings: DataFrame, user_blocks: int, item_blocks: int, width: int) -> DataFrame:
    """Co-group of rating summaries with the sorted users of each block.

    A co-group holds the users of one id range of one block and at most ``item_blocks``
    summaries for each, so its size is bounded by width * item_blocks. The position runs on over
    the ranges of a block: a range starts where the counted ones before it end.
    Gives (block, chunk, user, position, n_item_blocks, first_item_block, n_ratings).
    """
    def keys(user: str) -> list[Column]:
        return [block_of(F.col(user), user_blocks).alias("block"),
                chunk_of(F.col(user), width, user_blocks).alias("chunk")]

    summaries = (ratings.groupBy("user", block_of(F.col("item"), item_blocks).alias("item_block"))
                 .agg(F.count("*").alias("n")).select(*keys("user"), "user", "item_block", "n"))
    # a name of its own keeps the two sides of the co-group apart
    listed = ratings.select(F.col("user").alias("member")).distinct().select(*keys("member"), "member")

    def place(rated: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        members = members.rename(columns={"member": "user"}).sort_values("user").reset_index(drop=True)
        members["position"] = members.index.astype("int64")
        facts = rated.groupby("user").agg(n_item_blocks=("item_block", "size"),
                                          first_item_block=("item_block", "min"),
                                          n_ratings=("n", "sum")).reset_index()
        return members.merge(facts, on="user")

    placed = summaries.groupBy("block", "chunk").cogroup(listed.groupBy("block", "chunk")).applyInPandas(
        place, "block BIGINT, chunk BIGINT, user BIGINT, position BIGINT, n_item_blocks BIGINT, "
               "first_item_block BIGINT, n_ratings BIGINT")
    before = Window.partitionBy("block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (listed.groupBy("block", "chunk").agg(F.count("*").alias("n"))  # one row per id range
              .select("block", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return (placed.join(starts, ["block", "chunk"]).withColumn("position", F.col("position") + F.col("start"))
            .drop("start"))
