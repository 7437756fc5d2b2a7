"""Counts, sums, bounded lists and block reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import LIST_WIDTH, block_of, chunk_of


def count_pairs(reads: DataFrame, *keys: str) -> DataFrame:
    """Rows per key: partial count before the shuffle, final count after it."""
    return reads.groupBy(*keys).agg(F.count("*").alias("n"))


def count_pairs_salted(reads: DataFrame, *keys: str, salts: int = 32) -> DataFrame:
    """The same in two shuffles: first per (key, salt), so that the partial counts of a key that
    every map task has seen are merged by ``salts`` tasks. A map task uses one salt, so its own
    partial count still yields one row per key."""
    salted = (reads.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy(*keys, "_salt").agg(F.count("*").alias("n")))
    return salted.groupBy(*keys).agg(F.sum("n").alias("n"))


def top_per_group(counts: DataFrame, group: str, item: str, count: str, k: int) -> DataFrame:
    """The k greatest counts per group. Spark cuts each group to k rows before the shuffle too."""
    order = Window.partitionBy(group).orderBy(F.desc(count), F.asc(item))
    return (counts.withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= k)
            .withColumn("place", F.col("place").cast("long")))


def top_as_text(top: DataFrame, group: str, item: str, count: str) -> DataFrame:
    """The k rows of each group as one line, ``(item,count), ...`` in order of their place."""
    entry = F.struct("place", F.format_string("(%s,%d)", F.col(item), F.col(count)).alias("entry"))
    return top.groupBy(group).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["entry"]), ", ")
        .alias("top_items"))


def sum_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """Element-wise sum over all rows, as (pos, total)."""
    return (vectors.select(F.posexplode(column).alias("pos", "value"))
            .groupBy("pos").agg(F.sum("value").alias("total")))


def lists(rows: DataFrame, key: str, identity: str, entry: Column, width: int = LIST_WIDTH) -> DataFrame:
    """(key, chunk, n, entries): the entries of each key in id order.

    ``(key, identity)`` must be unique. A key's entries are split by id range, so no list is
    longer than ``width`` even if one key holds a third of all rows; most keys have one chunk.
    """
    listed = rows.select(key, chunk_of(F.col(identity), width).alias("chunk"),
                         F.struct(F.col(identity).alias("id"), entry.alias("entry")).alias("e"))
    return (listed.groupBy(key, "chunk")
            .agg(F.count("*").alias("n"), F.sort_array(F.collect_list("e")).alias("es"))
            .select(key, "chunk", "n", F.transform("es", lambda e: e["entry"]).alias("entries")))


def adjacency(links: DataFrame, width: int = LIST_WIDTH) -> DataFrame:
    """Targets of each source as ``dst:times``; a link given twice counts twice."""
    pairs = links.groupBy("src", "dst").agg(F.count("*").alias("times"))
    entry = F.concat_ws(":", F.col("dst").cast("string"), F.col("times").cast("string"))
    return lists(pairs, "src", "dst", entry, width)


def ratings_by_user(ratings: DataFrame, width: int = LIST_WIDTH) -> DataFrame:
    """Ratings of each user as structs (item, rating)."""
    return lists(ratings, "user", "item", F.struct("item", "rating"), width)


def users_per_block(ratings: DataFrame, blocks: int, width: int = LIST_WIDTH) -> DataFrame:
    """Sorted distinct users of each block, in id-range chunks: (block, chunk, users)."""
    users = ratings.select("user").distinct()
    return (users.select(block_of(F.col("user"), blocks).alias("block"),
                         chunk_of(F.col("user"), width, blocks).alias("chunk"), "user")
            .groupBy("block", "chunk").agg(F.sort_array(F.collect_list("user")).alias("users")))


def shipments(ratings: DataFrame, user_blocks: int, item_blocks: int) -> DataFrame:
    """Distinct (user, item block): which user vector is needed by which item block."""
    return (ratings.select("user", block_of(F.col("item"), item_blocks).alias("item_block")).distinct()
            .select(block_of(F.col("user"), user_blocks).alias("user_block"), "user", "item_block"))


def out_links(ratings: DataFrame, user_blocks: int, item_blocks: int) -> DataFrame:
    """Item blocks each user vector must be sent to; at most ``item_blocks`` per user."""
    return (shipments(ratings, user_blocks, item_blocks).groupBy("user_block", "user")
            .agg(F.sort_array(F.collect_list("item_block")).alias("item_blocks")))


def in_links(ratings: DataFrame, user_blocks: int, item_blocks: int, width: int = LIST_WIDTH) -> DataFrame:
    """For each user block and item: the raters and their ratings, in user-range chunks."""
    return (ratings.select(block_of(F.col("user"), user_blocks).alias("user_block"),
                           block_of(F.col("item"), item_blocks).alias("item_block"), "item",
                           chunk_of(F.col("user"), width, user_blocks).alias("chunk"),
                           F.struct("user", "rating").alias("entry"))
            .groupBy("user_block", "item_block", "item", "chunk")
            .agg(F.sort_array(F.collect_list("entry")).alias("entries")))


def block_traffic(ratings: DataFrame, user_blocks: int, item_blocks: int) -> DataFrame:
    """Vectors shipped between blocks, users to items and items to users."""
    forth = (shipments(ratings, user_blocks, item_blocks)
             .groupBy(F.col("user_block").alias("from_block"), F.col("item_block").alias("to_block"))
             .agg(F.count("*").alias("vectors")).withColumn("direction", F.lit("users")))
    turned = ratings.select(F.col("item").alias("user"), F.col("user").alias("item"))
    back = (shipments(turned, item_blocks, user_blocks)
            .groupBy(F.col("user_block").alias("from_block"), F.col("item_block").alias("to_block"))
            .agg(F.count("*").alias("vectors")).withColumn("direction", F.lit("items")))
    return forth.unionByName(back)


def point_blocks(points: DataFrame, blocks: int, width: int = 4_096) -> DataFrame:
    """Points of each block in index-range chunks: (block, chunk, n_points, indices, label_sum)."""
    by_index = points.groupBy("index").agg(F.count("*").alias("n"), F.sum("label").alias("label_sum"))
    return (by_index.groupBy(block_of(F.col("index"), blocks).alias("block"),
                             chunk_of(F.col("index"), width, blocks).alias("chunk"))
            .agg(F.sum("n").alias("n_points"), F.sort_array(F.collect_list("index")).alias("indices"),
                 F.sum("label_sum").alias("label_sum")))
