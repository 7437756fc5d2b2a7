"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating; a target is the source's share of all words, at
most ``max_repeats`` times its own size, what is too much being shared anew by weight (water filling).
Draws: a source is hashed into blocks of about ``block_words`` words. A target of 2.3 sizes takes two whole passes over the
blocks and, of a third pass in another permuted order, the blocks up to the 0.3; the last block gives its first documents in
hash order, and the last document its first words, so a source's words meet its target exactly.
Shards: the output has shards of about ``shard_words`` words. A binary tree over the shards splits the vector of block
quotas: the left half of a node's shards gets a multivariate-hypergeometric draw of its blocks, the right half the rest, so
the quotas of all shards add up exactly. Each shard walks its own path from the root with a generator seeded by the
node, so no task and not the driver sees more than one number per source. A shard's blocks of a source are a range of the
source's permuted order: disjoint by construction. Within a shard the documents are ordered by a hash.

Defined results: a null text has size 0 and, like every text without words, is never taken; a null source is a source
of its own; repeated rows are drawn one by one; an empty table gives an empty mix. Nothing depends on partitions or clocks:
rows that tie in every hash are equal rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleweave.llm.common import column
from sampleweave.operators.keys import numbered
from sampleweave.session import cut


ROW = "__mix_row"


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (5, 2, 1)
    max_repeats: int = 3
    block_words: int = 20_000
    shard_words: int = 1_000_000
    seed: int = 7
    prefix_width: int = 1024  # blocks summed by one group of the running sums


@F.pandas_udf(T.LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """bytes.split without argument parts at exactly the six ASCII white spaces."""
    return texts.map(lambda b: len(b.split()) if b else 0).astype("int64")


def permuted(index: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A seeded permutation of 0..size-1 at ``index``: a four-round Feistel network, walked until it is in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(int) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        h, m, s = half[todo], mask[todo], salt[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for k in range(4):
            x = (right + s + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x >> np.uint64(29)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def permuted_position(index: pd.Series, size: pd.Series, salt: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), salt.to_numpy()))


def sized(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, source, size, mark) per row; ``row_id`` is unique within this table, ``mark`` a hash of the row.

    A column ``ROW`` of ``docs`` is kept as the row's number.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    doc_id, source, text = column(docs, "doc_id", "long"), column(docs, "source", "string"), column(docs, "text", "string")
    return cut(docs.select(row.alias("row_id"), doc_id.alias("doc_id"), source.alias("source"), word_count(text.cast("binary")).alias("size"),
                           F.xxhash64(doc_id, source, text).alias("mark")))


def targets(rows: DataFrame, s: MixSettings) -> DataFrame:
    """(key, source, source_size, target, quota, passes, rest, blocks) per source; ``key`` is its place from 0."""
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = cut(numbered(own, [F.col("source").asc_nulls_last()], "key").withColumn("key", F.col("key") - 1))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, s.weights))), (F.col("key") % len(s.weights) + 1).cast("int")))
    room = F.col("source_size") * s.max_repeats
    total = own.agg(F.sum("source_size")).head()[0] or 0
    level, full = 0.0, -1
    while True:  # each turn at least one more source is full, or it is the last
        is_full = room <= F.lit(level) * F.col("weight")
        seen = own.agg(F.sum(F.when(is_full, room).otherwise(0)).alias("used"), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("weight"),
                       F.count_if(is_full).alias("full")).head()
        if seen.full == full or not seen.weight:
            break
        full, level = seen.full, (total - seen.used) / seen.weight
    goal = F.when(room <= F.lit(level) * F.col("weight"), room.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    quota = F.least(F.round("target").cast("long"), room)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)
    out = own.withColumn("target", goal).withColumn("quota", quota).withColumn("passes", passes.cast("long"))
    out = out.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / s.block_words)).cast("long")
    return cut(out.select("key", "source", "source_size", "target", "quota", "passes", "rest", blocks.alias("blocks")))


def running(rows: DataFrame, by: str, at: str, value: str, width: int) -> DataFrame:
    """``before``: the sum of ``value`` over smaller ``at`` of the same ``by``, in two levels so that no group is long."""
    rows = rows.withColumn("part", F.floor(F.col(at) / width))
    sums = rows.groupBy(by, "part").agg(F.sum(value).alias("part_sum"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("part_before", F.coalesce(F.sum("part_sum").over(before), F.lit(0))).drop("part_sum")
    own = Window.partitionBy(by, "part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.join(sums, [by, "part"]).withColumn("before", F.col("part_before") + F.coalesce(F.sum(value).over(own), F.lit(0)))
            .drop("part", "part_before"))


def block_draws(placed: DataFrame, goals: DataFrame, s: MixSettings) -> DataFrame:
    """(key, slot, block, epoch, words, take): the blocks in the order in which the source gives them."""
    salt = F.xxhash64(F.lit(s.seed), "key", "epoch")
    blocks = placed.groupBy("key", "block").agg(F.sum("size").alias("words")).join(goals.select("key", "passes", "rest", "blocks"), "key")
    # a block that got no document has no row; its position stays empty and gives nothing
    all_passes = cut(blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
                     .withColumn("position", permuted_position("block", "blocks", salt)))
    whole = all_passes.where("epoch < passes").withColumn("take", F.col("words"))
    part = running(all_passes.where("epoch = passes and rest > 0"), "key", "position", "words", s.prefix_width)
    part = part.where("before < rest").withColumn("take", F.least(F.col("words"), F.col("rest") - F.col("before"))).drop("before")
    return cut(whole.unionByName(part).where("take > 0")
               .select("key", (F.col("epoch") * F.col("blocks") + F.col("position")).alias("place"), "block", "epoch", "words", "take"))


def split(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) per source of the blocks that the tree gives to ``shard`` of ``shards``."""
    own, start, low, high = quotas.astype(np.int64), np.zeros(len(quotas), np.int64), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left_size = int(own.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, left_size, method="marginals")
        if shard < middle:
            own, high = left, middle
        else:
            own, start, low = own - left, start + left, middle
    return start, own


def shard_slots(draws: DataFrame, s: MixSettings) -> DataFrame:
    """(key, slot, shard): which shard gets the source's block number ``slot``."""
    seen = draws.groupBy("key").agg(F.count("*").alias("n"), F.sum("take").alias("words")).orderBy("key").collect()  # one row per source
    keys, quotas = np.array([r["key"] for r in seen], np.int64), np.array([r.n for r in seen], np.int64)
    shards = max(1, math.ceil(sum(r.words for r in seen) / s.shard_words))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                start, count = split(quotas, shards, int(shard), s.seed)
                has = count > 0
                yield pd.DataFrame({"key": keys[has], "start": start[has], "n": count[has], "shard": int(shard)})

    spread = draws.sparkSession.range(shards).mapInPandas(walk, "key long, start long, n long, shard long")
    return spread.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("slot"), "shard")


def mixed(rows: DataFrame, goals: DataFrame, s: MixSettings) -> DataFrame:
    """(shard, place, row_id, epoch, words): one row for every time a document is written into the mix."""
    placed = cut(rows.join(goals.select("key", "source", "blocks").withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
                 .select("row_id", "size", "mark", "key", F.pmod(F.xxhash64(F.lit(s.seed), "mark"), "blocks").alias("block")))
    draws = block_draws(placed, goals, s)
    order = running(draws.withColumn("one", F.lit(1)), "key", "place", "one", s.prefix_width).withColumnRenamed("before", "slot")
    given = cut(order.join(shard_slots(draws, s), ["key", "slot"]).select("key", "block", "shard", "epoch", "words", "take"))
    # within a block (bounded by hashing) the first documents in hash order fill what is taken of it
    before = Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64(F.lit(s.seed), "mark", "epoch"), "mark", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = (placed.where("size > 0").join(given, ["key", "block"]).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
            .withColumn("words_taken", F.least(F.col("size"), F.col("take") - F.col("before"))).where("words_taken > 0"))
    return docs.select("shard", F.xxhash64(F.lit(s.seed), "shard", "epoch", "mark").alias("place"), "row_id", "epoch", F.col("words_taken").alias("words"))


def mix(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, and the number of shards that hold the document."""
    rows = sized(docs)
    goals = targets(rows, settings)
    got = mixed(rows, goals, settings).groupBy("row_id").agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("n_shards"))
    known = rows.join(goals.select(F.col("source").alias("own"), "source_size", "target"), F.col("source").eqNullSafe(F.col("own")))
    return known.join(got, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                                                   F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"))


def first_words(text: str, words: int) -> str:
    """The text up to the end of its ``words``-th word."""
    data, at = text.encode("utf-8", "surrogatepass"), 0
    space = b" \t\n\x0b\x0c\r"
    for _ in range(words):
        while at < len(data) and data[at] in space:
            at += 1
        while at < len(data) and data[at] not in space:
            at += 1
    return data[:at].decode("utf-8", "surrogatepass")


@F.pandas_udf(T.StringType())
def leading_words(texts: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([first_words(t, int(w)) for t, w in zip(texts, words, strict=True)], dtype=object)


def mixture(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mix itself: every column of ``docs``, a row as often as it is taken, in shard order within a partition.

    At most one document of a source is taken in part; its text ends after the taken words and ``n_chars`` follows.
    """
    own = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    rows = sized(own)
    plan = (mixed(rows, targets(rows, settings), settings).join(rows.select("row_id", "size"), "row_id")
            .select(F.col("row_id").alias(ROW), F.col("words").alias("__words"), F.col("size").alias("__size")))
    out = own.join(plan, ROW)
    short = F.col("__words") < F.col("__size")
    cut_text = leading_words(F.when(short, F.col("text")).otherwise(""), F.col("__words"))
    out = out.withColumn("text", F.when(short, cut_text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(short, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))
