"""Feature statistics, correlation and correlation networks of a zero-filled matrix."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..session import cut

FEATURE_BLOCK = 256
SAMPLE_CHUNK = 4_096
CORRELATION_DIGITS = 9
TREE_FAN = 8


def feature_stats(cells: DataFrame, n_samples: int) -> DataFrame:
    """(feature, n_given, mean, centered_norm), absent cells counting as zero.

    ``centered_norm`` is the root of the sum of squared deviations, not divided by n.
    """
    given = cells.groupBy("feature").agg(
        F.count("value").alias("n_given"), F.avg("value").alias("given_mean"),
        (F.var_pop("value") * F.count("value")).alias("given_squares"))
    mean = F.col("given_mean") * F.col("n_given") / F.lit(float(n_samples))
    squares = (F.col("given_squares")
               + F.col("n_given") * F.pow(F.col("given_mean") - F.col("mean"), 2)
               + (F.lit(n_samples) - F.col("n_given")) * F.pow(F.col("mean"), 2))
    # a feature given everywhere has no zero cells: its mean is the given mean itself
    mean = F.when(F.col("n_given") == n_samples, F.col("given_mean")).otherwise(mean)
    return (given.withColumn("mean", mean)
            .select("feature", "n_given", "mean", F.sqrt(squares).alias("centered_norm")))


@dataclass(frozen=True)
class PairSums:
    """Sum of a*b for every feature pair, as one packed matrix per pair of blocks; and the dictionary."""

    products: DataFrame    # block_a, block_b, product
    dictionary: DataFrame  # feature, block, pos

    def pairs(self, facts: DataFrame, n_samples: int, least: float | None = None) -> DataFrame:
        """(feature_a, feature_b, total, cross, correlation) of the unordered pairs, from (feature, rest, centered_norm).

        With ``least``, only pairs whose |correlation| is not below it (but for rounding) leave the task that
        holds their matrix; there is no row for any other pair.
        """
        entry = F.struct("pos", "feature", "rest", "centered_norm")
        known = self.dictionary.join(facts, "feature").groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("es"))
        part = lambda name: F.transform("es", lambda e: e[name])
        rows = self.products
        for side in "ab":
            rows = rows.join(known.select(F.col("block").alias(f"block_{side}"), part("feature").alias(f"names_{side}"),
                                          part("rest").alias(f"rest_{side}"), part("centered_norm").alias(f"norm_{side}")), f"block_{side}")

        def unpack(group: pd.DataFrame) -> pd.DataFrame:
            row = group.iloc[0]
            rest_a, rest_b, norm_a, norm_b = (np.asarray(row[c], dtype=float) for c in ("rest_a", "rest_b", "norm_a", "norm_b"))
            total = np.frombuffer(row["product"]).reshape(len(rest_a), len(rest_b))
            cross = total - n_samples * np.outer(rest_a, rest_b)
            norms = np.outer(norm_a, norm_b)
            correlation = np.divide(cross, norms, out=np.full_like(cross, np.nan), where=norms != 0)
            keep = np.ones(cross.shape, bool) if least is None else np.abs(correlation) > least - 10.0 ** (1 - CORRELATION_DIGITS)
            if row["block_a"] == row["block_b"]:
                keep = np.triu(keep)
            i, j = np.nonzero(keep)
            return pd.DataFrame({"feature_a": np.asarray(row["names_a"], dtype=object)[i], "feature_b": np.asarray(row["names_b"], dtype=object)[j],
                                 "total": total[i, j], "cross": cross[i, j], "correlation": correlation[i, j]})

        kind = self.dictionary.schema["feature"].dataType.simpleString()
        return rows.groupBy("block_a", "block_b").applyInPandas(
            unpack, f"feature_a {kind}, feature_b {kind}, total DOUBLE, cross DOUBLE, correlation DOUBLE")


def added_up(parts: DataFrame, n_chunks: int, fan: int = TREE_FAN) -> DataFrame:
    """Packed products added over the chunks, ``fan`` at a time, so that a task never holds more than that."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group["product"].iloc[0]).copy()
        for more in group["product"].iloc[1:]:
            total += np.frombuffer(more)
        return pd.DataFrame({"block_a": group["block_a"].iloc[:1], "block_b": group["block_b"].iloc[:1],
                             "chunk": group["chunk"].iloc[:1], "product": [total.tobytes()]})

    while n_chunks > 1:
        parts = (parts.withColumn("chunk", F.floor(F.col("chunk") / fan).cast("int")).groupBy("block_a", "block_b", "chunk")
                 .applyInPandas(add, "block_a INT, block_b INT, chunk INT, product BINARY"))
        n_chunks = ceil(n_chunks / fan)
    return parts.select("block_a", "block_b", "product")


def pair_sums(cells: DataFrame, features: DataFrame, n_samples: int, column: str = "value",
              block: int = FEATURE_BLOCK, chunk: int = SAMPLE_CHUNK) -> PairSums:
    """Sum over all samples of a*b for every pair of features, as products of matrix blocks.

    Features fall into blocks and samples into chunks; one task group multiplies one pair of
    feature blocks over one chunk, so a group is bounded by 2 * block * chunk cells whatever the
    data, and each cell is shipped once per feature block instead of once per partner feature.
    A group gives one packed matrix, and these are added chunk-wise in a tree. ``cells`` is read once
    per use and should be a table.
    """
    n_blocks = max(1, ceil(features.count() / block))
    n_chunks = max(1, ceil(n_samples / chunk))
    in_block = Window.partitionBy("block")
    dictionary = cut(
        features.select("feature", F.pmod(F.xxhash64("feature"), F.lit(n_blocks)).cast("int").alias("block"))
        .withColumn("pos", F.row_number().over(in_block.orderBy("feature")) - 1))
    # one number per block
    widths = {r["block"]: r["width"] for r in
              dictionary.groupBy("block").agg(F.count("*").alias("width")).collect()}

    placed = cells.join(dictionary, "feature").select(
        "sample_id", "block", "pos", F.col(column).alias("z"),
        F.pmod(F.xxhash64("sample_id"), F.lit(n_chunks)).cast("int").alias("chunk"))
    partners = F.transform(
        F.sequence(F.lit(0), F.lit(n_blocks - 1)),
        lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    shipped = (placed.withColumn("pair", F.explode(partners))
               .select("pair.a", "pair.b", "chunk", "sample_id", "block", "pos", "z"))

    def filled(group: pd.DataFrame, rows: np.ndarray, n_rows: int, of: int) -> np.ndarray:
        mine = (group["block"] == of).to_numpy()
        matrix = np.zeros((n_rows, widths[of]))
        matrix[rows[mine], group["pos"].to_numpy()[mine]] = group["z"].to_numpy()[mine]
        return matrix

    def multiply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[0]), int(key[1])
        rows, ids = pd.factorize(group["sample_id"])
        left = filled(group, rows, len(ids), a)
        right = left if a == b else filled(group, rows, len(ids), b)
        return pd.DataFrame({"block_a": [a], "block_b": [b], "chunk": [int(key[2])], "product": [(left.T @ right).tobytes()]})

    if set(widths) != set(range(n_blocks)):
        # a block without features has no cells of its own, so it must not be asked for
        shipped = shipped.filter(F.col("a").isin(list(widths)) & F.col("b").isin(list(widths)))
    parts = shipped.groupBy("a", "b", "chunk").applyInPandas(
        multiply, "block_a INT, block_b INT, chunk INT, product BINARY")
    return PairSums(added_up(parts, n_chunks), dictionary)


def in_name_order(pairs: DataFrame) -> DataFrame:
    """Unordered pairs as (feature_a, feature_b, ...) with feature_a <= feature_b."""
    return (pairs.withColumn("_a", F.least("feature_a", "feature_b"))
            .withColumn("feature_b", F.greatest("feature_a", "feature_b"))
            .withColumn("feature_a", F.col("_a")).drop("_a"))


def feature_products(cells: DataFrame, block: int = FEATURE_BLOCK, chunk: int = SAMPLE_CHUNK) -> DataFrame:
    """(feature_a, feature_b, product): sum over samples of a*b, upper triangle with diagonal."""
    cells = cut(cells.select("sample_id", "feature", "value"))
    features = cells.select("feature").distinct()
    sums = pair_sums(cells, features, cells.select("sample_id").distinct().count(), "value", block, chunk)
    plain = features.select("feature", F.lit(0.0).alias("rest"), F.lit(1.0).alias("centered_norm"))
    return in_name_order(sums.pairs(plain, 0)).select("feature_a", "feature_b", F.col("total").alias("product"))


def feature_pairs_stats(cells: DataFrame, block: int = FEATURE_BLOCK, chunk: int = SAMPLE_CHUNK,
                        least: float | None = None) -> DataFrame:
    """(feature_a, feature_b, cross, correlation), upper triangle with diagonal: every pair, or only those
    whose |correlation| may reach ``least``.

    ``cross`` is the sum of products of deviations; ``correlation`` is NULL for a constant feature.
    """
    cells = cut(cells.select("sample_id", "feature", "value"))
    n_samples = cells.select("sample_id").distinct().count()
    # A feature given in every sample is centred before the product, which keeps its digits;
    # one with zeros has a mean of the order of its spread and is centred after it.
    stats = cut(feature_stats(cells, n_samples).withColumn(
        "shift", F.when(F.col("n_given") == n_samples, F.col("mean")).otherwise(F.lit(0.0))))
    shifted = cells.join(stats.select("feature", "shift"), "feature").withColumn(
        "z", F.col("value") - F.col("shift"))
    facts = stats.select("feature", (F.col("mean") - F.col("shift")).alias("rest"), "centered_norm")
    pairs = pair_sums(shifted, stats.select("feature"), n_samples, "z", block, chunk).pairs(facts, n_samples, least)
    return in_name_order(pairs).select("feature_a", "feature_b", "cross", "correlation")


def correlation_network(cells: DataFrame, threshold: float = 0.9, include_self: bool = True,
                        block: int = FEATURE_BLOCK, chunk: int = SAMPLE_CHUNK) -> DataFrame:
    """Edges (src, dst, weight 1) between features whose |correlation| exceeds the threshold.

    Both directions are given, a self-loop once. The correlation is compared when rounded; an
    undefined one gives no edge.
    """
    rough = F.abs(rounded(F.col("correlation"), CORRELATION_DIGITS))
    hits = (feature_pairs_stats(cells, block, chunk, threshold)
            .filter((rough > threshold) & ~F.isnan("correlation"))
            .select("feature_a", "feature_b"))
    if not include_self:
        hits = hits.filter("feature_a <> feature_b")
    return both_directions(hits)


def both_directions(hits: DataFrame) -> DataFrame:
    """Edges (src, dst, weight 1) of unordered pairs (feature_a, feature_b); a pair of equal ones gives one edge."""
    ends = F.when(F.col("feature_a") == F.col("feature_b"),
                  F.array(F.struct(F.col("feature_a").alias("src"), F.col("feature_b").alias("dst")))
                  ).otherwise(F.array(
                      F.struct(F.col("feature_a").alias("src"), F.col("feature_b").alias("dst")),
                      F.struct(F.col("feature_b").alias("src"), F.col("feature_a").alias("dst"))))
    return hits.select(F.inline(ends)).withColumn("weight", F.lit(1.0))
