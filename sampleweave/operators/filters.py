"""Projection, filter, distinct and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL_LIST = 1_000


def exclude(df: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """Drop rows whose ``column`` is one of ``names`` (trimmed; None means no name)."""
    names = sorted({n.strip() for n in names or [] if n.strip()})
    if not names:
        return df
    if len(names) <= LITERAL_LIST:
        return df.filter(~F.col(column).isin(names))
    listed = df.sparkSession.createDataFrame([(n,) for n in names], f"{column} STRING")
    return df.join(listed, column, "left_anti")


def transpose_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("item").alias("user"), F.col("user").alias("item"), "rating")


def union_sum(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Union of two frames, reduced by sum per key."""
    return left.unionByName(right).groupBy(*keys).agg(F.sum(value).alias(value))


def flatten_pair(df: DataFrame, pair: str, *rest: str) -> DataFrame:
    return df.select(f"{pair}.*", *rest)


def first_features(cells: DataFrame, dictionary: DataFrame, most: int) -> DataFrame:
    """Cells of the first ``most`` features of the dictionary."""
    kept = dictionary.filter(F.col("feature_idx") <= most).select("feature")
    return cells.join(kept, "feature", "left_semi")


def random_features(dictionary: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """A seeded random subset of ``count`` features, the same on every run."""
    draw = F.md5(F.concat_ws(":", F.col("feature"), F.lit(str(seed))).cast("binary"))
    return dictionary.select("feature").orderBy(draw, "feature").limit(count)


def group_cells(cells: DataFrame, group: str | Column) -> DataFrame:
    return cells.filter(F.col("grp") == group)
