"""The correlation network of a completed matrix, from its factors: no cell of the matrix is made.

A completed cell is u . v, so the covariance of two features over a group of samples is v_a C v_b, where C is the sum of
(u - mean)(u - mean)' over the group: rank x rank numbers. With C = L L', a feature's correlations are the products of the unit vectors
L'v / |L'v|. Blocks of these meet by an equi-join, one row a pair of blocks, and the threshold is applied where their product lies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .als import matrix
from .statistics import CORRELATION_DIGITS, both_directions

FEATURE_BLOCK = 2048


def spread_of(users: DataFrame, rank: int) -> np.ndarray:
    """Sum of (u - mean)(u - mean)' over (id, factors). A task gives its own count, mean and sum; these few are put together here."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [moments(matrix(b.column("factors"), rank)) for b in batches if b.num_rows]
        if parts:
            n, mean, square = together(parts)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean], pa.list_(pa.float64())), pa.array([square.ravel()], pa.list_(pa.float64()))], ["n", "mean", "square"])

    rows = users.select("factors").mapInArrow(run, "n BIGINT, mean ARRAY<DOUBLE>, square ARRAY<DOUBLE>").collect()  # one row per task
    if not rows:
        return np.zeros((rank, rank))
    return together([(r["n"], np.array(r["mean"]), np.array(r["square"]).reshape(rank, rank)) for r in rows])[2]


Moments = tuple[int, np.ndarray, np.ndarray]


def moments(values: np.ndarray) -> Moments:
    mean = values.mean(axis=0)
    return len(values), mean, (values - mean).T @ (values - mean)


def together(parts: list[Moments]) -> Moments:
    """Moments of parts put together around their common mean, which keeps the digits that a difference of plain sums would lose."""
    total = sum(n for n, _, _ in parts)
    mean = sum(n * m for n, m, _ in parts) / total
    return total, mean, sum(s + n * np.outer(m - mean, m - mean) for n, m, s in parts)


def unit_blocks(items: DataFrame, spread: np.ndarray, block: int) -> DataFrame:
    """(block, names, units) of (feature, factors): unit vectors whose products are correlations. Features that do not vary are left out."""
    values, axes = np.linalg.eigh(spread)
    turn = axes * np.sqrt(np.maximum(values, 0.0))
    rank = len(spread)
    blocks = max(1, ceil(items.count() / block))
    kind = items.schema["feature"].dataType.simpleString()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("feature").combine_chunks()
        vectors = matrix(rows.column("factors").combine_chunks(), rank)
        own = vectors @ turn
        length = np.sqrt((own * own).sum(axis=1))
        varies = length > 1e-12 * np.sqrt((vectors * vectors).sum(axis=1) * max(values[-1], 0.0))
        names = rows.column("feature").combine_chunks().filter(pa.array(varies))
        units = (own[varies] / length[varies, None]).ravel()
        return pa.table({"block": [key[0].as_py()], "names": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                         "units": pa.array([units], pa.list_(pa.float64()))})

    rows = items.select("feature", "factors", F.pmod(F.xxhash64("feature"), F.lit(blocks)).cast("long").alias("block"))
    return cut(rows.groupBy("block").applyInArrow(pack, f"block BIGINT, names ARRAY<{kind}>, units ARRAY<DOUBLE>"))


def factor_network(users: DataFrame, items: DataFrame, rank: int, threshold: float = 0.9, include_self: bool = True,
                   block: int = FEATURE_BLOCK) -> DataFrame:
    """Edges (src, dst, weight 1) between the features of ``items`` (feature, factors) whose |correlation| over ``users`` (id, factors) exceeds the threshold.

    The same edges as ``statistics.correlation_network`` of the cells u . v.
    """
    kind = items.schema["feature"].dataType.simpleString()
    packed = unit_blocks(items, spread_of(users, rank), block)
    last = packed.agg(F.max("block")).first()[0] or 0
    left = packed.select(F.col("block").alias("a"), F.col("names").alias("names_a"), F.col("units").alias("units_a"))
    right = packed.select(F.col("block").alias("b"), F.col("names").alias("names_b"), F.col("units").alias("units_b"))
    pairs = left.withColumn("b", F.explode(F.sequence("a", F.lit(last)))).join(right, "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                product = matrix(row.column("units_a"), rank) @ matrix(row.column("units_b"), rank).T
                hit = np.abs(np.round(product, CORRELATION_DIGITS)) > threshold
                if row.column("a")[0] == row.column("b")[0]:
                    hit = np.triu(hit, 0 if include_self else 1)
                at = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([row.column(c).flatten().take(pa.array(x)) for c, x in zip(("names_a", "names_b"), at, strict=True)], ["feature_a", "feature_b"])

    return both_directions(pairs.select("a", "b", "names_a", "units_a", "names_b", "units_b").mapInArrow(run, f"feature_a {kind}, feature_b {kind}"))
