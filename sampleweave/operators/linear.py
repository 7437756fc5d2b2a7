"""Linear classification by distributed dual coordinate ascent, prediction and regression.

Only the weight vector, one number per feature, ever reaches the driver. Points have
(index BIGINT, data ARRAY<DOUBLE>, label DOUBLE) with labels +1 and -1. For dual ascent they may be sparse: with a column
``indices`` (from 0), ``data`` holds the values there and ``size`` the length of the whole row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.numbers import id_uniform
from ..session import cut, shuffle_width
from .aggregates import sum_vectors
from .keys import block_of, numbered

BLOCK_BYTES = 32 * 1024 * 1024


def dual_step(data: Column, label: Column, alpha: Column, weights: Column, regularization: float,
              n: int) -> Column:
    """Struct (alpha, factor) of one hinge-loss coordinate step; the weights change by factor * data."""
    strength = float(regularization * n)
    grad = (label * vectors.dot(data, weights) - 1.0) * strength
    square = vectors.dot(data, data)
    stepped = F.greatest(F.least(alpha - F.try_divide(grad, square), F.lit(1.0)), F.lit(0.0))
    new = F.when(grad == 0.0, alpha).when(square == 0.0, 1.0).otherwise(stepped)
    return F.struct(new.alias("alpha"), (label * (new - alpha) / strength).alias("factor"))


def local_ascent(data: np.ndarray, labels: np.ndarray, alphas: np.ndarray, weights: np.ndarray,
                 strength: float, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate steps on the rows in ``order``; gives the changes of alphas and weights."""
    now, w = alphas.copy(), weights.copy()
    squares = np.einsum("ij,ij->i", data, data)
    for i in order:
        grad = (labels[i] * (data[i] @ w) - 1.0) * strength
        if grad == 0.0:
            continue
        new = 1.0 if squares[i] == 0.0 else min(max(now[i] - grad / squares[i], 0.0), 1.0)
        w += (labels[i] * (new - now[i]) / strength) * data[i]
        now[i] = new
    return now - alphas, w - weights


@dataclass(frozen=True)
class DrawnPoints:
    """The working set of a training: a row (turn, block, step, place, data, label) for every step of every block."""

    rows: DataFrame
    points: int  # all points, drawn or not
    size: int
    blocks: list[int]


def block_places(points: DataFrame, blocks: int) -> DataFrame:
    """(place, block, index, mark, label): all points numbered block by block, by index within; ``mark`` stands for the data.

    Block = index modulo blocks. Only keys are sorted and stored.
    """
    own = points.select(block_of(F.col("index"), blocks).alias("block"), "index", F.xxhash64(*contents(points)).alias("mark"), "label").where("block is not null")
    order = [F.col("block").asc(), F.col("index").asc(), F.col("mark").asc(), F.col("label").asc()]
    return cut(numbered(own, order, "place").select("place", "block", "index", "mark", "label"))


def contents(points: DataFrame) -> list[str]:
    """The columns of a point's data: dense or sparse."""
    return ["size", "indices", "data"] if "indices" in points.columns else ["data"]


def drawn_points(points: DataFrame, blocks: int, outer: int, inner: int, seed: int) -> DrawnPoints:
    """Fetches what all rounds will visit before the first: a step's place depends on (block, step, seed) alone.

    The working set has blocks * outer * inner rows, whatever the number of points. It is stored in the order of the rounds, so a
    round's scan skips all others.
    """
    placed = block_places(points, blocks)
    spans = placed.groupBy("block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    counts = {r["block"]: r["n"] for r in spans.select("block", "n").collect()}  # one row per block
    steps = F.sequence(F.lit(0).cast("long"), F.lit(max(1, outer * inner) - 1).cast("long"))
    place = F.col("first") + F.floor(id_uniform(F.col("block"), F.col("step"), seed) * F.col("n"))
    draws = spans.withColumn("step", F.explode(steps)).select("step", place.alias("place"))
    known = cut(draws.join(placed, "place"))
    key = ["index", "mark", "label"]
    own = contents(points)
    data = (points.select("index", F.xxhash64(*own).alias("mark"), "label", *own).join(known.select(*key).distinct(), key, "left_semi")
            .groupBy(*key).agg(*[F.first(c).alias(c) for c in own]))  # points that are equal in all columns are one
    order = ["turn", "block", "step"]
    rows = known.join(data, key).select(F.floor(F.col("step") / max(1, inner)).alias("turn"), "block", "step", "place", *own, "label")
    rows = cut(rows.repartitionByRange(shuffle_width(points.sparkSession), *order).sortWithinPartitions(*order))
    size = rows.agg(F.max("size" if "size" in own else F.size("data")).alias("d")).first()["d"] or 0
    return DrawnPoints(rows, sum(counts.values()), size, sorted(counts))


@dataclass(frozen=True)
class DualModel:
    weights: list[float]
    alphas: DataFrame  # place, block, alpha of the points visited; all others have 0
    points: int


def train_dual(points: DataFrame, blocks: int = 10, outer: int = 10, inner: int = 10,
               regularization: float = 0.01, scaling: float = 1.0, seed: int = 42,
               start: list[float] | None = None, task_bytes: int = BLOCK_BYTES) -> DualModel:
    """Each round every block runs ``inner`` steps from the same weights; the scaled changes are summed.

    The points of all rounds are fetched once (``drawn_points``); a round is one job over its own rows. If a block's rows of a
    round could fill more than ``task_bytes``, the steps run as several jobs in order, each of which goes on from the last one's
    local weights and dual values; the model is the same for any such bound. The driver holds the weights, and a dual value for each
    point visited: at most blocks * outer * inner, a choice of the caller. A lost executor loses no state.
    """
    drawn = drawn_points(points, blocks, outer, inner, seed)
    size, share = drawn.size, scaling / blocks
    strength = regularization * drawn.points
    weights = np.array(start if start is not None else [0.0] * size)
    most = max(1, task_bytes // (16 * max(1, size)))
    duals: dict[tuple[int, int], float] = {}

    for turn in range(outer):
        moved: dict[tuple[int, int], float] = {}
        local = {block: np.zeros(size) for block in drawn.blocks}
        for first in range(turn * inner, (turn + 1) * inner, most):
            last = min(first + most, (turn + 1) * inner)
            rows = drawn.rows.where((F.col("turn") == turn) & (F.col("step") >= first) & (F.col("step") < last))
            now = {key: duals.get(key, 0.0) + moved.get(key, 0.0) for key in duals.keys() | moved.keys()}
            stepped = rows.groupBy("block").applyInPandas(
                ascent_of_block(weights, local, now, strength), "block BIGINT, places ARRAY<BIGINT>, deltas ARRAY<DOUBLE>, change ARRAY<DOUBLE>")
            for row in stepped.collect():  # one row per block
                local[row["block"]] = local[row["block"]] + np.array(row["change"])
                for place, delta in zip(row["places"], row["deltas"], strict=True):
                    key = (row["block"], place)
                    moved[key] = moved.get(key, 0.0) + delta
        for key, delta in moved.items():
            duals[key] = duals.get(key, 0.0) + delta * share
        weights = weights + share * np.sum([local[b] for b in sorted(local)], axis=0)
    alphas = points.sparkSession.createDataFrame([(p, b, a) for (b, p), a in sorted(duals.items())], "place BIGINT, block BIGINT, alpha DOUBLE")
    return DualModel(weights.tolist(), alphas, drawn.points)


def ascent_of_block(weights: np.ndarray, local: dict[int, np.ndarray], duals: dict[tuple[int, int], float], strength: float):
    """Runs the steps of one block in order over their rows (block, step, place, data, label)."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        block = int(batch["block"].iloc[0])
        batch = batch.sort_values("step")
        places, first, order = np.unique(batch["place"].to_numpy(), return_index=True, return_inverse=True)
        own = batch.iloc[first]
        delta, change = local_ascent(
            dense_rows(own, len(weights)), own["label"].to_numpy(dtype=float),
            np.array([duals.get((block, int(p)), 0.0) for p in places]), weights + local[block], strength, order.tolist())
        return pd.DataFrame({"block": [block], "places": [places], "deltas": [delta], "change": [change]})
    return run


def dense_rows(batch: pd.DataFrame, size: int) -> np.ndarray:
    """The drawn points of a task as a matrix."""
    if "indices" not in batch:
        return np.stack(batch["data"].to_numpy()).astype(float)
    out = np.zeros((len(batch), size))
    for row, at, values in zip(out, batch["indices"], batch["data"], strict=True):
        row[np.asarray(at, dtype=np.int64)] = values
    return out


def train_svm(points: DataFrame, blocks: int = 10, iterations: int = 100, regularization: float = 0.01,
              stepsize: float = 0.01, seed: int = 42, inner: int = 10) -> DualModel:
    return train_dual(points, blocks, iterations, inner, regularization, stepsize, seed)


def train_linear_svc(points: DataFrame, regularization: float = 0.01, iterations: int = 100) -> list[float]:
    """Spark's own linear SVM without intercept; it wants labels 0 and 1 and has another optimiser."""
    rows = points.select(array_to_vector("data").alias("features"),
                         F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"))
    model = LinearSVC(fitIntercept=False, standardization=False, regParam=regularization,
                      maxIter=iterations).fit(rows)
    return model.coefficients.toArray().tolist()


def gap(points: DataFrame, model: DualModel, regularization: float) -> float:
    """Primal minus dual objective of a trained model."""
    w = vectors.literal(model.weights)
    loss = points.agg(F.avg(F.greatest(
        F.lit(0.0), 1.0 - F.col("label") * vectors.dot(F.col("data"), w))).alias("l")).first()["l"]
    dual = model.alphas.agg(F.coalesce(F.sum("alpha"), F.lit(0.0)).alias("a")).first()["a"]
    return regularization * float(np.dot(model.weights, model.weights)) + loss - dual / model.points


def predict(points: DataFrame, weights: list[float]) -> DataFrame:
    """Points with their score and predicted label; a score of 0 counts as positive."""
    score = vectors.dot(F.col("data"), vectors.literal(weights))
    return (points.withColumn("score", score)
            .withColumn("prediction", F.when(F.col("score") < 0, -1.0).otherwise(1.0)))


def score_samples(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, score, label) from long cells and (feature, weight); absent cells and weights add nothing.

    Every sample of ``cells`` gets a score; one without any known feature scores 0.
    """
    return (cells.join(weights, "feature", "left").groupBy("sample_id")
            .agg(F.coalesce(F.sum(F.col("weight") * F.col("value")), F.lit(0.0)).alias("score"))
            .withColumn("label", F.when(F.col("score") < 0, "Diseased").otherwise("Healthy")))


def fit_line(df: DataFrame, y: str, x: str, *groups: str) -> DataFrame:
    """Closed-form least squares for one feature: slope and intercept, per group if given."""
    return df.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"),
                                   F.regr_intercept(y, x).alias("intercept"),
                                   F.count("*").alias("n"))


def fit_linear(points: DataFrame) -> tuple[list[float], float]:
    """Least squares for all features by Spark's own estimator: weights and intercept."""
    rows = points.select(array_to_vector("data").alias("features"), "label")
    model = LinearRegression().fit(rows)
    return model.coefficients.toArray().tolist(), model.intercept


def fit_gradient(points: DataFrame, rounds: int = 50, stepsize: float = 0.05) -> tuple[list[float], float]:
    """Gradient descent on the mean squared residual, with step stepsize / sqrt(round).

    A round is one pass: each Arrow batch gives its own gradient, and the small batch gradients
    are summed as columns.
    """
    points = cut(points.select("data", "label"))
    facts = points.agg(F.count("*").alias("n"), F.max(F.size("data")).alias("d")).first()
    n, size = facts["n"], facts["d"]
    weights = np.zeros(size + 1)  # the intercept is last

    for turn in range(1, rounds + 1):
        def slope(batches: Iterator[pd.DataFrame], w: np.ndarray = weights):
            for batch in batches:
                if len(batch):
                    data = np.column_stack([np.stack(batch["data"].to_numpy()), np.ones(len(batch))])
                    yield pd.DataFrame({"slope": [data.T @ (data @ w - batch["label"].to_numpy())]})

        grad = np.zeros(size + 1)
        parts = points.mapInPandas(slope, "slope ARRAY<DOUBLE>")
        for row in sum_vectors(parts, "slope").collect():  # one row per feature
            grad[row["pos"]] = row["total"]
        weights = weights - stepsize / sqrt(turn) * grad / n
    return weights[:-1].tolist(), float(weights[-1])


def weights_frame(spark, names: DataFrame, weights: list[float]) -> DataFrame:
    """(feature, weight) from a dictionary (feature, feature_idx) and weights in that order."""
    listed = spark.createDataFrame([(i + 1, float(w)) for i, w in enumerate(weights)],
                                   "feature_idx BIGINT, weight DOUBLE")
    return names.select("feature", "feature_idx").join(listed, "feature_idx").select("feature", "weight")
