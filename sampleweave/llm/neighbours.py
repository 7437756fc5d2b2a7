"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner products become smallest distances by one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm (0 for a
query): |q' - v'|^2 = |q|^2 + M^2 - 2 q.v. Gaussian (2-stable) projections to ``m`` dimensions turn a distance d into d times
a chi variable with m degrees of freedom. A kd-tree, split at medians of a bounded sample of projected rows, gives every
row a leaf; a leaf's box comes from all of its rows. A query visits leaves in the order of their projected distance, some more
in each round, and its candidates are verified with the original vectors in double precision. It stops when the chance
that a row at the distance of its k-th best would have been projected within the radius already visited, a
chi-square probability, reaches ``certainty``, or when no leaf is left.

Every row is indexed. Leaves with more than ``block_rows`` rows (copies of one vector) and visits by more than
``block_queries`` queries are dealt out in blocks, so that no task holds an unbounded group.

Defined results: rows whose vector is null, zero, or holds a null or non-finite component take no part, nor do rows without an
id or with another dimension than most; of rows that repeat an id the one with the least vector (in array order) takes
part. Ties go to the smaller id. Scores are plain sums in index order, so equal vectors score equally.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.llm.common import bounded_sample, column
from sampleweave.session import cut


@dataclass(frozen=True)
class SearchSettings:
    k: int = 20
    every: int = 20  # rows whose id is divisible by this are the queries
    m: int = 8  # even: the chi-square law then has a closed form
    certainty: float = 0.95
    sample_rows: int = 50_000
    leaf_rows: int = 1024
    max_depth: int = 14
    first_leaves: int = 4
    block_rows: int = 4096
    block_queries: int = 1024
    seed: int = 3


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, square): one row per id."""
    v = column(table, "embedding", "array<double>") if "embedding" in table.columns else F.lit(None).cast("array<double>")
    rows = table.select(column(table, "vec_id", "long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    rows = rows.join(F.broadcast(common.select("d")), F.size("v") == F.col("d")).drop("d")  # one row
    return cut(rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def chance_within(x: np.ndarray, m: int) -> np.ndarray:
    """Chi-square distribution function for even ``m``."""
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for i in range(m // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def kd_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and place of every inner node of a complete tree, in heap order."""
    dims, places = np.zeros(2 ** depth - 1, int), np.zeros(2 ** depth - 1)
    own = {0: np.arange(len(points))}
    for node in range(2 ** depth - 1):
        rows = own.pop(node)
        if len(rows):
            dims[node] = int(np.ptp(points[rows], axis=0).argmax())
            places[node] = float(np.median(points[rows, dims[node]]))
        right = points[rows, dims[node]] > places[node]
        own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]
    return dims, places


def leaf_of(points: np.ndarray, dims: np.ndarray, places: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), int)
    for _ in range(int(np.log2(len(dims) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > places[node])
    return node - len(dims)


def stacked(column_: pd.Series) -> np.ndarray:
    return np.stack(column_.to_numpy())


def plain_dot(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums in index order; a cumulative sum never adds pairwise."""
    return np.cumsum(rows * q, axis=1)[:, -1]


def best_of_block(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple]:
    """For each query its k best rows of a block that its k-th best so far, ``floor``, does not rule out.

    A matrix product finds all rows within rounding of the k-th or of the floor, which are then scored exactly.
    """
    rough = q @ v.T
    slack = 1e-9 * np.sqrt((q ** 2).sum(axis=1)) * np.sqrt((v ** 2).sum(axis=1).max())
    keep = min(k + 1, len(ids))
    least = np.maximum(np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep], floor) - slack
    alive = rough.max(axis=1) >= least
    for row in np.flatnonzero(alive):
        query = query_ids[row]
        own = np.flatnonzero((rough[row] >= least[row]) & (ids != query))
        score = plain_dot(v[own], q[row])
        for j in np.lexsort((ids[own], -score))[:k]:
            if score[j] >= floor[row]:
                yield int(query), int(ids[own[j]]), float(score[j])


def nearest(table: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    s, spark = settings, table.sparkSession
    rows = valid_vectors(table)
    seen = rows.agg(F.count("*").alias("n"), F.max("square").alias("square"), F.max(F.size("v")).alias("d")).head()
    best_columns = "query_id long, vec_id long, score double"
    if not seen.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = float(seen.square)
    plane = np.random.default_rng(s.seed).standard_normal((seen.d + 1, s.m))

    def projected(v: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, largest - (v ** 2).sum(axis=1)))
        return v @ plane[:-1] + more[:, None] * plane[-1]

    sample = stacked(bounded_sample(rows.select("vec_id", "v"), ["vec_id"], s.sample_rows).toPandas()["v"])
    depth = int(np.clip(np.ceil(np.log2(max(1, seen.n / s.leaf_rows))), 0, min(s.max_depth, np.log2(max(1, len(sample) / 8)))))
    dims, places = kd_tree(projected(sample, False), depth)

    def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                p = projected(stacked(f["v"]), False)
                yield pd.DataFrame({"leaf": leaf_of(p, dims, places) if depth else 0, "vec_id": f["vec_id"], "v": f["v"], "p": list(p)})

    index = cut(rows.select("vec_id", "v").mapInPandas(indexed, "leaf int, vec_id long, v array<double>, p array<double>"))
    edge = lambda f, i: f(F.col("p")[i])
    boxes = (index.groupBy("leaf").agg(F.count("*").alias("n"), F.array(*(edge(F.min, i) for i in range(s.m))).alias("low"),
                                       F.array(*(edge(F.max, i) for i in range(s.m))).alias("high")).orderBy("leaf").toPandas())  # at most 2^max_depth rows
    leaves, low, high = boxes["leaf"].to_numpy(), stacked(boxes["low"]), stacked(boxes["high"])
    parts = {int(a): int(-(-n // s.block_rows)) for a, n in zip(boxes["leaf"], boxes["n"], strict=True)}
    blocks = spark.createDataFrame(sorted(parts.items()), "leaf int, blocks int")
    # the leaves are a table of bounded size
    index = cut(index.join(F.broadcast(blocks), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v"))

    def ranked(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by projected distance, and these squared distances in order."""
        p = projected(q, True)
        away = np.zeros((len(q), len(leaves)))
        for i in range(s.m):
            away += np.maximum(0, np.maximum(low[None, :, i] - p[:, i, None], p[:, i, None] - high[None, :, i])) ** 2
        order = np.argsort(away, axis=1, kind="stable")
        return order, np.take_along_axis(away, order, axis=1)

    queries = rows.where(F.pmod("vec_id", F.lit(s.every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("-inf")).alias("floor"))
    best, active = None, cut(queries)
    at, step = 0, s.first_leaves
    while at < len(leaves) and not active.isEmpty():
        upto = min(len(leaves), at + step)

        def visits(frames: Iterator[pd.DataFrame], at: int = at, upto: int = upto) -> Iterator[pd.DataFrame]:
            for f in frames:
                for k in range(0, len(f), 256):
                    part = f.iloc[k:k + 256]
                    order, _ = ranked(stacked(part["q"]))
                    chosen = leaves[order[:, at:upto]]
                    yield pd.DataFrame({"leaf": chosen.reshape(-1), "query_id": np.repeat(part["query_id"].to_numpy(), upto - at),
                                        "q": [x for x in part["q"] for _ in range(upto - at)],
                                        "floor": np.repeat(part["floor"].to_numpy(), upto - at)})

        asked = active.mapInPandas(visits, "leaf int, query_id long, q array<double>, floor double")
        asked = cut(asked)
        crowds = asked.groupBy("leaf").agg(F.ceil(F.count("*") / s.block_queries).cast("int").alias("crowds"))  # one row per leaf: bounded
        asked = asked.join(F.broadcast(crowds), "leaf").withColumn("crowd", F.pmod(F.xxhash64("query_id"), "crowds").cast("int"))
        asked = asked.join(F.broadcast(blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = index.join(F.broadcast(crowds), "leaf").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))

        def verify(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(asking):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            ids, v = own["vec_id"].to_numpy(), stacked(own["v"])
            out = list(best_of_block(ids, v, asking["query_id"].to_numpy(), stacked(asking["q"]), asking["floor"].to_numpy(), s.k))
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        keys = ["leaf", "block", "crowd"]
        found = (held.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "query_id", "q", "floor").groupBy(*keys))
                 .applyInPandas(verify, best_columns))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = cut((found if best is None else best.select("query_id", "vec_id", "score").unionByName(found))
                   .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k))
        at, step = upto, step * 2
        if at >= len(leaves):
            break

        def unsettled(frames: Iterator[pd.DataFrame], at: int = at) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                q = stacked(f["q"])
                radius = ranked(q)[1][:, at]
                distance = np.maximum((q ** 2).sum(axis=1) + largest - 2 * f["least"].to_numpy(), 1e-300)
                settled = (f["n"].to_numpy() >= s.k) & (chance_within(radius / distance, s.m) >= s.certainty)
                f["floor"] = np.where(f["n"] >= s.k, f["least"], -np.inf)
                yield f.loc[~settled, ["query_id", "q", "floor"]]

        kth = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        active = cut(active.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("least", F.lit(0.0)).alias("least"))
                     .mapInPandas(unsettled, "query_id long, q array<double>, floor double"))
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
