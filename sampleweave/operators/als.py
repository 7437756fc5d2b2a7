"""Matrix completion by alternating least squares with weighted regularisation.

One half step solves, per user, (sum v v' + lambda n I) x = sum r v over the user's rated items.
Ratings come sorted by user, and numpy sums a user's run of vectors as a matrix product; the state between two Arrow batches is
one user's sums. A hot user's ratings are split into slots, and only the sums of such users are merged. In the blocked form the
ratings and the routes to them stay where they are, packed, and a half step moves each item vector once to every piece that needs it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import id_uniform, unrolled_dot
from ..session import TASK_ROWS, Rounds, cut, shuffle_width, shuffles_dropped, wide_enough
from .filters import transpose_ratings
from .keys import HOT_ROWS, SlottedRows, block_of, held_by, slotted

BROADCAST_BYTES = 64 * 1024 * 1024
PASS_BYTES = 4 << 30
PASS_FILES = 16
VECTOR_TASK_BYTES = 64 << 20
ITEM_BLOCK = 512
PIECE_ROWS = 2_000_000
SHARD_ROWS = 250_000
FACTORS = "id BIGINT, factors ARRAY<DOUBLE>"
SUMS = "id BIGINT, n BIGINT, gram ARRAY<DOUBLE>, rhs ARRAY<DOUBLE>"
RATED = ("CAST(user AS BIGINT) AS user", "CAST(rating AS DOUBLE) AS rating", "factors")


@dataclass(frozen=True)
class Factorization:
    users: DataFrame  # id, factors
    items: DataFrame  # id, factors


def start_factors(ids: DataFrame, rank: int, seed: int = 42) -> DataFrame:
    """(id, factors): uniform numbers in [0, 1) fixed by id, index and seed."""
    return ids.select("id", F.array(*[id_uniform(F.col("id"), k, seed) for k in range(rank)]).alias("factors"))


def rated_items(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("item").alias("id")).distinct()


@dataclass(frozen=True)
class ItemRatings:
    """Ratings to be joined with factors on the item, and the users whose ratings are spread over ``user_slot``, if any."""

    keyed: SlottedRows
    hot_users: DataFrame | None

    def join(self, factors: DataFrame) -> DataFrame:
        return self.keyed.join(factors.withColumnRenamed("id", "item"))


def by_item(ratings: DataFrame, hot_rows: int = HOT_ROWS) -> ItemRatings:
    spread = slotted(ratings.select("item", "user", "rating"), "user", ["item"], hot_rows)
    rows = spread.rows if spread.hot is None else spread.rows.withColumnRenamed("slot", "user_slot")
    return ItemRatings(slotted(rows, "item", ["user"], hot_rows, counted=ratings), hot_ids(spread))


def hot_ids(spread: SlottedRows) -> DataFrame | None:
    return None if spread.hot is None else spread.hot.select(F.col(spread.key).alias("id"))


# ---- sums over runs ----------------------------------------------------------------------

Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # ids, counts, gram matrices, right sides


def sums_of_runs(users: np.ndarray, ratings: np.ndarray, vectors: np.ndarray) -> Sums:
    """The sums of each run of equal users."""
    starts = np.flatnonzero(np.append(True, users[1:] != users[:-1])) if len(users) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(users)).astype(np.int64)[:len(starts)]
    rank = vectors.shape[1]
    grams, sides = np.empty((len(starts), rank, rank)), np.empty((len(starts), rank))
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        own = vectors[start:end]
        np.dot(own.T, own, out=grams[i])
        np.dot(ratings[start:end], own, out=sides[i])
    return users[starts], ends - starts, grams, sides


def joined_runs(parts: Iterable[Sums]) -> Iterator[Sums]:
    """The sums again, with those of a user that ends one part and begins the next added up."""
    held: Sums | None = None
    for part in parts:
        if len(part[0]) == 0:
            continue
        if held is not None and held[0][0] == part[0][0]:
            for own, before in zip(part[1:], held[1:], strict=True):
                own[0] += before[0]
        elif held is not None:
            yield held
        if len(part[0]) > 1:
            yield tuple(x[:-1] for x in part)
        held = tuple(x[-1:].copy() for x in part)
    if held is not None:
        yield held


def matrix(column: pa.Array, rank: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)


def lists(values: np.ndarray) -> pa.Array:
    """A column of equally long lists."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.reshape(-1))


def solved_batch(sums: Sums, regularization: float) -> pa.RecordBatch:
    ids, counts, grams, sides = sums
    full = grams + (regularization * counts)[:, None, None] * np.eye(grams.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(ids), lists(np.linalg.solve(full, sides[:, :, None])[:, :, 0])], ["id", "factors"])


def sums_batch(sums: Sums) -> pa.RecordBatch:
    """Gram matrices as their upper triangles."""
    ids, counts, grams, sides = sums
    upper = np.triu_indices(grams.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), lists(grams[:, upper[0], upper[1]]), lists(sides)], ["id", "n", "gram", "rhs"])


def unpacked(batch: pa.RecordBatch, rank: int) -> Sums:
    upper = np.triu_indices(rank)
    grams = np.zeros((batch.num_rows, rank, rank))
    packed = matrix(batch.column("gram"), rank * (rank + 1) // 2)
    grams[:, upper[0], upper[1]] = packed
    grams[:, upper[1], upper[0]] = packed
    return batch.column("id").to_numpy(), batch.column("n").to_numpy().copy(), grams, matrix(batch.column("rhs"), rank).copy()


def runs_of(batches: Iterable[pa.RecordBatch], rank: int) -> Iterator[Sums]:
    """Sums per user from batches (user, rating, factors) in the order of users."""
    return joined_runs(sums_of_runs(b.column("user").to_numpy(), b.column("rating").to_numpy(), matrix(b.column("factors"), rank)) for b in batches)


def by_user(rated: DataFrame) -> DataFrame:
    """Joined ratings (user, rating, factors), each user's together and in order; a hot user's slots stay apart."""
    keys = ["user", "user_slot"] if "user_slot" in rated.columns else ["user"]
    return (rated.select(*keys, "rating", "factors").repartition(shuffle_width(rated.sparkSession), *keys)
            .sortWithinPartitions(*keys).select("user", "rating", "factors"))


def run_sums(ordered: DataFrame, rank: int) -> DataFrame:
    """(id, n, gram, rhs) from ratings in the order of users: one row for every run."""
    return ordered.selectExpr(*RATED).mapInArrow(lambda batches: map(sums_batch, runs_of(batches, rank)), SUMS)


def merged(parts: DataFrame, hot: DataFrame, rank: int, regularization: float) -> DataFrame:
    """(id, factors) from sums of which those of the ``hot`` ids are in parts."""
    parts = cut(parts)
    some = parts.join(hot, "id", "left_semi").repartition(shuffle_width(parts.sparkSession), "id").sortWithinPartitions("id")
    whole = some.mapInArrow(lambda batches: map(sums_batch, joined_runs(unique_runs(unpacked(b, rank)) for b in batches)), SUMS)
    return solved(parts.join(hot, "id", "left_anti").unionByName(whole), rank, regularization)


def unique_runs(sums: Sums) -> Sums:
    """Sums in the order of ids, with those of equal ids added up."""
    starts = np.flatnonzero(np.append(True, sums[0][1:] != sums[0][:-1])) if len(sums[0]) else np.zeros(0, np.int64)
    return (sums[0][starts], *[np.add.reduceat(x, starts, axis=0) if len(starts) else x for x in sums[1:]])


def normal_sums(rated: DataFrame, rank: int) -> DataFrame:
    """(id, n, gram, rhs) per user from rows (user, rating, factors); gram is the upper triangle."""
    return run_sums(by_user(rated.drop("user_slot")), rank)


def in_passes(ratings: DataFrame, factors: Callable[[DataFrame], DataFrame], rank: int,
              reduced: Callable[[DataFrame], DataFrame], count: int) -> DataFrame:
    """``reduced`` of the normal sums of all users with the ``factors`` of the ratings, in passes that shuffle about ``PASS_BYTES`` each.

    A vector goes to every rating of its item, so the sums of all users at once lay down ``rank`` numbers a rating. Here a pass brings the
    vectors to the ratings of one group of users; its result is written, and its shuffle files go as it ends. The vectors
    stay by item in their tasks. ``count`` is the rough number of ratings and only decides on the passes; ``reduced`` takes each user's sums
    by themselves.
    """
    spark, passes = ratings.sparkSession, max(1, ceil(factor_bytes(count, rank) / PASS_BYTES))
    if passes == 1:
        ratings = cut(ratings)
        return reduced(normal_sums(by_item(ratings).join(factors(ratings)), rank))
    with shuffles_dropped(spark), wide_enough(spark, count):
        dealt = ratings.withColumn("pass", F.pmod(F.xxhash64("user"), F.lit(passes)).cast("int"))
        ratings = cut(dealt.repartition("pass", F.pmod(F.xxhash64("item"), F.lit(PASS_FILES))), by="pass")
    with shuffles_dropped(spark), wide_enough(spark, max(count // passes, PASS_BYTES // VECTOR_TASK_BYTES * TASK_ROWS)):
        held = held_by(SlottedRows(factors(ratings), "id", None)).rows
        results = [cut(reduced(normal_sums(by_item(ratings.where(F.col("pass") == k)).join(held), rank))) for k in range(passes)]
        held.unpersist()
        return reduce(DataFrame.unionByName, results)


def solved(sums: DataFrame, rank: int, regularization: float) -> DataFrame:
    """(id, factors) from the normal equations."""
    return sums.mapInArrow(lambda batches: (solved_batch(unpacked(b, rank), regularization) for b in batches if b.num_rows), FACTORS)


def solved_in_order(ordered: DataFrame, hot: DataFrame | None, rank: int, regularization: float) -> DataFrame:
    """(id, factors) from ratings (user, rating, factors) in the order of users, those of hot users in parts."""
    if hot is not None:
        return merged(run_sums(ordered, rank), hot, rank, regularization)
    return ordered.selectExpr(*RATED).mapInArrow(
        lambda batches: (solved_batch(sums, regularization) for sums in runs_of(batches, rank)), FACTORS)


# ---- half steps --------------------------------------------------------------------------

def joined_step(rated: ItemRatings, factors: DataFrame, rank: int, regularization: float) -> DataFrame:
    """New user factors; item factors reach the ratings by a join on the item, and go on with them to their user."""
    return solved_in_order(by_user(rated.join(factors)), rated.hot_users, rank, regularization)


def factor_bytes(count: int, rank: int) -> int:
    return count * (rank + 2) * 8


def broadcast_step(ratings: DataFrame, factors: DataFrame, rank: int, regularization: float,
                   most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same with the item factors broadcast, if their counted size allows; else by the join."""
    if factor_bytes(factors.count(), rank) > most_bytes:
        return joined_step(by_item(ratings), factors, rank, regularization)
    vectors = F.broadcast(factors.withColumnRenamed("id", "item"))
    return solved_in_order(by_user(ratings.join(vectors, "item")), None, rank, regularization)


@dataclass(frozen=True)
class HeldRatings:
    """Ratings kept for the half steps of a loop, laid out for the way factors reach them."""

    keyed: SlottedRows
    broadcast: bool
    hot_users: DataFrame | None

    def step(self, factors: DataFrame, rank: int, regularization: float) -> DataFrame:
        if not self.broadcast:
            return joined_step(ItemRatings(self.keyed, self.hot_users), factors, rank, regularization)
        vectors = F.broadcast(factors.withColumnRenamed("id", "item"))
        # held in the order of users, which a broadcast join keeps
        return solved_in_order(self.keyed.rows.join(vectors, "item"), self.hot_users, rank, regularization)


def held_ratings(ratings: DataFrame, rank: int, hot_rows: int, most_bytes: int) -> HeldRatings:
    """By user with broadcast item factors if all of them fit into ``most_bytes``, else by item."""
    n_items = rated_items(ratings).count()
    if factor_bytes(n_items, rank) > most_bytes:
        rated = by_item(ratings, hot_rows)
        return HeldRatings(held_by(rated.keyed), False, rated.hot_users)
    spread = slotted(ratings.select("user", "item", "rating"), "user", ["item"], hot_rows)
    return HeldRatings(held_by(spread), True, hot_ids(spread))


@dataclass(frozen=True)
class RoutedRatings:
    """Ratings packed by user block and piece, and the routes that item vectors take to them, packed by shard of items.

    A piece is one row: its ``users`` in order, where the ratings of each of them start, the number of its items, and for every rating
    the place of its item and its value. Items have their places by shard, then by id, so a shard's vectors lie together: ``shard_starts``
    tells where those of each of its ``shard_ids`` begin. A route is one row: the items that a piece needs of a shard, in that order.
    Both stay in their tasks for all rounds.
    """

    pieces: DataFrame  # block, piece, users, starts, n_items, shard_ids, shard_starts, places, ratings
    routes: DataFrame  # shard, block, piece, items
    shards: int
    hot_users: DataFrame | None


PIECE = "block BIGINT, piece BIGINT, users ARRAY<BIGINT>, starts ARRAY<BIGINT>, items ARRAY<BIGINT>, places ARRAY<INT>, ratings ARRAY<DOUBLE>"
SHARDED = f"{PIECE}, n_items BIGINT, shard_ids ARRAY<BIGINT>, shard_starts ARRAY<BIGINT>"
ROUTE = "shard BIGINT, block BIGINT, piece BIGINT, items ARRAY<BIGINT>"
SENT = "block BIGINT, piece BIGINT, shard BIGINT, factors ARRAY<DOUBLE>"


def packed_piece(key: tuple, rows: pa.Table) -> pa.Table:
    users, items, values = (rows.column(c).to_numpy() for c in ("user", "item", "rating"))
    order = np.lexsort((items, users))
    users, starts = np.unique(users[order], return_index=True)
    items, places = np.unique(items[order], return_inverse=True)
    row = [key[0].as_py(), key[1].as_py(), users, starts, items, places.astype(np.int32), values[order].astype(float)]
    names = ("block", "piece", "users", "starts", "items", "places", "ratings")
    kinds = [pa.int64(), pa.int64(), *(pa.list_(k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))]
    return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds, strict=True)})


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, 1) for i in range(batch.num_rows))


def in_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the items in the order of their shards ``of``."""
    for row in rows_of(batches):
        items, places, of = (row.column(c).flatten().to_numpy() for c in ("items", "places", "of"))
        order = np.argsort(of, kind="stable")
        moved = np.empty(len(order), np.int32)
        moved[order] = np.arange(len(order))
        ids, starts = np.unique(of[order], return_index=True)
        lists_ = [pa.array([v], pa.list_(k)) for v, k in ((items[order], pa.int64()), (moved[places], pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [*(row.column(c) for c in ("block", "piece", "users", "starts")), *lists_, row.column("ratings"), pa.array([len(items)], pa.int64()),
             *(pa.array([v], pa.list_(pa.int64())) for v in (ids, starts))],
            ["block", "piece", "users", "starts", "items", "places", "ratings", "n_items", "shard_ids", "shard_starts"])


def routes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every shard that a piece has items of."""
    for row in rows_of(batches):
        items, ids, starts = (row.column(c).flatten() for c in ("items", "shard_ids", "shard_starts"))
        ends = pa.array(np.append(starts.to_numpy(), len(items)), pa.int32())
        own = [pa.array(row.column(c).to_pylist() * len(ids), pa.int64()) for c in ("block", "piece")]
        yield pa.RecordBatch.from_arrays([ids, *own, pa.ListArray.from_arrays(ends, items)], ["shard", "block", "piece", "items"])


def shard_of(item: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(shards)).cast("long")


def by_user_block(ratings: DataFrame, blocks: int, hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS, shard_rows: int = SHARD_ROWS) -> RoutedRatings:
    """``blocks`` user blocks, each in pieces of about ``piece_rows`` ratings, and shards whose items have about ``shard_rows`` ratings.

    A piece has whole users, but for those with more than ``hot_rows`` ratings, which are split by item over several pieces. A rating
    without user or item meets no vector, and has no place; one without value adds nothing to the right side.
    """
    known = ratings.selectExpr("user", "item", "coalesce(rating, 0.0) AS rating").where("user is not null and item is not null")
    spread = slotted(known, "user", ["item"], min(hot_rows, piece_rows))
    rows = spread.rows.withColumn("user", F.col("user").cast("long")).withColumn("item", F.col("item").cast("long")).withColumn("block", block_of(F.col("user"), blocks))
    counted = rows.groupBy("block").count().agg(F.max("count"), F.sum("count")).first()
    pieces, shards = (max(1, ceil((n or 0) / most)) for n, most in zip(counted, (piece_rows, shard_rows), strict=True))
    part = F.pmod(F.xxhash64(*spread.on), F.lit(pieces)).cast("long")
    packed = rows.withColumn("piece", part).select("block", "piece", "user", "item", "rating").groupBy("block", "piece").applyInArrow(packed_piece, PIECE)
    packed = cut(packed.withColumn("of", F.transform("items", lambda item: shard_of(item, shards))).mapInArrow(in_shards, SHARDED))
    width = shuffle_width(ratings.sparkSession)
    routes = (packed.select("block", "piece", "items", "shard_ids", "shard_starts").mapInArrow(routes_of, ROUTE)
              .repartition(width, "shard").sortWithinPartitions("shard").persist())
    held = packed.drop("items").repartition(width, "block", "piece").sortWithinPartitions("block", "piece").persist()
    routes.count(), held.count()
    return RoutedRatings(held, routes, shards, hot_ids(spread))


def sent_vectors(vectors: pa.Table, routes: pa.Table, rank: int) -> pa.Table:
    """A shard's vectors for each of its routes, one after another; an item without vector has NaN."""
    ids = vectors.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    items = routes.column("items").combine_chunks()
    own, wanted = ids[order], items.flatten().to_numpy()
    sent = np.full((len(wanted), rank), np.nan)
    if len(own):
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        known = own[at] == wanted
        sent[known] = matrix(vectors.column("factors").combine_chunks(), rank)[order[at[known]]]
    ends = np.append(0, np.cumsum(items.value_lengths().to_numpy())) * rank
    return pa.table({**{c: routes.column(c) for c in ("block", "piece", "shard")}, "factors": pa.ListArray.from_arrays(ends.astype(np.int32), sent.reshape(-1))})


def piece_sums(piece: pa.Table, sent: pa.Table, rank: int) -> Sums:
    """The sums of a piece's users from the item vectors that were sent to it; an item without vector counts nothing."""
    row = {name: piece.column(name).combine_chunks().flatten().to_numpy() for name in ("users", "starts", "places", "ratings", "shard_ids", "shard_starts")}
    vectors = np.full((piece.column("n_items")[0].as_py(), rank), np.nan)
    for chunk in sent.to_batches():
        starts = row["shard_starts"][np.searchsorted(row["shard_ids"], chunk.column("shard").to_numpy())]
        lengths, values = chunk.column("factors").value_lengths().to_numpy() // rank, matrix(chunk.column("factors"), rank)
        for start, end, length in zip(starts.tolist(), np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
            vectors[start:start + length] = values[end - length:end]
    users = np.repeat(row["users"], np.diff(np.append(row["starts"], len(row["places"]))))
    own = vectors[row["places"]]
    known = ~np.isnan(own[:, 0])
    return sums_of_runs(users[known], row["ratings"][known], own[known])


def routed_step(rated: RoutedRatings, factors: DataFrame, rank: int, regularization: float) -> DataFrame:
    """The same with each item vector sent once to every piece that needs it; users are solved where their ratings lie.

    Only the vectors move: first to the shard of their item, then, packed by shard and piece, to the pieces.
    """
    placed = factors.select("id", "factors").where("id is not null").withColumn("shard", shard_of(F.col("id"), rated.shards))
    sent = placed.groupBy("shard").cogroup(rated.routes.groupBy("shard")).applyInArrow(lambda vectors, routes: sent_vectors(vectors, routes, rank), SENT)
    groups = rated.pieces.groupBy("block", "piece").cogroup(sent.groupBy("block", "piece"))
    is_whole = rated.hot_users is None

    def run(piece: pa.Table, vectors: pa.Table) -> pa.Table:
        if piece.num_rows == 0:
            return pa.Table.from_batches([], pa.schema([("id", pa.int64()), ("factors", pa.list_(pa.float64()))]))
        sums = piece_sums(piece, vectors, rank)
        return pa.Table.from_batches([solved_batch(sums, regularization) if is_whole else sums_batch(sums)])

    if is_whole:
        return groups.applyInArrow(run, FACTORS)
    return merged(groups.applyInArrow(run, SUMS), rated.hot_users, rank, regularization)


def factorize(ratings: DataFrame, rank: int = 10, regularization: float = 0.1, iterations: int = 10,
              seed: int = 42, hot_rows: int = HOT_ROWS, most_bytes: int = BROADCAST_BYTES) -> Factorization:
    """Alternate user and item updates ``iterations`` times; a last user update follows the loop.

    Per side, factors are broadcast if they fit into ``most_bytes``, else joined (0: always joined).
    """
    ratings = cut(ratings.select("user", "item", "rating"))
    forth = held_ratings(ratings, rank, hot_rows, most_bytes)
    back = held_ratings(transpose_ratings(ratings), rank, hot_rows, most_bytes)
    items, rounds = start_factors(rated_items(ratings), rank, seed), Rounds(ratings.sparkSession)
    for _ in range(iterations):
        users = forth.step(items, rank, regularization)
        items = rounds.commit(back.step(users, rank, regularization))
    users = cut(forth.step(items, rank, regularization))
    forth.keyed.rows.unpersist()
    back.keyed.rows.unpersist()
    return Factorization(users, items)


def factorize_blocked(ratings: DataFrame, rank: int = 10, regularization: float = 0.1, iterations: int = 10,
                      seed: int = 42, user_blocks: int = 10, item_blocks: int = 10) -> Factorization:
    """``factorize`` with blocked users and items and routed vectors."""
    ratings = cut(ratings.select("user", "item", "rating"))
    forth, back = by_user_block(ratings, user_blocks), by_user_block(transpose_ratings(ratings), item_blocks)
    items, rounds = start_factors(rated_items(ratings), rank, seed), Rounds(ratings.sparkSession)
    for _ in range(iterations):
        users = routed_step(forth, items, rank, regularization)
        items = rounds.commit(routed_step(back, users, rank, regularization))
    users = cut(routed_step(forth, items, rank, regularization))
    for held in (forth.pieces, forth.routes, back.pieces, back.routes):
        held.unpersist()
    return Factorization(users, items)


def factorize_builtin(ratings: DataFrame, rank: int = 10, regularization: float = 0.1, iterations: int = 10,
                      seed: int = 42, user_blocks: int = 10, item_blocks: int = 10) -> Factorization:
    """Spark's own blocked ALS: other start values and update order, the same objective."""
    model = ALS(rank=rank, regParam=regularization, maxIter=iterations, seed=seed, userCol="user",
                itemCol="item", ratingCol="rating", numUserBlocks=user_blocks,
                numItemBlocks=item_blocks).fit(ratings)
    return Factorization(*[f.select("id", F.col("features").cast("array<double>").alias("factors"))
                           for f in (model.userFactors, model.itemFactors)])


def completed(model: Factorization, rank: int, n_items: int, block: int = ITEM_BLOCK) -> DataFrame:
    """(user, item, predicted) for every cell: the product of the factor matrices.

    The result has users x items rows by definition. It is made on a grid of user slots and item
    blocks: a user row is repeated once per item block, an item row once per user slot, and an
    equi-join on the grid place does the rest, evenly over the tasks.
    """
    blocks = max(1, ceil(n_items / block))
    user_slots = max(1, ceil(4 * shuffle_width(model.users.sparkSession) / blocks))
    users = (model.users.select(F.col("id").alias("user"), F.col("factors").alias("u"))
             .withColumn("slot", F.pmod(F.xxhash64("user"), F.lit(user_slots)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    items = (model.items.select(F.col("id").alias("item"), F.col("factors").alias("v"))
             .withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
             .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(user_slots - 1)))))
    return users.join(items, ["slot", "block"]).select(
        "user", "item", unrolled_dot(F.col("u"), F.col("v"), rank).alias("predicted"))


def best_items(model: Factorization, rank: int, k: int, block: int = 4096) -> DataFrame:
    """(user, item, predicted, place): the ``k`` items of the highest prediction for every user, equal ones by item.

    Users and items are packed in blocks, and an equi-join makes every pair of blocks a row. Such a row becomes one matrix product of
    which ``k`` cells a user go on; the best of these are the user's. A block of users is repeated once per block of items.
    """
    users, items = (packed_factors(f, block, name) for f, name in ((model.users, "user"), (model.items, "item")))
    last = items.agg(F.max("item_block")).first()[0]
    if last is None:
        return model.users.sparkSession.createDataFrame([], "user BIGINT, item BIGINT, predicted DOUBLE, place INT")
    pairs = users.withColumn("item_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last)))).join(items, "item_block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own, other = (row.column(c).flatten().to_numpy() for c in ("user_ids", "item_ids"))
                cells = matrix(row.column("user_factors"), rank) @ matrix(row.column("item_factors"), rank).T
                yield best_cells(own, other, cells, k)

    found = pairs.select("user_ids", "user_factors", "item_ids", "item_factors").mapInArrow(run, "user BIGINT, item BIGINT, predicted DOUBLE")
    order = Window.partitionBy("user").orderBy(F.desc("predicted"), "item")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def packed_factors(factors: DataFrame, block: int, name: str) -> DataFrame:
    """(``name``_block, ``name``_ids, ``name``_factors): ids in order and their factors one after another, about ``block`` of them a row."""
    count = factors.count()
    blocks = max(1, ceil(count / block))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        values = rows.column("factors").combine_chunks().flatten()
        return pa.table({f"{name}_block": [key[0].as_py()], f"{name}_ids": pa.array([rows.column("id").to_numpy()], pa.list_(pa.int64())),
                         f"{name}_factors": pa.array([values.to_numpy()], pa.list_(pa.float64()))})

    rows = factors.select("id", "factors", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block"))
    return cut(rows.groupBy("block").applyInArrow(pack, f"{name}_block BIGINT, {name}_ids ARRAY<BIGINT>, {name}_factors ARRAY<DOUBLE>"))


def best_cells(users: np.ndarray, items: np.ndarray, cells: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` largest cells of every row; ``items`` ascend, and so do the places of equal cells."""
    if cells.shape[1] > k:
        least = -np.partition(-cells, k - 1, axis=1)[:, k - 1:k]
        above, level = cells > least, cells == least
        keep = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        keep = np.ones(cells.shape, bool)
    row, column = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([pa.array(users[row]), pa.array(items[column]), pa.array(cells[row, column])], ["user", "item", "predicted"])


def filled(ratings: DataFrame, predictions: DataFrame) -> DataFrame:
    """(user, item, value, observed): observed cells stay, the others take the prediction."""
    return (predictions.join(ratings.select("user", "item", "rating"), ["user", "item"], "left")
            .select("user", "item", F.coalesce("rating", "predicted").alias("value"),
                    F.col("rating").isNotNull().alias("observed")))


def predicted(ratings: DataFrame, model: Factorization, rank: int) -> DataFrame:
    """(user, item, rating, predicted) for the given cells only."""
    users = model.users.select(F.col("id").alias("user"), F.col("factors").alias("u"))
    items = model.items.select(F.col("id").alias("item"), F.col("factors").alias("v"))
    return (ratings.join(users, "user").join(items, "item")
            .select("user", "item", "rating", unrolled_dot(F.col("u"), F.col("v"), rank).alias("predicted")))


def objective(ratings: DataFrame, model: Factorization, rank: int, regularization: float) -> float:
    """Squared error plus regularization * (sum over users and items of n * |factors|^2)."""
    cells = predicted(ratings, model, rank)
    error = cells.agg(F.sum(F.pow(F.col("rating") - F.col("predicted"), 2)).alias("e")).first()["e"]
    penalty = 0.0
    for factors, key in ((model.users, "user"), (model.items, "item")):
        counts = ratings.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
        norm = unrolled_dot(F.col("factors"), F.col("factors"), rank)
        penalty += factors.join(counts, "id").agg(F.sum(F.col("n") * norm).alias("p")).first()["p"]
    return error + regularization * penalty
