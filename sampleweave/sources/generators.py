"""Seeded generators: the same rows on every run and every partitioning."""

from __future__ import annotations

from math import isqrt, pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import folded_pareto, id_uniform


def id_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1)


def skewed_reads(draws: DataFrame, draw_id: Column, countries: int, books: int,
                 skew: float, seed: int = 1) -> DataFrame:
    """One read per row of ``draws``: a country index by a skewed law, a book index uniformly."""
    # 1 - u keeps the draw away from zero
    country = folded_pareto(F.lit(1.0) - id_uniform(draw_id, 0, seed), skew, countries - 1)
    book = F.floor(id_uniform(draw_id, 1, seed) * F.lit(float(books))).cast("long")
    return draws.select(draw_id.alias("draw_id"), country.alias("country_id"), book.alias("book_id"))


def named_reads(reads: DataFrame, countries: DataFrame, books: DataFrame) -> DataFrame:
    """Join the generated indices with their names: countries few, books by a shuffled hash join."""
    return (reads.join(countries, "country_id")
            .join(books.hint("shuffle_hash"), "book_id")
            .select("draw_id", "country", "book"))


def least_prime(n: int) -> int:
    """The least prime that is not below ``n``."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, isqrt(n) + 1)):
        n += 1
    return n


def gaussian(identity: Column, index: Column | int, seed: int) -> Column:
    """A standard normal number fixed by (id, index, seed), from two uniform ones."""
    at = index if isinstance(index, Column) else F.lit(index)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - id_uniform(identity, at, seed)))
    return radius * F.cos(F.lit(2 * pi) * id_uniform(identity, at + 1, seed))


def sparse_ratings(listeners: DataFrame, listener: str, songs: int, mean_count: float,
                   std_count: float, mean: float, std: float, seed: int = 7) -> DataFrame:
    """Ratings (user, item, rating): per listener a Gaussian number of distinct songs, Gaussian values.

    The songs are the first ``count`` numbers up to ``songs`` of a random walk with a fixed stride modulo the
    least prime that is not below it, so the work grows with the ratings and not with listeners x songs.
    """
    user = F.col("user")
    prime = least_prime(songs)
    count = F.greatest(F.lit(0), F.least(F.lit(songs), F.round(gaussian(user, 0, seed) * std_count + mean_count))).cast("long")
    stride = F.floor(id_uniform(user, 2, seed) * (prime - 1)).cast("long") + 1
    first = F.floor(id_uniform(user, 3, seed) * prime).cast("long")
    walk = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") + (prime - songs)), lambda j: (F.col("stride") * j + F.col("first")) % prime)
    drawn = (listeners.select(F.col(listener).cast("long").alias("user"))
             .select("user", count.alias("n"), stride.alias("stride"), first.alias("first"))
             .select("user", F.explode(F.slice(F.filter(walk, lambda x: x < songs), F.lit(1), F.col("n"))).alias("song")))
    item = F.col("song") + 1
    return drawn.select("user", item.alias("item"), (gaussian(user, item * 2 + 10, seed) * std + mean).alias("rating"))
