"""From long cells (sample_id, feature, value) to filled, labelled and transposed matrices.

Cells are unique per (sample_id, feature); a missing cell means zero.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width
from .filters import exclude
from .keys import chunk_of, numbered

FEATURE_BLOCK = 512
BROADCAST_FEATURES = 100_000


def feature_dictionary(cells: DataFrame) -> DataFrame:
    """(feature, feature_idx) from 1, in order of first appearance: first sample, then name."""
    first = cells.groupBy("feature").agg(F.min("sample_id").alias("first_sample"))
    return (numbered(first, [F.col("first_sample").asc(), F.col("feature").asc()], "feature_idx")
            .select("feature", "feature_idx", "first_sample"))


def zero_fill(cells: DataFrame, samples: DataFrame, features: DataFrame,
              block: int = FEATURE_BLOCK) -> DataFrame:
    """Every (sample, feature) of ``samples`` x ``features``, with 0 where no cell is given.

    The cells of a sample are put beside the names of each block of about ``block`` features,
    and only the names not seen are added: no pair of sample and feature is ever joined, and
    no list is longer than a block. Cells of other samples or features are dropped.
    """
    n_features = features.count()
    blocks = max(1, ceil(n_features / block))
    in_block = F.pmod(F.xxhash64("feature"), F.lit(blocks)).cast("int")
    names = (features.select("feature", in_block.alias("block"))
             .groupBy("block").agg(F.collect_set("feature").alias("names")))
    if n_features <= BROADCAST_FEATURES:
        salts, names = 1, F.broadcast(names.withColumn("salt", F.lit(0)))
    else:
        salts = max(1, ceil(4 * shuffle_width(features.sparkSession) / blocks))
        names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    seen = (cells.join(features.select("feature"), "feature", "left_semi")
            .groupBy("sample_id", in_block.alias("block"))
            .agg(F.collect_list(F.struct("feature", "value")).alias("given")))
    rows = samples.select("sample_id",
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    beside = (rows.join(seen, ["sample_id", "block"], "left")
              .withColumn("given", F.coalesce("given", F.array().cast(dict(seen.dtypes)["given"])))
              .withColumn("salt", F.pmod(F.xxhash64("sample_id"), F.lit(salts)).cast("int"))
              .join(names, ["block", "salt"]))
    absent = F.array_except("names", F.transform("given", lambda c: c["feature"]))
    zeros = F.transform(absent, lambda name: F.struct(name.alias("feature"), F.lit(0.0).alias("value")))
    return beside.select("sample_id", F.inline(F.concat("given", zeros)))


def dense_matrix(cells: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """All samples by all features of ``cells``, zero-filled."""
    cells = exclude(cells, "feature", excluded)
    return zero_fill(cells, cells.select("sample_id").distinct(), cells.select("feature").distinct())


def label_of(group) -> F.Column:
    return F.when(group == "healthy", 1).otherwise(-1)


def labelled_rows(cells: DataFrame, labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per sample: (sample_id, label, values) with values in dictionary order.

    A row is as long as the dictionary, which ``first_features`` keeps within the feature cap.
    """
    dense = zero_fill(cells, labels, dictionary)
    entry = F.struct("feature_idx", "value")
    return (dense.join(dictionary.select("feature", "feature_idx"), "feature")
            .groupBy("sample_id").agg(F.sort_array(F.collect_list(entry)).alias("es"))
            .join(labels.select("sample_id", "label"), "sample_id")
            .select("sample_id", "label", F.transform("es", lambda e: e["value"]).alias("values")))


def sparse_rows(cells: DataFrame, labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per labelled sample: (sample_id, label, size, indices, values), indices from 0 in ascending order.

    Only given cells of the dictionary's features are held, so nothing is zero-filled; a sample without any has empty lists.
    """
    size = dictionary.agg(F.max("feature_idx")).first()[0] or 0
    entry = F.struct((F.col("feature_idx") - 1).alias("i"), F.col("value").cast("double").alias("v"))
    given = (cells.join(dictionary.select("feature", "feature_idx"), "feature")
             .groupBy("sample_id").agg(F.sort_array(F.collect_list(entry)).alias("es")))
    part = lambda name, kind: F.coalesce(F.transform("es", lambda e: e[name]), F.array().cast(f"array<{kind}>"))
    return (labels.select("sample_id", "label").join(given, "sample_id", "left")
            .select("sample_id", "label", F.lit(size).cast("long").alias("size"), part("i", "bigint").alias("indices"), part("v", "double").alias("values")))


def transposed(dense: DataFrame, width: int = 4_096) -> DataFrame:
    """Rows by feature: (feature, chunk, values), values in sample order, in sample-range chunks."""
    entry = F.struct("sample_id", "value")
    return (dense.groupBy("feature", chunk_of(F.col("sample_id"), width).alias("chunk"))
            .agg(F.sort_array(F.collect_list(entry)).alias("es"))
            .select("feature", "chunk", F.transform("es", lambda e: e["value"]).alias("values")))


def triples(dense: DataFrame, samples: DataFrame, dictionary: DataFrame, base: int = 1) -> DataFrame:
    """(row, col, value) with indices from ``base``; ``samples`` has (sample_id, sample_idx)."""
    return (dense.join(samples, "sample_id")
            .join(dictionary.select("feature", "feature_idx"), "feature")
            .select((F.col("sample_idx") - 1 + base).alias("row"),
                    (F.col("feature_idx") - 1 + base).alias("col"), "value"))


def sample_index(cells: DataFrame) -> DataFrame:
    """(sample_id, sample_idx) from 1, in order of the sample id."""
    return numbered(cells.select("sample_id").distinct(), [F.col("sample_id").asc()], "sample_idx")
