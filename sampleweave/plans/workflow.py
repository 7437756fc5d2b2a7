"""The whole analysis: matrix, completion, classifier, networks, ranks, communities, comparison."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import als, exports, filters, graph, linear, lowrank, matrix, ranking, statistics
from ..session import cut
from ..sources import readers, writers

GROUPS = ("healthy", "diseased")


@dataclass(frozen=True)
class Settings:
    completion: bool = True
    keep_observed: bool = False  # False replaces every cell by its completed value
    factors: int = 10
    completion_iterations: int = 100
    completion_regularization: float = 0.1
    training: str = "svm"  # or "regression"
    svm_iterations: int = 100
    svm_regularization: float = 0.01
    svm_stepsize: float = 0.01
    regression_iterations: int = 50
    regression_stepsize: float = 0.05
    blocks: int = 8
    threshold: float = 0.9
    max_features: int | None = None  # keep all
    excluded: list[str] = field(default_factory=list)
    include_self: bool = True
    rank_rounds: int = graph.MAX_ROUNDS
    community_rounds: int = graph.COMMUNITY_ROUNDS
    community_delta: float = graph.COMMUNITY_DELTA
    seed: int = 42


@dataclass(frozen=True)
class Network:
    edges: DataFrame        # src, dst, weight
    ranks: DataFrame        # id, rank
    communities: DataFrame  # id, community


@dataclass(frozen=True)
class Analysis:
    dictionary: DataFrame   # feature, feature_idx
    cells: DataFrame        # sample_id, feature, value
    labels: DataFrame       # sample_id, grp, label
    weights: DataFrame      # feature, weight
    scores: DataFrame       # sample_id, score, label
    networks: dict[str, Network]
    differences: DataFrame  # feature, position_a, position_b, difference


@dataclass(frozen=True)
class Completed:
    cells: DataFrame     # sample_id, feature, value: every cell
    samples: DataFrame   # id, sample_id, factors
    features: DataFrame  # feature, factors


def completed(cells: DataFrame, dictionary: DataFrame, settings: Settings) -> Completed:
    """The completed matrix and its factors. Only cells given are ratings; absent ones are unknown."""
    samples = cut(matrix.sample_index(cells))
    names = dictionary.select("feature", "feature_idx")
    ratings = cut(cells.join(samples, "sample_id").join(names, "feature").select(
        F.col("sample_idx").alias("user"), F.col("feature_idx").alias("item"), F.col("value").alias("rating")))
    model = als.factorize(ratings, settings.factors, settings.completion_regularization,
                          settings.completion_iterations, settings.seed)
    found = als.completed(model, settings.factors, model.items.count())
    found = (als.filled(ratings, found).select("user", "item", "value") if settings.keep_observed
             else found.withColumnRenamed("predicted", "value"))
    found = (found.join(samples, found["user"] == samples["sample_idx"])
             .join(names, F.col("item") == F.col("feature_idx")).select("sample_id", "feature", "value"))
    return Completed(found, model.users.join(samples, F.col("id") == F.col("sample_idx")).select("id", "sample_id", "factors"),
                     model.items.join(names, F.col("id") == F.col("feature_idx")).select("feature", "factors"))


def trained_weights(cells: DataFrame, labels: DataFrame, dictionary: DataFrame, settings: Settings) -> DataFrame:
    order = matrix.sample_index(cells)
    svm = settings.training == "svm"
    rows = (matrix.sparse_rows if svm else matrix.labelled_rows)(cells, labels, dictionary).join(order, "sample_id")
    points = cut(rows.select((F.col("sample_idx") - 1).alias("index"), *(["size", "indices"] if svm else []), F.col("values").alias("data"),
                             F.col("label").cast("double").alias("label")))
    if svm:
        weights = linear.train_svm(points, settings.blocks, settings.svm_iterations,
                                   settings.svm_regularization, settings.svm_stepsize, settings.seed).weights
    else:
        weights, _ = linear.fit_gradient(points, settings.regression_iterations, settings.regression_stepsize)
    return linear.weights_frame(cells.sparkSession, dictionary, weights)


def group_edges(cells: DataFrame, whole: Completed | None, members: DataFrame, settings: Settings) -> DataFrame:
    """The network of some samples: from the factors if these make all cells, else from the cells."""
    if whole is None or settings.keep_observed:
        return statistics.correlation_network(cells.join(members, "sample_id", "left_semi"), settings.threshold, settings.include_self)
    return lowrank.factor_network(whole.samples.join(members, "sample_id", "left_semi"), whole.features, settings.factors,
                                  settings.threshold, settings.include_self)


def group_network(edges: DataFrame, dictionary: DataFrame, settings: Settings) -> Network:
    edges = cut(edges)
    pages = dictionary.select(F.col("feature").alias("id"))
    ranks = graph.pagerank(pages, edges, dictionary.count(), max_rounds=settings.rank_rounds)
    vertices = pages.withColumn("value", F.col("id"))
    found = graph.communities(vertices, edges, settings.community_rounds, settings.community_delta)
    return Network(edges, ranks, found)


def analyse(training: DataFrame, test: DataFrame, settings: Settings = Settings()) -> Analysis:
    """``training``: (sample_id, grp, feature, value); ``test``: (sample_id, feature, value)."""
    training = cut(filters.exclude(training, "feature", settings.excluded))
    dictionary = matrix.feature_dictionary(training).select("feature", "feature_idx")
    if settings.max_features is not None:
        dictionary = dictionary.filter(F.col("feature_idx") <= settings.max_features)
    dictionary = cut(dictionary)
    labels = cut(training.select("sample_id", "grp").distinct()
                 .withColumn("label", matrix.label_of(F.col("grp"))))
    cells = (training if settings.max_features is None
             else filters.first_features(training, dictionary, settings.max_features)).select("sample_id", "feature", "value")
    whole = completed(cells, dictionary, settings) if settings.completion else None
    cells = cut(cells if whole is None else whole.cells)

    weights = cut(trained_weights(cells, labels, dictionary, settings))
    scores = linear.score_samples(filters.exclude(test, "feature", settings.excluded), weights)

    networks = {}
    for group in GROUPS:
        members = labels.filter(F.col("grp") == group).select("sample_id")
        networks[group] = group_network(group_edges(cells, whole, members, settings), dictionary, settings)
    differences = ranking.rank_difference(networks["healthy"].ranks, networks["diseased"].ranks, "id", "rank")
    return Analysis(dictionary, cells, labels, weights, scores, networks,
                    differences.withColumnRenamed("id", "feature"))


def analyse_folders(spark: SparkSession, healthy: str, diseased: str, test: str,
                    settings: Settings = Settings()) -> Analysis:
    training = readers.read_groups(spark, {"healthy": healthy, "diseased": diseased})
    return analyse(training, readers.read_samples(spark, test), settings)


def export(result: Analysis, folder: str) -> None:
    """Write the results in their text formats; a node's name is its place in the dictionary."""
    writers.write_lines(exports.weight_lines(result.weights), f"{folder}/classifier")
    writers.write_lines(exports.label_lines(result.scores), f"{folder}/labels")
    known = result.differences.filter(F.col("difference").isNotNull()).orderBy("difference", "feature")
    writers.write_lines(exports.difference_lines(known, "feature"), f"{folder}/rank_differences")
    place = result.dictionary.select("feature", F.col("feature_idx").alias("name"))
    for group, network in result.networks.items():
        a = place.select(F.col("feature").alias("src"), F.col("name").alias("a"))
        b = place.select(F.col("feature").alias("dst"), F.col("name").alias("b"))
        edges = network.edges.join(a, "src").join(b, "dst").select(
            F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
        ranks = network.ranks.withColumnRenamed("id", "feature").join(place, "feature").select(
            "name", "rank", F.col("feature").alias("label"))
        found = network.communities.withColumnRenamed("id", "feature").join(place, "feature")
        names = place.select(F.col("feature").alias("community"), F.col("name").alias("cluster"))
        found = found.join(names, "community").select("name", "cluster", F.col("feature").alias("label"))
        writers.write_lines(exports.edge_lines(edges), f"{folder}/network_{group}")
        writers.write_lines(exports.in_file_order(exports.gdf_ranks(ranks, edges)), f"{folder}/gdf_pageranks_{group}")
        writers.write_lines(exports.in_file_order(exports.gdf_clusters(found, edges)), f"{folder}/gdf_clusters_{group}")


__all__ = ["Analysis", "Network", "Settings", "analyse", "analyse_folders", "export"]
