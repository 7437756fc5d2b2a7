"""Lines of the text exports. Each frame has the line and the columns it is sorted by."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .keys import block_of

# Fixed formats of the exported files.
GDF_RANK_HEADER = "nodedef>name VARCHAR, rank DOUBLE, label VARCHAR"
GDF_CLUSTER_HEADER = "nodedef>name VARCHAR, cluster DOUBLE, label VARCHAR"
GDF_EDGE_HEADER = "edgedef>node1 VARCHAR, node2 VARCHAR"


def _gdf(header: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, rank, key, line) of header, nodes, edge header and edges."""
    spark = nodes.sparkSession
    headers = spark.createDataFrame([(0, header), (2, GDF_EDGE_HEADER)], "section INT, line STRING")
    headers = headers.select("section", F.lit(0.0).alias("rank"), F.lit("").alias("key"), "line")
    edge_line = F.concat_ws(",", "src", "dst")
    edge_rows = edges.select(F.lit(3).alias("section"), F.lit(0.0).alias("rank"),
                             edge_line.alias("key"), edge_line.alias("line"))
    node_rows = nodes.select(F.lit(1).alias("section"), "rank", F.col("name").cast("string").alias("key"), "line")
    return headers.unionByName(node_rows).unionByName(edge_rows)


def in_file_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "rank", "key")


def gdf_ranks(ranks: DataFrame, edges: DataFrame, shown: Column | None = None) -> DataFrame:
    """Nodes ``name,rank,label`` in ascending rank, then edges. ``ranks``: (name, rank, label)."""
    shown = F.col("rank").cast("string") if shown is None else shown
    line = F.concat_ws(",", F.col("name").cast("string"), shown, F.col("label"))
    return _gdf(GDF_RANK_HEADER, ranks.select("name", "rank", line.alias("line")), edges)


def gdf_clusters(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes ``name,cluster,label``, then edges. ``clusters``: (name, cluster, label)."""
    line = F.concat_ws(",", F.col("name").cast("string"), F.col("cluster").cast("string"), F.col("label"))
    nodes = clusters.select("name", F.lit(0.0).alias("rank"), line.alias("line"))
    return _gdf(GDF_CLUSTER_HEADER, nodes, edges)


def weight_lines(weights: DataFrame, shown: Column | None = None) -> DataFrame:
    """``weight , feature`` in ascending weight."""
    shown = F.col("weight").cast("string") if shown is None else shown
    return (weights.select("weight", "feature", F.concat_ws(" , ", shown, F.col("feature")).alias("line"))
            .orderBy("weight", "feature"))


def label_lines(scored: DataFrame, shown: Column | None = None) -> DataFrame:
    """``Healthy : sample, score``"""
    shown = F.col("score").cast("string") if shown is None else shown
    return scored.withColumn("line", F.concat(
        F.col("label"), F.lit(" : "), F.col("sample_id").cast("string"), F.lit(", "), shown))


def difference_lines(differences: DataFrame, identity: str) -> DataFrame:
    """``Gene: name , rank difference: d``"""
    return differences.withColumn("line", F.concat(
        F.lit("Gene: "), F.col(identity).cast("string"), F.lit(" , rank difference: "),
        F.col("difference").cast("double").cast("string")))


def libsvm_lines(rows: DataFrame, shown=None) -> DataFrame:
    """``label 1:v 2:v ...`` from (sample_id, label, values)."""
    shown = shown or (lambda v: v.cast("string"))
    parts = F.transform("values", lambda v, i: F.concat_ws(":", (i + 1).cast("string"), shown(v)))
    return rows.select("sample_id", F.concat_ws(" ", F.col("label").cast("int").cast("string"),
                                                F.array_join(parts, " ")).alias("line"))


def sparse_libsvm_lines(rows: DataFrame, shown=None) -> DataFrame:
    """``label i:v ...`` of the given values only, from (sample_id, label, indices, values)."""
    shown = shown or (lambda v: v.cast("string"))
    parts = F.transform(F.arrays_zip("indices", "values"), lambda e: F.concat_ws(":", (e["indices"] + 1).cast("string"), shown(e["values"])))
    return rows.select("sample_id", F.concat_ws(" ", F.col("label").cast("int").cast("string"),
                                                F.when(F.size(parts) > 0, F.array_join(parts, " "))).alias("line"))


def labelled_vectors(rows: DataFrame) -> DataFrame:
    """(label, features) for Spark's own learners and for the LibSVM writer."""
    return rows.select(F.col("label").cast("double").alias("label"),
                       array_to_vector("values").alias("features"))


def factor_block_lines(factors: DataFrame, blocks: int) -> DataFrame:
    """``Block: i`` and below it one ``(id, f1,f2,...)`` per factor row, as (block, place, line).

    The lines are sorted, not gathered, so a block may be of any size.
    """
    rows = factors.select(block_of(F.col("id"), blocks).alias("block"), F.col("id").cast("long").alias("place"),
                          text.factor_line(F.col("id"), F.col("factors")).alias("line"))
    heads = rows.select("block").distinct().select(
        "block", F.lit(-1).cast("long").alias("place"),
        F.concat(F.lit("Block: "), F.col("block").cast("string")).alias("line"))
    return heads.unionByName(rows).orderBy("block", "place")


def node_lines(ids: DataFrame) -> DataFrame:
    """``i i`` per vertex."""
    return ids.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("id").cast("string")).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """``src dst 1`` per directed edge."""
    return edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"),
                                    F.lit("1")).alias("line"))
