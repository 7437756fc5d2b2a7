"""Readers. Every one states its schema; none infers it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Fixed values of the sample files: which names are samples, and how the count column is called.
SAMPLE_GLOB = "*{mirna.qua,rsem.genes.no}*"
EXACT_COUNT_HEADER = "reads_per_million_miRNA_mapped"
COUNT_HEADER_PART = "count"

RATINGS = "user INT, item INT, rating FLOAT"
EDGES = "src BIGINT, dst BIGINT, weight DOUBLE"
VERTICES = "id BIGINT, value BIGINT"
LINKS = "src BIGINT, dst BIGINT, mark INT"
READS = "country STRING, book STRING"
INTERACTIONS = ("name1 STRING, id1 STRING, np1 STRING, name2 STRING, id2 STRING, np2 STRING, "
                "invivo STRING, value STRING")


def is_count_header(header: Column) -> Column:
    return (header == EXACT_COUNT_HEADER) | header.contains(COUNT_HEADER_PART)


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """All sample files of a folder as (sample_id, feature, value): one scan, not one job per file.

    Files may differ in their columns, so each file's own header line picks its count column:
    the last one that names a count, else the second. Header rows and ids with ``?`` drop out.
    """
    lines = (spark.read.option("pathGlobFilter", SAMPLE_GLOB).text(folder)
             .select(F.col("_metadata.file_name").alias("sample_id"), F.col("_metadata.file_block_start").alias("at_start"),
                     F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("fields")))
    # the first field is the name column, whatever it says
    places = F.transform("fields", lambda h, i: F.when((i > 0) & is_count_header(h), i))
    # the header is a file's first line: the first one of the part of the file that starts at byte 0
    headers = (lines.filter("at_start = 0").groupBy("sample_id").agg(F.min_by(F.array_max(places), "line").alias("at")))
    rows = lines.join(headers, "sample_id", "left")
    rows = rows.select("sample_id", F.get("fields", F.lit(0)).alias("feature"),
                       F.get("fields", F.coalesce("at", F.lit(1))).alias("count_text"))
    return (drop_stray_rows(rows, "feature", "count_text")
            .select("sample_id", "feature", F.col("count_text").try_cast("double").alias("value"))
            .filter(F.col("value").isNotNull()))


def drop_stray_rows(df: DataFrame, identity: str, count: str) -> DataFrame:
    """Drop ids with ``?`` and repeated header lines (their count text says count or reads)."""
    return df.filter(~F.col(identity).contains("?")
                     & ~F.col(count).contains("count")
                     & ~F.col(count).contains("reads"))


def count_samples(spark: SparkSession, folder: str) -> int:
    names = (spark.read.format("binaryFile").option("pathGlobFilter", SAMPLE_GLOB).load(folder)
             .select("path"))
    return names.count()


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATINGS).csv(path)


def read_edges(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.schema(EDGES).option("sep", sep).option("comment", "#").csv(path)


def read_vertices(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.schema(VERTICES).option("sep", sep).option("comment", "#").csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_vertices(spark, path).select(F.col("id").alias("page_id"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINKS).option("sep", " ").csv(path).select("src", "dst")


def parse_adjacency(lines: DataFrame, column: str = "value") -> DataFrame:
    """``node,n1,n2,...`` to (node, neighbours)."""
    parts = F.split(column, ",")
    ids = F.transform(parts, lambda p: F.trim(p).cast("long"))
    return lines.select(F.get(ids, F.lit(0)).alias("node"),
                        F.slice(ids, F.lit(2), F.size(ids) - 1).alias("neighbours"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return parse_adjacency(spark.read.text(path))


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTIONS).option("sep", "\t").csv(path)


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(READS).csv(path)


def read_libsvm(spark: SparkSession, path: str, size: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", size).load(path)


def parse_factors(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(text.factor_line_id(F.col(column)).alias("id"),
                        text.factor_line_values(F.col(column)).alias("factors"))


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return parse_factors(spark.read.text(path))


def read_groups(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Sample files of several group folders, with the group name in ``grp``."""
    frames = [read_samples(spark, folder).withColumn("grp", F.lit(name))
              for name, folder in folders.items()]
    return reduce(DataFrame.unionByName, frames)
