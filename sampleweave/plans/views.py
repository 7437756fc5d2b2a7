"""The given tables seen as the data model: samples, ratings, links, reads, points, texts.

Each view exists twice: as a DataFrame for the operators, and as SQL for the check against
another engine. Joins are ordered so that small results are joined into large ones late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, wide_enough

POSITIVE_BELOW = 5
LINE_RANGE = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sample_long(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, grp, feature, value): supplier by brand, summed quantity."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    cells = (table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
             .join(part, F.col("l_partkey") == F.col("p_partkey"))
             .groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("value")))
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    grp = F.when(F.pmod("s_nationkey", F.lit(2)) == 0, "healthy").otherwise("diseased")
    return (cells.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("l_suppkey").alias("sample_id"), grp.alias("grp"),
                    F.col("p_brand").alias("feature"), "value"))


def sample_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, feature, value): user by event type and hour, summed value."""
    feature = F.concat_ws("_", "event_type", F.hour("ts").cast("string"))
    return (table(spark, folder, "events").select(F.col("user_id").alias("sample_id"),
                                                  feature.alias("feature"), "value")
            .groupBy("sample_id", "feature").agg(F.round(F.sum("value"), 6).alias("value")))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item, rating): customer by part, average quantity."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("user"),
                     F.col("l_partkey").alias("item"))
            .agg(F.avg("l_quantity").alias("rating")))


def brand_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item, rating): customer by the number of the part's brand, for queries whose result is every cell."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    brands = table(spark, folder, "part").select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("item"))
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(brands, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("o_custkey").alias("user"), "item").agg(F.avg("l_quantity").alias("rating")))


def link_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, n): part to the part of the next line of its order (by line, part, supplier), and how often.

    An order is read in ranges of line numbers, so a very long one fills no task; the last line of a range goes on to
    the first of the next one that has lines. The result is a table, made in tasks of a bounded number of lines.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                    F.floor(F.col("l_linenumber") / LINE_RANGE).alias("range"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    within = Window.partitionBy("l_orderkey", "range").orderBy(*order)
    lines = lines.withColumn("dst", F.lead("l_partkey").over(within))
    first = (lines.groupBy("l_orderkey", "range").agg(F.min(F.struct(*order)).alias("least"))  # one row per range
             .withColumn("opens", F.lead("least.l_partkey").over(Window.partitionBy("l_orderkey").orderBy("range"))).drop("least"))
    lines = lines.join(first, ["l_orderkey", "range"]).withColumn("dst", F.coalesce("dst", "opens"))
    counts = lines.where("dst is not null").groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.count("*").alias("n"))
    with wide_enough(spark, table(spark, folder, "lineitem").count()):
        return cut(counts)


def links(spark: SparkSession, folder: str) -> DataFrame:
    return link_counts(spark, folder).select("src", "dst")


def edges_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, weight) in both directions, weight = number of occurrences."""
    return both_ways(link_counts(spark, folder))


def both_ways(counts: DataFrame) -> DataFrame:
    """``edges_weighted`` of the table of ``link_counts``, again a table."""
    both = counts.select("src", "dst", "n").union(counts.select("dst", "src", "n"))
    with wide_enough(counts.sparkSession, 2 * counts.count()):
        return cut(both.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight")))


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """(country, book): customer nation and part name of each order line."""
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("book"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    home = (orders.join(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
                        F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "country"))
    return (lines.join(home, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey")).select("country", "book"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """(index, data, label): embeddings with labels +1 and -1."""
    label = F.when(F.col("label") < POSITIVE_BELOW, 1.0).otherwise(-1.0)
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("index"), F.col("embedding").cast("array<double>").alias("data"),
        label.alias("label"))


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Eight text columns: which supplier delivered which part, and how."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return (table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("p_name").alias("name1"), F.col("p_partkey").cast("string").alias("id1"),
                    F.col("p_brand").alias("np1"), F.col("s_name").alias("name2"),
                    F.col("s_suppkey").cast("string").alias("id2"),
                    F.col("s_nationkey").cast("string").alias("np2"),
                    F.col("l_returnflag").alias("invivo"), F.col("l_linestatus").alias("value")))


SQL = {
    "sample_long": ((), f"""
        SELECT l_suppkey AS sample_id,
               CASE WHEN s_nationkey % 2 = 0 THEN 'healthy' ELSE 'diseased' END AS grp,
               p_brand AS feature, SUM(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY 1, 2, 3"""),
    "sample_sparse": ((), """
        SELECT user_id AS sample_id, event_type || '_' || CAST(hour(ts) AS VARCHAR) AS feature,
               round(SUM(value), 6) AS value
        FROM events GROUP BY 1, 2"""),
    "ratings": ((), """
        SELECT o_custkey AS "user", l_partkey AS item, AVG(l_quantity) AS rating
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""),
    "brand_ratings": ((), """
        SELECT o_custkey AS "user", CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS item, AVG(l_quantity) AS rating
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "link_counts": ((), """
        SELECT src, dst, COUNT(*) AS n
        FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
              FROM lineitem)
        WHERE dst IS NOT NULL GROUP BY 1, 2"""),
    "links": (("link_counts",), "SELECT src, dst FROM link_counts"),
    "nodes": (("links",), "SELECT src AS id FROM links UNION SELECT dst FROM links"),
    "edges_weighted": (("link_counts",), """
        SELECT src, dst, CAST(SUM(n) AS DOUBLE) AS weight
        FROM (SELECT src, dst, n FROM link_counts UNION ALL SELECT dst, src, n FROM link_counts)
        GROUP BY 1, 2"""),
    "reads": ((), """
        SELECT n_name AS country, p_name AS book
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""),
    "points": ((), f"""
        SELECT vec_id AS index, CAST(embedding AS DOUBLE[]) AS data,
               CASE WHEN label < {POSITIVE_BELOW} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label
        FROM embeddings"""),
    "interactions": ((), """
        SELECT p_name AS name1, s_name AS name2
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""),
}


def with_views(body: str, *names: str, more: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """``WITH`` the named views, what they need, and ``more`` (name, sql) pairs, then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in ordered]
    parts += [f"{n} ({sql})" if " AS" in n else f"{n} AS MATERIALIZED ({sql})" for n, sql in more]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
